"""Comparisons by the dialect's rules, as Spark columns that still reach the scan."""

from __future__ import annotations

import datetime as dt
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError
from ..plans.syntax import Constant, Expression, Predicate, Term, column_of
from ..types import family_of

_COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def literal(value) -> tuple[Column, T.DataType]:
    """A constant and its type; dates are timestamps without a zone."""
    if isinstance(value, dt.date):
        return F.lit(value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()).cast("timestamp_ntz"), T.TimestampNTZType()
    if isinstance(value, bool):
        return F.lit(value), T.BooleanType()
    if isinstance(value, int):
        kind = T.IntegerType() if -(1 << 31) <= value < 1 << 31 else T.LongType()
        if not -(1 << 63) <= value < 1 << 63:
            kind = T.DecimalType(38, 0)
        return F.lit(value).cast(kind), kind
    return F.lit(value), T.StringType()


def operand(e: Expression, schema: T.StructType) -> tuple[Column, T.DataType]:
    if isinstance(e, Constant):
        return literal(e.value)
    name = column_of(e)
    found = next((f for f in schema.fields if f.name.lower() == name.lower()), None)
    if found is None:
        raise AnalysisError(f"field {name} not found")
    return F.col(f"`{found.name}`"), found.dataType


def comparison(term: Term, schema: T.StructType) -> Column:
    """Whether a term holds; null if a side is null, which a filter takes for false.

    Numbers compare with numbers whatever their width, strings bytewise, dates as instants. Of different families ``=`` and
    ranges are false and ``<>`` is true; ranges of booleans are false.
    """
    (left, left_type), (right, right_type) = operand(term.left, schema), operand(term.right, schema)
    family = family_of(left_type)
    if family != family_of(right_type) or (family == "other" and left_type != right_type):
        return left.isNotNull() & right.isNotNull() if term.op == "<>" else F.lit(False)
    if family == "bool" and term.op not in ("=", "<>"):
        return F.lit(False)
    if family == "date" and left_type != right_type:
        left, right = left.cast("timestamp_ntz"), right.cast("timestamp_ntz")
    return _COMPARE[term.op](left, right)


def condition(predicate: Predicate, schema: T.StructType) -> Column:
    """Whether all terms hold; true for none."""
    found = [comparison(t, schema) for t in predicate.terms]
    return reduce(operator.and_, found) if found else F.lit(True)
