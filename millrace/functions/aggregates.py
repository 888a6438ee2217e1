"""Aggregates by name; others can be registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError
from ..plans.syntax import Aggregate

#: (column, its type) -> aggregate column.
Builder = Callable[[Column, T.DataType], Column]


def _count(column: Column, kind: T.DataType) -> Column:
    """Rows of the group, whatever the column holds."""
    return F.count(F.lit(1))


def _number(name: str, kind: T.DataType) -> None:
    if not isinstance(kind, T.NumericType):
        raise AnalysisError(f"{name} needs a number, not {kind.simpleString()}")


def _sum(column: Column, kind: T.DataType) -> Column:
    """A long for integers; for other numbers, which the dialect cannot declare, Spark's sum."""
    _number("sum", kind)
    return F.sum(column.cast("long") if isinstance(kind, T.IntegralType) else column)


def _avg(column: Column, kind: T.DataType) -> Column:
    """For integers the long that sum / count gives without its fraction; for other numbers Spark's average."""
    _number("avg", kind)
    if not isinstance(kind, T.IntegralType):
        return F.avg(column)
    return F.call_function("div", F.sum(column.cast("long")), F.count(column))


_BUILDERS: dict[str, Builder] = {
    "max": lambda c, kind: F.max(c),
    "min": lambda c, kind: F.min(c),
    "count": _count,
    "sum": _sum,
    "avg": _avg,
}


def register(name: str, builder: Builder) -> None:
    """Adds or replaces an aggregate for the operator API; a grouped-aggregate pandas UDF works as well as any column."""
    _BUILDERS[name] = builder


def build(aggregate: Aggregate, schema: T.StructType) -> Column:
    """The column of an aggregate, named ``<function>Of<column>``."""
    if aggregate.function not in _BUILDERS:
        raise AnalysisError(f"unknown aggregate {aggregate.function}")
    found = next((f for f in schema.fields if f.name.lower() == aggregate.name.lower()), None)
    if found is None:
        raise AnalysisError(f"field {aggregate.name} not found")
    return _BUILDERS[aggregate.function](F.col(f"`{found.name}`"), found.dataType).alias(aggregate.output)
