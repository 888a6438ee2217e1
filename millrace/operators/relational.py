"""Scan, filter, project, join, group, sort and materialise, each a DataFrame that Catalyst plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import aggregates as agg
from ..functions.comparisons import comparison, condition
from ..plans.syntax import Aggregate, Constant, Name, Order, Predicate, Term
from ..sources.files import shared_folder

#: Bytes up to which a side is broadcast by ``index_join``; its size is Spark's own, of the files it reads.
BROADCAST_BYTES = 64 << 20


def _check(df: DataFrame, names: Sequence[str]) -> None:
    known = {c.lower() for c in df.columns}
    for name in names:
        if name.lower() not in known:
            raise AnalysisError(f"field {name} not found")


def select(df: DataFrame, predicate: Predicate | None) -> DataFrame:
    """Rows for which all terms hold; all rows for None. The terms stay plain comparisons, so that they reach the scan."""
    if not predicate or not predicate.terms:
        return df
    return df.filter(condition(predicate, df.schema))


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The named columns; rows that become equal all stay."""
    _check(df, fields)
    return df.select(*(F.col(f"`{f}`") for f in fields))


def cross_join(first: DataFrame, second: DataFrame) -> DataFrame:
    """All pairs; of a name that both have, the first's column stays. A filter above that equates columns turns it into a hash or
    merge join."""
    return first.crossJoin(second.select(*(F.col(f"`{c}`") for c in second.columns if c not in first.columns)))


def index_join(left: DataFrame, right: DataFrame, field: str) -> DataFrame:
    """Pairs with equal ``field``; of other names that both have, the right's column stays.

    The right side is broadcast only if Spark's estimate of its size, which filters never raise, is within ``BROADCAST_BYTES``; else Spark picks a shuffled join.
    """
    _check(left, [field])
    _check(right, [field])
    own = [c for c in left.columns if c not in right.columns or c == field]
    size = right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    side = F.broadcast(right) if int(str(size)) <= BROADCAST_BYTES else right
    return left.select(*(F.col(f"`{c}`") for c in own)).join(side, field, "inner")


def index_select(df: DataFrame, field: str, value) -> DataFrame:
    """Rows whose ``field`` equals a constant; over an index layout Spark prunes partitions or row groups by it."""
    _check(df, [field])
    return df.filter(comparison(Term(Name(field), "=", Constant(value)), df.schema))


def group_by(df: DataFrame, fields: Sequence[str], aggregates: Sequence[Aggregate] = ()) -> DataFrame:
    """Group fields, then aggregates. No fields: one group of all rows (one row, even of no rows); no aggregates: the different keys."""
    _check(df, fields)
    built = [agg.build(a, df.schema) for a in dict.fromkeys(aggregates)]
    if not built:
        return project(df, fields).distinct()
    return df.groupBy(*(F.col(f"`{f}`") for f in fields)).agg(*built)


def sort(df: DataFrame, order: Sequence[Order | str]) -> DataFrame:
    """Rows by keys, bytewise for strings, false before true."""
    keys = []
    for item in order:
        item = Order(Name(item)) if isinstance(item, str) else item
        name = item.key.output if isinstance(item.key, Aggregate) else item.key.name
        _check(df, [name])
        keys.append(F.col(f"`{name}`").desc() if item.descending else F.col(f"`{name}`").asc())
    return df.orderBy(*keys) if keys else df


def materialize(df: DataFrame) -> DataFrame:
    """The rows, computed now and kept in the checkpoint folder that all executors share; later reads do not compute them again."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def positions(df: DataFrame, name: str = "position") -> DataFrame:
    """The rows with their places, from 0, in the order that the frame has; as a sort is by ranges, no task puts all rows in order.

    Rows are numbered in their partitions, and the sizes of the partitions before, one row each, are added.
    """
    at = F.monotonically_increasing_id()
    told = materialize(df.withColumn("_at", at)).withColumn("_part", F.shiftright("_at", 33))
    sizes = told.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return told.join(before, "_part").withColumn(name, place).select(*df.columns, name)


def row_ids(df: DataFrame) -> DataFrame:
    """The rows of a scan of files with ``_rid``: the file and the place in it, stable as long as the version is."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_rid"))


def move_to(df: DataFrame, rid) -> DataFrame:
    """The row of ``row_ids`` with one id."""
    return df.filter((F.col("_rid.file") == rid["file"]) & (F.col("_rid.row") == rid["row"]))
