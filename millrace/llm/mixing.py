"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, checkpoint

#: Words to a bucket of the seeded order, about; a bucket is the most that one task must sort of a source.
BUCKET_WORDS = 1 << 21
#: Sources, a row of some hundred bytes each, up to which they are broadcast; with more, rows are shuffled by source and skewed ones split by AQE.
FEW_SOURCES = 10_000


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with ``place``, from 0, by code point, null last; without a one-task sort.

    Range-sorted partitions are numbered within; the sizes of the partitions before, one row each, are added.
    """
    at = checkpoint(
        sources.orderBy(F.col("source").asc_nulls_last())
        .select("*", F.monotonically_increasing_id().alias("at"))
        .select("source", "source_size", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("offset"))
    )
    counts = at.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return at.join(before, "part").select("source", "source_size", (F.col("before") + F.col("offset")).alias("place"))


def water_fill(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target, target_words) for (source, source_size).

    The sources, by code point and null last, weigh ``weights``, repeating. The sum of all sizes is shared by
    weight; a source above ``max_epochs`` times its size is clamped there and the excess is reshared among the
    others, until none is above. Each round clamps whole sets of sources and brings one row to the driver. Sums are
    decimals, so that they are exact at any size. ``target`` is a double, ``target_words`` its floor. No words
    give targets of 0.
    """
    exact = "decimal(38,0)"
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    filled = checkpoint(
        ranked(sources).select("source", "source_size", weight.cast("long").alias("weight"), F.lit(False).alias("full"))
    )
    cap = F.col("source_size") * max_epochs
    total = filled.agg(F.sum(F.col("source_size").cast(exact))).first()[0] or 0
    while True:
        row = filled.agg(
            F.sum(F.when(~F.col("full"), F.col("weight")).cast(exact)).alias("w"),
            F.sum(F.when(F.col("full"), cap).cast(exact)).alias("c"),
        ).first()
        open_weight, rest = int(row.w or 0), int(total) - int(row.c or 0)
        above = ~F.col("full") & (cap.cast(exact) * F.lit(open_weight).cast("decimal(18,0)") < F.col("weight").cast("decimal(4,0)") * F.lit(rest).cast("decimal(30,0)"))
        if not open_weight or filled.where(above).isEmpty():
            break
        filled = filled.withColumn("full", F.col("full") | above)
    share = F.col("weight").cast("decimal(4,0)") * F.lit(rest).cast("decimal(30,0)")
    target = F.when(F.col("full"), cap.cast("double")).otherwise(share.cast("double") / F.lit(float(max(open_weight, 1))))
    target_words = F.when(F.col("full"), cap).otherwise(F.floor(share / F.lit(max(open_weight, 1)).cast("decimal(18,0)")).cast("long"))
    return filled.select("source", "source_size", target.alias("target"), target_words.alias("target_words"))


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with ``_size``, and ``_key``: the place in the seeded order, by the MD5 of the seed and doc_id, or of the text where that is null."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return docs.withColumns({"_size": size_of(F.col("text")), "_key": F.md5(F.concat_ws(":", F.lit(str(seed)), own)), "_t": F.xxhash64("text")})


def _plan(rows: DataFrame, weights: Sequence[int], max_epochs: int, bucket_words: int) -> tuple[DataFrame, int]:
    """(a row for each source: s, source_size, target, whole, part, border, before; digits of a bucket) for rows (source, _size, _key)."""
    sources = rows.groupBy("source").agg(F.sum("_size").alias("source_size"))
    targets = checkpoint(water_fill(sources, weights, max_epochs))
    largest = targets.agg(F.max("source_size")).first()[0] or 0
    digits = 1
    while 16**digits * bucket_words < largest and digits < 12:
        digits += 1
    divisor = F.greatest("source_size", F.lit(1))
    targets = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.expr("target_words div greatest(source_size, 1)").alias("whole"),
        (F.col("target_words") % divisor).alias("part"),
    )
    buckets = rows.groupBy("source", F.substring("_key", 1, digits).alias("bucket")).agg(F.sum("_size").alias("n"))
    before = buckets.select(
        "source", "bucket", "n",
        (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"),
    ).join(targets, F.col("source").eqNullSafe(F.col("s")))
    border = before.where((F.col("before") < F.col("part")) & (F.col("before") + F.col("n") >= F.col("part")))
    border = checkpoint(border.select(F.col("source").alias("s"), F.col("bucket").alias("border"), "before"))
    return checkpoint(targets.join(border, targets["s"].eqNullSafe(border["s"]), "left").drop(border["s"])), digits


def _with_copies(rows: DataFrame, plan: DataFrame, digits: int) -> DataFrame:
    """``rows`` (doc_id, source, _size, _key, _t, ...) with ``_source_size``, ``_target`` and ``_copies``, how often the mix takes each.

    Only the rows of the bucket with the border of a source are put in order; all others are told by their bucket.
    """
    few = plan.count() <= FEW_SOURCES
    plan = plan.select(*(F.col(c).alias(f"_{c}") for c in plan.columns))
    plan = F.broadcast(plan) if few else plan.hint("merge")
    told = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_bucket", F.substring("_key", 1, digits))
    at_border = F.col("_bucket") == F.col("_border")
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "_size", "_t").rowsBetween(Window.unboundedPreceding, 0)
    inside = told.where(at_border).withColumn("_start", F.col("_before") + F.sum("_size").over(order) - F.col("_size"))
    extra = F.when(F.col("_start") * 2 + F.col("_size") <= F.col("_part") * 2, 1).otherwise(0)
    outside = told.where(~F.coalesce(at_border, F.lit(False))).withColumn("_start", F.lit(0).cast("long"))
    ahead = F.when(F.col("_bucket") < F.col("_border"), 1).otherwise(0)
    told = inside.withColumn("_extra", extra).unionByName(outside.withColumn("_extra", ahead))
    return told.withColumn("_copies", F.col("_whole") + F.col("_extra"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 42,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): doc_id, size, source, source_size, target, copies, taken.

    A source whose target is e times its size gives every row floor(e) times, and once more the rows that come
    first in an order seeded by ``seed`` until the rest of the target is reached; the row across that border goes in if its middle
    lies before. So a source misses its target by half a row at most. The order is by the MD5 of the seed and doc_id;
    rows of one id follow in order of size and of a hash of the text, so reruns agree.

    A source may hold most rows: its order is cut into buckets of equal hash ranges, the sums of the buckets
    (combined before the shuffle) say which bucket has the border, and only the rows of that bucket are put in order.

    Null or empty texts have size 0, null sources form a source of their own (last in order), rows with a null id are placed by their texts,
    rows that repeat count each for itself, and an empty table gives no rows. Other columns are ignored.
    """
    rows = checkpoint(_measured(docs, seed).select("doc_id", "source", "_size", "_key", "_t"))
    told = _with_copies(rows, *_plan(rows, weights, max_epochs, bucket_words))
    return told.select(
        "doc_id", F.col("_size").alias("size"), "source", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def repeat(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 42,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with the columns of ``docs``; each row for itself, whatever its id.

    Texts are not shuffled but for those in a source's border bucket.
    """
    measured = _measured(docs, seed)
    plan, digits = _plan(checkpoint(measured.select("source", "_size", "_key")), weights, max_epochs, bucket_words)
    kept = _with_copies(measured, plan, digits).where("_copies > 0")
    return kept.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")
