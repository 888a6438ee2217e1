"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, words

#: Words to a window, when looking for repeats within a text.
WINDOW = 8
#: Of single words and of two words in a row, half and half.
BUCKETS = 1 << 16
#: Weight of the raw corpus as a prior of the target, in n-grams: buckets that the target lacks tell little.
PRIOR = 65_536.0
#: Mean log ratio a text needs.
THRESHOLD = -0.2

_BLANK = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def repeat_words(hashes: Column, n: Column) -> Column:
    """Words covered by the windows that are found twice or more; ``hashes``: of the words, ``n``: their number.

    Windows are told apart by 64-bit hashes over the hashes of their words. Where some are equal, the starts of equal ones,
    found by sorting, cover ``WINDOW`` words or as many as there are to the next such start.
    """
    last = n - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    def starts_of_repeats(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        marked = bind(pairs, lambda p: F.transform(p, lambda x, k: F.when((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"])))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return bind(
        windows,
        lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(
            bind(starts_of_repeats(found), covered)
        ),
    )


def n_grams(found: Column, buckets: int) -> Column:
    """The buckets of the words of an array (the lower half) and of each word with the next, the last with none (the upper half)."""
    half = F.lit(buckets // 2)
    ones = F.transform(found, lambda w: F.pmod(F.xxhash64(w), half).cast("int"))
    twos = F.transform(found, lambda w, i: (F.pmod(F.xxhash64(w, F.get(found, i + 1)), half) + half).cast("int"))
    return F.concat(ones, twos)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """The log ratio of target to raw frequency of every bucket, from all of ``docs`` (doc_id, text).

    Raw: all texts. Target: the texts whose id is in ``trusted`` (doc_id). The target is smoothed towards the raw corpus by
    ``prior`` n-grams, the raw corpus by one n-gram a bucket. Counts are combined before the shuffle; ``buckets`` rows
    come to the driver, whatever the input. Without trusted texts every ratio is 0.
    """
    ids = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_trusted")).distinct()
    # labels have no size bound, so they are never broadcast
    told = docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == F.col("_trusted"), "left")
    grams = bind(words(F.col("text")), lambda w: n_grams(w, buckets))
    each = told.select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode(grams).alias("bucket"))
    found = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).toArrow()  # rows would be large in the driver
    raw, target = [1] * buckets, [0] * buckets
    for bucket, n, of_target in zip(*(c.to_pylist() for c in found.columns), strict=True):
        raw[bucket] += n
        target[bucket] = of_target
    all_raw, all_target = sum(raw), sum(target)
    shares = [n / all_raw for n in raw]
    return [math.log((t + prior * p) / (all_target + prior) / p) for t, p in zip(target, shares, strict=True)]


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    prior: float = PRIOR,
    columns: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``columns`` of every row of ``docs`` (doc_id, text) with its counts and whether it is kept.

    Counts: n_words, word_chars (code points in words), n_symbols (characters of ``#*$%&|<>``), n_dup_lines (lines with
    a word that equal an earlier line), n_repeat_words (words in windows of 8 found twice or more). ``base_failed``: under 20 words, or
    over 30 % repeated ones. ``llr``: the mean log ratio (``log_ratios``) of the text's n-grams, 0 for no words.
    ``kept``: not ``base_failed`` and ``llr`` at ``threshold`` or above; the same for every row, without a sample.

    The text is read twice and shuffled once, to be told trusted or not; the scores need no shuffle: the table of ratios has a fixed size and
    is a constant of the plan. Null texts have no words. Repeated rows and ids count and are returned each; a null id is
    never trusted. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    ratios = log_ratios(docs, trusted, buckets, prior)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = lambda c: F.char_length(c).cast("long")
    bare = F.translate(text, _BLANK, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANK, "") != "")

    def measured(w: Column) -> Column:
        n = F.size(w)
        total = F.aggregate(n_grams(w, buckets), F.lit(0.0), lambda a, b: a + F.get(table, b))
        return F.struct(
            n.cast("long").alias("n_words"),
            bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: repeat_words(h, n)).alias("n_repeat_words"),
            F.when(n == 0, F.lit(0.0)).otherwise(total / (2 * n)).alias("llr"),
        )

    told = docs.select(
        *columns,
        size(bare).alias("word_chars"),
        (size(text) - size(F.translate(text, _SYMBOLS, ""))).alias("n_symbols"),
        bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        bind(words(F.col("text")), measured).alias("_m"),
    )
    told = told.select(*columns, "_m.n_words", "word_chars", "n_symbols", "n_dup_lines", "_m.n_repeat_words", "_m.llr")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return told.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids that ``labels`` (doc_id, quality) marks as good at least once."""
    return labels.where(F.col("quality") == 1).select("doc_id").distinct()
