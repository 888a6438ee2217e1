"""Chat formatting: quotations linked to the messages they quote, conversations in reply order without quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: A quote prefix: levels of ``>``, each with white space around.
PREFIX = r"^[ \t]*(>[ \t>]*)"
_PREFIX, _BREAK, _SPACE = re.compile(PREFIX), re.compile("\r\n?|\n"), re.compile(r"\s+", re.ASCII)
#: Turns to a range of a conversation that one task puts in order.
TURNS = 1024
#: A line that only introduces a quotation.
INTRODUCTION = r"(?i)^[ \t]*(on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb\b.{0,80}|le\b.{0,200}a écrit|el\b.{0,200}escribió)[ \t]*:[ \t]*$"


def units_of(text: str) -> set[tuple[int, int, str]]:
    """(level, kind, text) of a message: of its lines (kind 0) and of its passages (kind 1), the runs of lines of one level without a blank one
    between, set as one line. Level: how many ``>`` the prefix has, 0 for the message's own words. In lower case, white space made one space."""
    out, passage, last = set(), [], -1
    for line in _BREAK.split(text):
        prefix = _PREFIX.match(line)
        level = prefix[1].count(">") if prefix else 0
        bare = _SPACE.sub(" ", (line[prefix.end() :] if prefix else line).lower()).strip(" ")
        if passage and (level != last or not bare):
            out.add((last, 1, " ".join(passage)))
            passage = []
        if bare:
            out.add((level, 0, bare))
            passage.append(bare)
        last = level
    if passage:
        out.add((last, 1, " ".join(passage)))
    return out


def units(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, kind, a, b) for each different unit of ``messages`` (conv_id, turn, text); a, b: the halves of a hash of its text."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                sizes, levels, kinds, names = [], [], [], []
                for text in batch.column("text").to_pylist():
                    found = units_of(text)
                    sizes.append(len(found))
                    for level, kind, unit in found:
                        levels.append(level)
                        kinds.append(kind)
                        names.append(xxh3_128_digest(unit.encode("utf-8", "surrogatepass")))
                halves = np.frombuffer(b"".join(names), ">i8").reshape(-1, 2).astype(np.int64)
                conv, turn = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("conv_id", "turn"))
                columns = [conv, turn, np.array(levels, np.int64), np.array(kinds, np.int64), halves[:, 0], halves[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["conv_id", "turn", "level", "kind", "a", "b"])

    told = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    told = told.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull())
    return told.mapInArrow(run, "conv_id long, turn long, level long, kind long, a long, b long")


def originals(found: DataFrame) -> DataFrame:
    """(conv_id, turn, level, kind, source): for each quoted unit of ``found`` the latest earlier message of its conversation that wrote it itself.

    Turns are cut into ranges of ``TURNS``, so that a unit that a whole conversation repeats is not put in order by one task: a range takes over the
    last writer of the ranges before, one row each, and is put in order by itself. Units that nobody quotes go no further than that.
    """
    unit = ["conv_id", "kind", "a", "b"]
    told = found.withColumn("range", F.floor(F.col("turn") / TURNS)).distinct()
    writes = F.when(F.col("level") == 0, F.col("turn"))
    ranges = told.groupBy(*unit, "range").agg(F.max(writes).alias("last"), F.max(F.col("level") > 0).alias("quoted"))
    before = Window.partitionBy(*unit).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.max("last").over(before)).withColumn("quoted", F.max("quoted").over(Window.partitionBy(*unit)))
    told = told.join(ranges.where("quoted").select(*unit, "range", "before"), [*unit, "range"])
    inside = Window.partitionBy(*unit, "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("source", F.coalesce(F.max(writes).over(inside), F.col("before")))
    return told.where((F.col("level") > 0) & F.col("source").isNotNull()).select("conv_id", "turn", "level", "kind", "source")


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, reply_to, thread, depth, position, n_quoted) for each row of ``messages`` (conv_id, turn, role, text).

    ``text``: without quoted lines and the lines that only introduce a quotation, outer blank lines cut. ``reply_to``: the turn
    of the message of the same conversation that this one quotes. Quoted passages (``units_of``), set as one line so that a quotation that was wrapped anew is
    found, are hashed and joined to the passages that messages wrote themselves: to the latest earlier one. The message with most of the passages is
    quoted; of equal ones the latest. Lines count where no whole passage of a level is found. Deeper levels than the outermost quote what that
    message quotes, and count only if no level above has an original. Null if there is none.
    ``thread``: the turn that the chain of replies starts with, ``depth``: the links to it, ``position``: how many messages of the thread come before, in
    order of turn. In order of conv_id, thread and position, every message stands behind the one it replies to. ``n_quoted``: its quoted lines with text.

    No conversation is gathered into a row or task; chains of replies are followed by doubling, in as many rounds as the logarithm of the longest chain.

    Null texts have an empty text and no quotes; messages with a null conv_id or turn are returned as they are without a link, at position 0; rows that
    repeat a (conv_id, turn) are cut each and linked as one; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    votes = originals(units(messages)).groupBy("conv_id", "turn", "level", "kind", "source").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("outer"), "kind", "n", "source"))
    parents = checkpoint(votes.groupBy("conv_id", "turn").agg(best.alias("best")).select("conv_id", "turn", F.col("best.source").alias("reply_to")))
    told = messages.select("conv_id", "turn", "role", unquoted(F.col("text")).alias("text"), quoted_lines(F.col("text")).alias("n_quoted"))
    placed = _positions(messages, parents, _roots(parents))
    told = told.join(placed, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return told.select(
        "conv_id", "turn", "role", "text", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", zero).alias("depth"), F.coalesce("position", zero).alias("position"), "n_quoted",
    )


def _positions(messages: DataFrame, parents: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth, position) for each (conv_id, turn); threads are numbered by ranges of turns, as in ``originals``."""
    each = messages.select("conv_id", "turn").where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).distinct()
    told = each.join(parents, ["conv_id", "turn"], "left").join(chains, ["conv_id", "turn"], "left")
    told = told.withColumn("thread", F.coalesce("thread", "turn")).withColumn("range", F.floor(F.col("turn") / TURNS))
    thread = ["conv_id", "thread"]
    sizes = told.groupBy(*thread, "range").agg(F.count(F.lit(1)).alias("n"))
    before = (F.sum("n").over(Window.partitionBy(*thread).orderBy("range")) - F.col("n")).alias("before")
    told = told.join(sizes.select(*thread, "range", before), [*thread, "range"])
    inside = F.row_number().over(Window.partitionBy(*thread, "range").orderBy("turn")) - 1
    return told.select("conv_id", "turn", "reply_to", "thread", "depth", (F.col("before") + inside).alias("position"))


def quoted_lines(text: Column) -> Column:
    """How many quoted lines with text a message has."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.size(F.filter(lines, lambda x: x.rlike(PREFIX) & (F.regexp_replace(x, f"{PREFIX}|[ \t\x0b\f]", "") != ""))).cast("long")


def unquoted(text: Column) -> Column:
    """A text without its quoted lines and the lines that introduce them; an introduction goes only if a quoted line follows."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    cut = F.regexp_replace(whole, INTRODUCTION.replace("(?i)", "(?im)").replace("$", r"\n(?=\s*>)"), "")
    own = F.filter(F.split(cut, "\n"), lambda x: ~x.rlike(PREFIX))
    return F.rtrim(F.regexp_replace(F.array_join(own, "\n"), r"^(?:[ \t]*\n)+", ""), F.lit(" \t\n"))


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) for each link of ``parents`` (conv_id, turn, reply_to), by doubling."""
    now = checkpoint(parents.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        ahead = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_thread"), F.col("depth").alias("_depth"))
        longer = now.join(ahead, ["conv_id", "thread"], "left")
        if longer.where(F.col("_thread").isNotNull()).isEmpty():
            return now
        now = checkpoint(longer.select("conv_id", "turn", F.coalesce("_thread", "thread").alias("thread"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
