"""Removal of byte strings that occur earlier in the corpus, by blockwise suffix sorting with a difference cover.

Suffixes whose first ``length`` bytes are equal must be found, over all documents, without holding them all. They are dealt to suffix
buckets by the minimizer of these bytes (the least hash of the short strings within), so that runs of neighbouring suffixes
share a bucket and move as one segment of text. Buckets with a single segment hold no repeat and segments that are equal as a
whole need no sorting; only the segments that share a bucket but differ are sorted, block by block, by ``suffixes.Suffixes``.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .suffixes import PERIOD, Suffixes

#: Bytes of the short strings whose hashes are compared.
SHORT = 32
#: Bytes of text to a block, about, and to a piece of a block that is hashed at once.
BLOCK, PIECE = 8 << 20, 1 << 20
#: Different segments of one bucket beyond which its suffixes are dealt one by one, by all of their bytes.
HOT = 4096
#: Bytes of segments that are sorted at once, about.
SORTED = 4 << 20

_LAST = np.iinfo(np.int64).max


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.uint64, np.uint64]:
    """A random number for each byte, an odd base, and its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    return np.random.default_rng(12345).integers(0, 1 << 64, 256, dtype=np.uint64), np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        _, base, inverse = _tables()
        made = []
        for b in (base, inverse):
            steps = np.full(max(n, PIECE + 4096), b)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers = made[0], made[1]
    return _powers


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


class Hashes:
    """Hashes of any strings of some text, from sums over its prefixes."""

    def __init__(self, text: np.ndarray):
        table, _, _ = _tables()
        powers, self.inverse = _powers_to(len(text) + 1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(table[text] * powers[: len(text)], out=self.sums[1:])

    def of(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        found = (self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts]
        return _mix(found ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def each(self, length: int) -> np.ndarray:
        """Of the strings of one length at all places."""
        return _mix((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbours, from each place on."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


@dataclass
class Segments:
    """Runs of suffix starts with one minimizer; ``start``: in the block, ``count``: of suffixes, ``loop``: whether suffixes of one
    segment may be equal."""

    start: np.ndarray
    count: np.ndarray
    minimizer: np.ndarray
    digest: np.ndarray
    loop: np.ndarray


class Block:
    """The documents of one block, in order of id (null last), equal ids in order of text."""

    def __init__(self, table: pa.Table, length: int):
        ids = pc.fill_null(table.column("doc_id"), _LAST)
        text = pc.fill_null(table.column("text").cast(pa.binary()), b"")
        order = pc.sort_indices(pa.table({"i": ids, "t": text}), sort_keys=[("i", "ascending"), ("t", "ascending")])
        self.doc_ids = table.column("doc_id").take(order)
        self.ids = ids.take(order).to_numpy()
        texts = text.take(order).to_pylist()
        self.length = length
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def row_of(self, places: np.ndarray) -> np.ndarray:
        """The document each place lies in."""
        return np.searchsorted(self.ends, places, side="right")

    def pieces(self):
        """(first, last, start) of runs of documents of about ``PIECE`` bytes."""
        first = 0
        while first < len(self.ends):
            last = max(first + 1, int(np.searchsorted(self.ends, self.begins[first] + PIECE, side="right")))
            yield first, last, int(self.begins[first])
            first = last

    def segments(self) -> Segments:
        """All suffixes with ``length`` bytes or more, in runs."""
        width = self.length - min(SHORT, self.length) + 1
        found: list[tuple[np.ndarray, ...]] = []
        for first, last, low in self.pieces():
            text = self.text[low : int(self.ends[last - 1])]
            if len(text) < self.length:
                continue
            hashes = Hashes(text)
            short = hashes.each(min(SHORT, self.length))
            least = _least(short, width)
            edges = np.zeros(len(text) + 1, np.int32)
            ok = self.ends[first:last] - self.begins[first:last] >= self.length
            np.add.at(edges, self.begins[first:last][ok] - low, 1)
            np.add.at(edges, self.ends[first:last][ok] - low - self.length + 1, -1)
            at = np.flatnonzero(np.cumsum(edges[:-1])[: len(least)])
            if not len(at):
                continue
            value = least[at]
            goes_on = np.zeros(len(at), bool)
            goes_on[1:] = (at[1:] == at[:-1] + 1) & (value[1:] == value[:-1])
            run = np.flatnonzero(~goes_on)
            inside = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            start = np.flatnonzero(inside % width == 0)
            count = np.diff(np.append(start, len(at)))
            leaves = np.zeros(len(at), bool)
            leaves[:-1] = goes_on[1:] & (short[at[:-1]] == value[:-1])
            loop = np.add.reduceat(leaves, start) > 0
            place = at[start]
            found.append((place + low, count, value[start], hashes.of(place, count + self.length - 1), loop))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, bool)]
        return Segments(*columns)

    def bytes_at(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The strings at ``starts``, one behind the other."""
        begin = np.cumsum(lengths) - lengths
        return self.text[np.repeat(starts - begin, lengths) + np.arange(int(lengths.sum()))]


def _firsts(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """(order by minimizer, digest and place; whether a segment in that order is the first of its kind)."""
    order = np.lexsort((s.digest, s.minimizer))
    new = np.ones(len(order), bool)
    a, b = s.minimizer[order], s.digest[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _kinds(s: Segments, buckets: int):
    """The different segments of a block (index of the first, whether any of them loops) in order of bucket, minimizer and digest, and
    the edges of the buckets."""
    order, new = _firsts(s)
    first = order[new]
    loop = np.add.reduceat(s.loop[order], np.flatnonzero(new)) > 0 if len(first) else np.empty(0, bool)
    bucket = (s.minimizer[first] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return order, new, first[by], loop[by], np.searchsorted(bucket[by], np.arange(buckets + 1))


def _pack(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(payload: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.Codec("zstd").decompress(payload[8:], decompressed_size=int.from_bytes(payload[:8], "little"), asbytes=True))


def _rows(schema: list[str], rows: list[tuple]) -> pa.Table:
    kinds = {"payload": pa.binary(), "kept": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(schema, columns, strict=True)], names=schema)


def remove_repeats(docs: DataFrame, length: int = 100, kept: bool = True, digest: bool = False, block_bytes: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept?, kept_sha256?) for every row of ``docs`` (doc_id, text).

    A byte of a text in UTF-8 is removed if a string of ``length`` bytes covers it that also starts earlier: in a text of smaller doc_id, or
    before in the same text. Strings are judged on the input and never cross texts. ``n_spans``: maximal removed runs; ``kept``:
    the other bytes; ``kept_sha256``: their SHA-256.

    1. Documents are dealt to blocks by id. A block cuts its suffixes into segments and gives a hash of each different one to its bucket.
    2. A bucket finds which of its segments were first, in order of documents, and which differ but share a minimizer.
    3. A block, told so, marks the suffixes of segments that came earlier, and sends out the text of those that must be sorted.
    4. Suffixes of a bucket are sorted with a difference cover, a bounded number of buckets at a time; of equal ones the first stays.
    5. A block joins the marks of each text and cuts.

    Copies of a segment collapse within a block before anything moves, so a passage that a third of the texts share is one row a block.
    A bucket with over ``hot`` different segments (contexts of one passage) deals its suffixes one by one by hashes of all their
    bytes, so that its work spreads. Blocks have about ``block_bytes``, whatever the number of documents. Which short strings and segments are equal is
    told by hashes of 64 and 128 bits.

    Null texts are empty; texts shorter than ``length`` stay whole; null ids come last; rows with one id are separate texts, in order of
    text; ``length`` under 31 is an error; an empty table gives no rows; other columns are ignored.
    """
    from hashlib import sha256

    if length < PERIOD:
        raise ValueError(f"length must be {PERIOD} or more")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = shuffle_partitions(docs.sparkSession)
    n_blocks = max(2 * wide, -(-total // block_bytes))
    n_buckets = max(2 * wide, n_blocks // 8)
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n_blocks)).alias("block")
    told = docs.select(block, F.col("doc_id").cast("long").alias("doc_id"), "text")

    def hash_block(key: tuple, table: pa.Table) -> pa.Table:
        own = Block(table, length)
        s = own.segments()
        _, _, first, loop, edges = _kinds(s, n_buckets)
        ids = own.ids[own.row_of(s.start[first])]
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            rows.append((key[0].as_py(), int(b), _pack(s.minimizer[first[part]], s.digest[first[part]], ids[part], loop[part])))
        return _rows(["block", "bucket", "payload"], rows)

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        """What becomes of each segment: 0 nothing, 1 it was earlier elsewhere, 2 to be sorted, 3 to be sorted suffix by suffix."""
        found = [_unpack(p) for p in table.column("payload").to_pylist()]
        sizes = np.array([len(x[0]) for x in found])
        minimizer, digest, ids, loop = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, digest, minimizer))
        m, d = minimizer[order], digest[order]
        new_bucket, new = np.ones(len(m), bool), np.ones(len(m), bool)
        new_bucket[1:] = m[1:] != m[:-1]
        new[1:] = new_bucket[1:] | (d[1:] != d[:-1])
        at = np.flatnonzero(new_bucket)
        different = np.repeat(np.add.reduceat(new, at, dtype=np.int64), np.diff(np.append(at, len(m))))
        what = np.where(~new, 1, np.where(different > hot, 3, np.where((different > 1) | loop[order], 2, 0)))
        out = np.empty(len(m), np.uint8)
        out[order] = what
        ends = np.cumsum(sizes)
        return _rows(["block", "bucket", "payload"], [(b, key[0].as_py(), _pack(out[e - n : e])) for b, e, n in zip(table.column("block").to_pylist(), ends, sizes, strict=True)])

    def mark(key: tuple, table: pa.Table, judged: pa.Table) -> pa.Table:
        """Runs of removed suffixes (kind 0, key: the block) and segments to be sorted (kind 1, key: a bucket)."""
        if not table.num_rows:
            return _rows(["kind", "key", "block", "payload"], [])
        own, here = Block(table, length), key[0].as_py()
        s = own.segments()
        order, new, first, _, edges = _kinds(s, n_buckets)
        what = np.zeros(len(first), np.uint8)
        for b, payload in zip(judged.column("bucket").to_pylist(), judged.column("payload").to_pylist(), strict=True):
            what[edges[b] : edges[b + 1]] = _unpack(payload)[0]
        runs = [(s.start[order[~new]], s.count[order[~new]])]
        runs.append((s.start[first[what == 1]], s.count[first[what == 1]]))
        sent = first[what == 2]
        parts = [(s.minimizer[sent], s.start[sent], s.count[sent])]
        single = first[what == 3]
        if len(single):
            counts = s.count[single]
            at = np.sort(np.repeat(s.start[single] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum())))
            hashes = np.empty(len(at), np.uint64)
            for _, last, low in own.pieces():
                high = int(own.ends[last - 1])
                inside = slice(np.searchsorted(at, low), np.searchsorted(at, high))
                if inside.start < inside.stop:
                    hashes[inside] = Hashes(own.text[low:high]).of(at[inside] - low, np.full(inside.stop - inside.start, length))
            _, firsts = np.unique(hashes, return_index=True)
            later = np.ones(len(at), bool)
            later[firsts] = False
            runs.append((at[later], np.ones(int(later.sum()), np.int64)))
            parts.append((hashes[~later], at[~later], np.ones(len(firsts), np.int64)))
        run_at, run_n = (np.concatenate(x) for x in zip(*runs, strict=True))
        row = own.row_of(run_at)
        out = [(0, here, here, _pack(row, run_at - own.begins[row], run_n))] if len(row) else []
        name, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = (name % np.uint64(n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        name, start, count, cuts = name[by], start[by], count[by], np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        row = own.row_of(start)
        for b in np.flatnonzero(np.diff(cuts)):
            p = slice(cuts[b], cuts[b + 1])
            text = own.bytes_at(start[p], count[p] + length - 1)
            out.append((1, int(b), here, _pack(name[p], own.ids[row[p]], row[p], start[p] - own.begins[row[p]], count[p], text)))
        return _rows(["kind", "key", "block", "payload"], out)

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        """Runs of suffixes that come after an equal one; runs already known pass through."""
        if key[0].as_py() == 0:
            return table.select(["block", "payload"])
        found = [_unpack(p) for p in table.column("payload").to_pylist()]
        blocks = np.repeat(np.array(table.column("block").to_pylist()), [len(x[0]) for x in found])
        name, ids, row, start, count, text = (np.concatenate(x) for x in zip(*found, strict=True))
        size = count + length - 1
        begin = np.cumsum(size) - size
        order = np.argsort(name, kind="stable")
        marks: list[tuple[np.ndarray, ...]] = []
        ends = np.cumsum(size[order])
        cuts = np.append(np.flatnonzero(name[order][1:] != name[order][:-1]) + 1, len(order))
        low = 0
        while low < len(order):  # whole buckets, SORTED bytes at once
            enough = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SORTED, side="right"))
            fit = cuts[(cuts > low) & (cuts <= enough)]
            high = int(fit[-1]) if len(fit) else int(cuts[np.searchsorted(cuts, low, side="right")])
            part = order[low:high]
            low = high
            n, own = size[part], np.cumsum(size[part]) - size[part]
            sorter = Suffixes(text[np.repeat(begin[part] - own, n) + np.arange(int(n.sum()))], np.cumsum(n))
            piece = np.repeat(np.arange(len(part)), count[part])
            inside = np.arange(len(piece)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            at = own[piece] + inside
            by = sorter.sort(at, name[part][piece])
            equal = sorter.same_prefix(at[by], length)
            equal[1:] &= name[part][piece[by]][1:] == name[part][piece[by]][:-1]
            group = np.cumsum(~equal)
            where = part[piece[by]]
            place = start[where] + inside[by]
            ranked = np.lexsort((place, row[where], ids[where], group))
            after = np.zeros(len(by), bool)
            after[1:] = group[ranked][1:] == group[ranked][:-1]
            removed = ranked[after]
            marks.append((blocks[where[removed]], row[where[removed]], place[removed]))
        block_, row_, place_ = (np.concatenate(x) for x in zip(*marks, strict=True))
        by = np.lexsort((place_, row_, block_))
        block_, row_, place_ = block_[by], row_[by], place_[by]
        new = np.ones(len(by), bool)
        new[1:] = (block_[1:] != block_[:-1]) | (row_[1:] != row_[:-1]) | (place_[1:] != place_[:-1] + 1)
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(by)))
        edges = np.append(np.flatnonzero(np.append(True, block_[first][1:] != block_[first][:-1])[: len(first)]), len(first))
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            out.append((int(block_[first[a]]), _pack(row_[first[a:b]], place_[first[a:b]], counts[a:b])))
        return _rows(["block", "payload"], out)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", *(["kept"] * kept), *(["kept_sha256"] * digest)]

    def cut(key: tuple, table: pa.Table, marked: pa.Table) -> pa.Table:
        own = Block(table, length) if table.num_rows else None
        cover = np.zeros(len(own.text) + 1 if own else 1, np.int32)
        for payload in marked.column("payload").to_pylist():
            row, place, count = _unpack(payload)
            np.add.at(cover, own.begins[row] + place, 1)
            np.add.at(cover, own.begins[row] + place + count + length - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        rises = gone.copy()
        rises[1:] &= ~gone[:-1]
        out: dict[str, list] = {n: [] for n in names}
        if own:
            rises[own.begins[own.begins < len(gone)]] = gone[own.begins[own.begins < len(gone)]]
            spans = np.concatenate([[0], np.cumsum(rises)])
            out["doc_id"] = own.doc_ids.to_pylist()
            out["n_bytes"] = (own.ends - own.begins).tolist()
            out["n_removed"] = (sums[own.ends] - sums[own.begins]).tolist()
            out["n_spans"] = (spans[own.ends] - spans[own.begins]).tolist()
            for a, b, n in zip(own.begins.tolist(), own.ends.tolist(), out["n_removed"], strict=True):
                left = own.text[a:b][~gone[a:b]].tobytes() if n else own.text[a:b].tobytes()
                if kept:
                    out["kept"].append(left)
                if digest:
                    out["kept_sha256"].append(sha256(left).hexdigest())
        kinds = {"kept": pa.binary(), "kept_sha256": pa.string()}
        return pa.table([pa.array(out[n], kinds.get(n, pa.int64())) for n in names], names=names)

    moved = "block long, bucket long, payload binary"
    hashed = told.groupBy("block").applyInArrow(hash_block, moved)
    judged = hashed.groupBy("bucket").applyInArrow(judge, moved)
    marked = told.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(mark, "kind long, key long, block long, payload binary")
    runs = marked.groupBy("kind", "key").applyInArrow(sort, "block long, payload binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long" + ", kept binary" * kept + ", kept_sha256 string" * digest
    return told.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(cut, schema)
