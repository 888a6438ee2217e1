"""Byte-level BPE: a minimal perfect hash finds whole pre-tokens; a heap over linked bytes merges the others."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rank file that is used where no other is named.
RANKS = "byte_bpe_50k.tiktoken"

#: The pre-token pattern, with white space spelt out, for engines whose ``\s`` is ASCII only. Fixed values.
_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Characters whose class no version of Unicode has changed; texts with others are split by the ``regex`` library.
SETTLED = r"^[\x00-\u024F\u2010-\u2027\u2030-\u205E\u20AC]*$"

#: Pre-tokens of which a worker remembers the ids, and the longest it remembers (bytes): a bound on memory only.
REMEMBERED, REMEMBERED_BYTES = 1 << 18, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines with a token in Base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _mixed(hashes: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """``hashes`` scrambled by a salt (the finalizer of splitmix64)."""
    z = hashes + (np.asarray(salt).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass
class PerfectHash:
    """Hash and displace: n keys to n slots without a gap. The key's bucket tells the salt that gives its slot."""

    salts: np.ndarray
    size: int

    @classmethod
    def build(cls, hashes: np.ndarray, load: int = 4) -> PerfectHash:
        """``hashes``: distinct uint64 hashes of the keys. Large buckets are placed first; deterministic."""
        n = len(hashes)
        salts = np.zeros(max(1, n // load), np.int64)
        bucket = (_mixed(hashes, 0) % np.uint64(len(salts))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=len(salts))
        ends = np.cumsum(counts)
        taken = np.zeros(n, bool)
        for b in np.argsort(-counts, kind="stable"):
            if not counts[b]:
                break
            keys = hashes[order[ends[b] - counts[b] : ends[b]]]
            first = 1
            while True:  # many salts at once
                tried = np.arange(first, first + 256)
                slots = (_mixed(keys[None, :], tried[:, None]) % np.uint64(n)).astype(np.int64)
                good = ~taken[slots].any(axis=1)
                for k in np.flatnonzero(good):
                    if len(set(slots[k].tolist())) == len(keys):
                        break
                else:
                    first += 256
                    continue
                salts[b], taken[slots[k]] = tried[k], True
                break
        return cls(salts, n)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; of a hash that is no key's, any."""
        bucket = (_mixed(hashes, 0) % np.uint64(len(self.salts))).astype(np.int64)
        return (_mixed(hashes, self.salts[bucket]) % np.uint64(self.size)).astype(np.int64)


class Tokenizer:
    """Encoder and decoder over a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        from xxhash import xxh64_intdigest

        self.ranks = ranks
        self.digest = xxh64_intdigest
        tokens = list(ranks)
        hashes = np.array([xxh64_intdigest(t) for t in tokens], np.uint64)
        self.perfect = PerfectHash.build(hashes)
        slots = self.perfect.slots(hashes).tolist()
        self.token_at: list[bytes] = [b""] * len(tokens)
        for token, slot in zip(tokens, slots, strict=True):
            self.token_at[slot] = token
        self.id_at = [ranks[t] for t in self.token_at]
        self.token_of = {rank: token for token, rank in ranks.items()}

    def whole(self, pieces: list[bytes]) -> list[int]:
        """The id of each pre-token that is a token itself, by the perfect hash; -1 for the others."""
        if not pieces:
            return []
        slots = self.perfect.slots(np.fromiter(map(self.digest, pieces), np.uint64, len(pieces))).tolist()
        return [self.id_at[s] if self.token_at[s] == p else -1 for p, s in zip(pieces, slots, strict=True)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token by merges: the lowest rank first, of equal ranks the leftmost.

        The parts are a list over the bytes, linked both ways (``end`` and ``ahead``); the pairs that may merge wait in a heap; a pair that has changed since
        is passed over. So a pre-token of n bytes takes O(n log n), whatever its length.
        """
        ranks, n = self.ranks, len(piece)
        ahead = list(range(-1, n))
        end = list(range(1, n + 1))
        heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] or n
            if j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                ahead[stop] = i
                if (rank := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (h := ahead[i]) >= 0 and (rank := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (rank, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode_pieces(self, pieces: list[bytes], memory: dict[bytes, list[int]]) -> list[list[int]]:
        """The ids of each pre-token; ``memory`` is looked into first and kept bounded."""
        out: list[list[int] | None] = [memory.get(p) for p in pieces]
        missing = [k for k, ids in enumerate(out) if ids is None]
        for k, rank in zip(missing, self.whole([pieces[k] for k in missing]), strict=True):
            out[k] = [rank] if rank >= 0 else self.merge(pieces[k])
            if len(pieces[k]) <= REMEMBERED_BYTES:
                memory[pieces[k]] = out[k]
        if len(memory) > REMEMBERED:
            memory.clear()
        return out

    def decode(self, ids: Iterator[int]) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))


@lru_cache(maxsize=2)
def split_pattern():
    import regex

    return regex.compile(SPLIT)


def pieces_of(text: str) -> list[str]:
    """The pre-tokens of a text."""
    return split_pattern().findall(text)


class Batches:
    """Encodes lists of pre-tokens, a batch of texts at a time."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.memory: dict[bytes, list[int]] = {}
        lengths = [len(tokenizer.token_of.get(i, b"")) for i in range(max(tokenizer.token_of, default=-1) + 1)]
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokenizer.token_of.get(i, b"") for i in range(len(lengths))), np.uint8)

    def encode(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); each different pre-token of the batch is encoded once."""
        flat = pc.dictionary_encode(pieces.flatten().cast(pa.binary()))
        found = self.tokenizer.encode_pieces(flat.dictionary.to_pylist(), self.memory)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        starts = np.cumsum(lengths) - lengths
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        each = lengths[codes]
        at = np.repeat(starts[codes] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        counts = np.asarray(pc.fill_null(pc.list_value_length(pieces), 0)).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(counts)])
        sums = np.concatenate([[0], np.cumsum(each)])
        return ids[at], sums[edges[1:]] - sums[edges[:-1]]

    def decode(self, ids: np.ndarray) -> bytes:
        each = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        return self.bytes[at].tobytes()


def _tokenizer(spark: SparkSession, path: str):
    """The tokenizer of a rank file, a vocabulary of fixed size, built by the driver and broadcast."""
    return spark.sparkContext.broadcast(Tokenizer(read_ranks(path)))


def encode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False) -> DataFrame:
    """``columns`` of every row of ``docs`` (text) with its token ids; no special tokens.

    ``path``: a rank file. With ``ids`` the column ``ids`` (array of int); with ``digests`` the columns n_tokens, ids_sha256 (of the ids
    as little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes that the ids decode to).

    Texts are split into pre-tokens by Spark's own regular expressions where every character's class is the same in
    all versions of Unicode, else by the ``regex`` library; then batches of pre-tokens go to Python as Arrow columns, where
    each different one is encoded once. Whole texts are encoded, in one pass, without a shuffle. Null and empty texts have no
    tokens; repeated rows are returned each; an empty table gives no rows; other columns are ignored.
    """
    from hashlib import sha256

    shared = _tokenizer(docs.sparkSession, path)
    text = F.coalesce(F.col("text"), F.lit(""))
    settled = text.rlike(SETTLED)
    told = docs.select(
        *columns,
        F.when(settled, F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_pieces"),
        F.when(~settled, text).alias("_text"),
    )
    kept = told.select(*columns).schema
    extra = ["ids array<int>"] * ids + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Batches(shared.value)
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                pieces, unsettled = batch.column("_pieces"), batch.column("_text")
                if unsettled.null_count < len(unsettled):
                    both = zip(pieces.to_pylist(), unsettled.to_pylist(), strict=True)
                    pieces = pa.array([p if t is None else pieces_of(t) for p, t in both], pa.list_(pa.string()))
                found, counts = coder.encode(pieces)
                ends = np.cumsum(counts)
                out = [batch.column(c) for c in columns]
                if ids:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    out.append(pa.ListArray.from_arrays(offsets, pa.array(found.astype(np.int32))))
                if digests:
                    each = [found[a:b] for a, b in zip(ends - counts, ends, strict=True)]
                    out += [pa.array(counts), pa.array([sha256(x.astype("<u4").tobytes()).hexdigest() for x in each])]
                    out.append(pa.array([sha256(coder.decode(x)).hexdigest() for x in each]))
                yield pa.RecordBatch.from_arrays(out, names=[*columns, *(x.split()[0] for x in extra)])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields] + extra
    return told.mapInArrow(run, ", ".join(fields))


def decode(encoded: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row of ``encoded`` (ids) with ``bytes``, what its ids decode to; null ids give no bytes.

    An id that the vocabulary lacks fails the query.
    """
    shared = _tokenizer(encoded.sparkSession, path)
    kept = encoded.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        for batch in batches:
            out = pa.array([tokenizer.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), out], names=[*columns, "bytes"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields] + ["bytes binary"]
    return encoded.select(*columns, "ids").mapInArrow(run, ", ".join(fields))


def ranks_path() -> str:
    """The place of the default rank file: of the folder in MILLRACE_TOKENIZERS, or else of the public tokenizers installed."""
    if folder := os.environ.get("MILLRACE_TOKENIZERS"):
        return os.path.join(folder, RANKS)
    import public_tokenizers

    return public_tokenizers.path(RANKS)
