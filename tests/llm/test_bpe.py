"""Byte-level BPE against the tiktoken library, and round trips."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from millrace.llm import bpe  # noqa: E402

ALPHABET = " \n\t 'sdlaéŠ²½ß…–€中🙂́٣#!\xa0  ᠎​﻿\x85\x1cÅ"


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(bpe.read_ranks(bpe.ranks_path()))


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def texts():
    rng = random.Random(6)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(400)]
    return [*made, "", " ", "  a", "a  ", "it's we'll I'D", "<|endoftext|>", "a" * 9000, "日本語 １２３", "x\x00y", "word " * 5000, " \n\n\t "]


def test_perfect_hash(own):
    tokens = list(own.ranks)
    assert own.perfect.size == len(tokens) and own.whole(tokens) == [own.ranks[t] for t in tokens]
    assert own.whole([b"surely not a token of any vocabulary", b""]) == [-1, -1]
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 1000):
        hashes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        assert sorted(bpe.PerfectHash.build(hashes).slots(hashes)) == list(range(n))


def test_merges(own, other):
    for text in texts():
        for piece in bpe.pieces_of(text):
            assert own.merge(piece.encode()) == other.encode_ordinary(piece) or len(bpe.pieces_of(piece)) > 1


def test_same_ids_and_round_trip(spark, other):
    rows = [(i, t, [9]) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, (900, None, [1]), (900, None, [1])], "doc_id long, text string, ids array<int>")
    found = bpe.encode(docs, bpe.ranks_path()).collect()
    ids = {r.doc_id: r.ids for r in found}
    assert len(found) == len(rows) + 2 and ids[900] == []
    for i, t, _ in rows:
        assert ids[i] == other.encode_ordinary(t), repr(t[:50])
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs, bpe.ranks_path()), bpe.ranks_path()).collect()}
    assert all(back[i] == t.encode() for i, t, _ in rows)
    assert bpe.encode(docs.limit(0), bpe.ranks_path()).count() == 0


def test_digests(spark, other):
    import hashlib
    import struct

    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in bpe.encode(docs, bpe.ranks_path(), ids=False, digests=True).collect():
        text = rows[r.doc_id][1]
        ids = other.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
