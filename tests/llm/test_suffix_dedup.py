"""Suffix sorting and removal of repeats against brute force."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm.suffix_dedup import remove_repeats
from millrace.llm.suffixes import COVER, PERIOD, Suffixes


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("seed", range(12))
def test_order(seed):
    rng, pieces = random.Random(seed), []
    for _ in range(rng.randrange(1, 10)):
        text = bytes(rng.choice(rng.choice([b"a", b"ab", b"abcdef \0"])) for _ in range(rng.randrange(40, 250)))
        pieces.append(rng.choice([text, b"a" * len(text), (pieces[0][rng.randrange(40) :] + text[:60]) if pieces else text]))
    ends = np.cumsum([len(p) for p in pieces])
    found = Suffixes(np.frombuffer(b"".join(pieces), np.uint8), ends)
    at = np.concatenate([np.arange(e - len(p), e - 39) for p, e in zip(pieces, ends, strict=True)])
    order = at[found.sort(at, np.zeros(len(at), np.int64))]
    suffixes = [b"".join(pieces)[a : found.end_of[a]] for a in order]
    assert suffixes == sorted(suffixes)
    assert found.same_prefix(order, 40).tolist() == [False, *(a[:40] == b[:40] for a, b in zip(suffixes, suffixes[1:], strict=False))]


def brute(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(left).hexdigest(), left))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("pqrstuv wé") for _ in range(n))
    base = [noise(rng.randrange(900)) for _ in range(15)]
    out = []
    for i in range(120):
        b = rng.choice(base)
        k = rng.randrange(len(b) + 1)
        text = rng.choice([b, b[:k] + "X" + b[k:], rng.choice(base) + b, rng.choice(["a", "ab", "abc "]) * rng.randrange(400), noise(rng.randrange(40)) + base[0][:300] + noise(150), b[k // 3 :] * 2, None, noise(500), ""])
        out.append((rng.choice([i, i, i, i // 2]) if i < 117 else None, text))
    return out


@pytest.mark.parametrize(("length", "hot"), [(100, 4096), (100, 2), (40, 3), (31, 4096)])
def test_removed_bytes(spark, length, hot):
    rows = corpus(length + hot)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")
    found = remove_repeats(docs, length, digest=True, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    assert sorted(((*r[:5], bytes(r[5])) for r in found), key=str) == brute(rows, length)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 30)
