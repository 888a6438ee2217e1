"""SimHash, planes, components, similar documents and fuzzy lines against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from millrace.llm import bits, edits, line_dedup, meeting, similar, simhash
from millrace.llm.common import trim_native
from millrace.llm.components import connected_components


def roots(nodes, linked):
    """The smallest node reachable from each, by ``linked`` pairs."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("radius", range(6))
def test_planes(radius):
    rng = np.random.default_rng(radius)
    for n in (1, 63, 64, 65, 200):
        prints = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        for k in range(1, n, 2):
            prints[k] = prints[k - 1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)))
        found = np.unpackbits(bits.within(prints, prints, radius).view(np.uint8), axis=1, bitorder="little")[:, :n]
        assert (found == (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius)).all()


def test_masks_cover():
    rng = random.Random(0)
    for blocks, radius in ((4, 2), (5, 3)):
        cover = bits.masks(blocks, radius)
        for _ in range(500):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << k for k in rng.sample(range(64), radius))
            assert any(a & m == b & m for m in cover)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == roots(nodes, links)
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


def print_of(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdé')}{rng.randrange(400)}" for _ in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 400))] for _ in range(12)]
    out = [None, "", " \n", "A", "a", "a b", "A  B", "x " * 3000]
    while len(out) < n:
        copy = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_simhash(spark, hot, monkeypatch):
    texts = corpus(2)
    monkeypatch.setattr(simhash.links, "__defaults__", (2, hot))
    docs = spark.createDataFrame([(1000 - i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "again")], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs).collect()
    prints = {1000 - i: print_of(t) for i, t in enumerate(texts)}
    expected = roots(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert len(found) == len(texts) + 1
    assert all(r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == expected[r.doc_id] for r in found)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [4096, 4])
def test_similar_documents(spark, hot):
    texts = corpus(3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b c d e f", "y")], "doc_id long, text string, name string")
    sets = {i: set(similar.shingle_set(t, 5).tolist()) for i, t in enumerate(texts)}

    def alike(a, b):
        shared, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        return shared >= 0.8 * whole - 1e-9

    expected = roots(sets, [(a, b) for a in sets for b in sets if a < b and alike(a, b)])
    found = {r.doc_id: r.component_id for r in similar.similar_documents(docs, hot=hot).collect()}
    assert found == expected
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, *expected.values()}
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_keep_one_row(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (None, text, "c"), (None, text + " more", "d"), (None, "x y z", "e"), (None, "x y z", "e"), (3, "p q", "f"), (3, "r s", "g"), (4, "r s", "h"), (5, None, "i"), (6, "", "j")]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [(1, text), (None, "x y z"), (3, "p q"), (3, "r s"), (5, None)]))


def true_distance(con, a, b):
    return con.execute("select levenshtein(?, ?)", [a, b]).fetchall()[0][0] if a.isascii() and b.isascii() else slow_distance(a, b)


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    import duckdb

    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(14)))
    with duckdb.connect() as con:
        for _ in range(150):
            a = text()
            b = a[: rng.randrange(len(a) + 1)] + text() if rng.random() < 0.5 else text()
            for most in (0, 2, 40):
                assert edits.edit_distance(a, b, most) == min(true_distance(con, a, b), most + 1)


def changed(rng, x, letters):
    x = list(x)
    for _ in range(rng.randrange(len(x) // 3 + 2)):
        k = rng.randrange(len(x) + 1)
        x[k : k + rng.randrange(2)] = rng.choice(["", rng.choice(letters), rng.choice(letters) + " "])
    return "".join(x)


@pytest.mark.parametrize("letters", ["ab ", "abcdefgh é", "".join(chr(0x4E00 + k) for k in range(900))])
def test_alike(letters):
    rng = random.Random(len(letters))
    left = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 9, 10, 30, 64, 65, 130, 300]))) for _ in range(250)]
    right = [changed(rng, x, letters) if rng.random() < 0.8 else rng.choice(left) for x in left]
    expected = [max(len(a), len(b)) * 0.2 + 1e-9 >= slow_distance(a, b) for a, b in zip(left, right, strict=True)]
    assert 0 < sum(expected) < len(left)
    assert [edits.alike(a, b, 0.8) for a, b in zip(left, right, strict=True)] == expected


def kept_lines(rows):
    """The text that is left of each (id, text), by the edit similarity of all pairs of lines alone."""
    first = {}
    for at, (i, t) in enumerate(rows):
        for k, x in enumerate((t or "").split("\n")):
            if n := line_dedup.normalised(x):
                place = (i is None, i or 0, k, at)
                first[n] = min(first.get(n, place), place)
    names = sorted(first, key=len)
    letters = {c: k for k, c in enumerate(sorted(set("".join(names))))}
    counts = np.zeros((len(names), len(letters)), np.int64)
    for k, x in enumerate(names):
        np.add.at(counts[k], [letters[c] for c in x], 1)
    linked = []
    for b in range(len(names)):  # each letter that one has and the other lacks is an edit
        lacks = np.maximum(counts[b] - counts[:b], 0).sum(axis=1)
        linked += [(a, b) for a in np.flatnonzero(lacks <= 0.2 * len(names[b]) + 1e-9).tolist() if edits.alike(names[a], names[b], 0.8)]
    root, kept = roots(range(len(names)), linked), {}
    for k, n in enumerate(names):
        kept[root[k]] = min(kept.get(root[k], first[n]), first[n])
    number = {n: k for k, n in enumerate(names)}

    def left(at, i, t):
        lines = t.split("\n")
        stay = [x for k, x in enumerate(lines) if not (n := line_dedup.normalised(x)) or kept[root[number[n]]] == (i is None, i or 0, k, at)]
        return "\n".join(stay), len(lines) - len(stay)

    return [(None, 0) if t is None else left(at, i, t) for at, (i, t) in enumerate(rows)], len(linked)


@pytest.mark.parametrize("hot", [4096, 6])
def test_lines(spark, hot):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randrange(2, 9)))
    base = [[word() for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 10, 20, 60]))] for _ in range(40)]

    def line():
        x = list(rng.choice(base))
        k = rng.randrange(len(x))
        if rng.random() < 0.8:
            x[k] = rng.choice([word(), x[k] + "z", x[k][1:] or "q"])
        x = " ".join(x)
        return rng.choice([x, x, x.upper(), f"  {x}", "", "Share", "Shore", x + "."])

    rows = [(None if i > 40 else i, "\n".join(line() for _ in range(7))) for i in range(45)] + [(50, None), (51, ""), (52, "\n \n"), (3, "b\n" + line()), (53, "B")]
    docs = spark.createDataFrame([(i, t, "en", 7) for i, t in rows], "doc_id long, text string, key string, n_lines int")
    told = line_dedup.dedup_lines(docs, hot=hot)
    assert told.columns == ["doc_id", "text", "key", "n_lines", "n_removed_lines"]
    found = told.collect()
    # null ids are told apart by a hash of their texts, so the order among them is not told here: they are sorted as the operator sorts them
    hashes = {r.text: r.t for r in line_dedup.located(docs).collect()}
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes.get(r[1], 0)))
    expected, linked = kept_lines(rows)
    assert linked > 50
    assert sorted(map(str, ((r.doc_id, r.text, r.n_removed_lines) for r in found))) == sorted(map(str, ((i, *x) for (i, _), x in zip(rows, expected, strict=True))))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_documents(spark):
    """Against all pairs of a table's lines: nothing goes that has no like line before it, and of what has one, 0.95 goes or more."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    expected, linked = kept_lines(rows)
    assert linked >= 40
    seen, exact = set(), {}
    for i, t in rows:
        lines = [line_dedup.normalised(x) for x in (t or "").split("\n")]
        exact[i] = sum(bool(x) and (x in seen or x in lines[:k]) for k, x in enumerate(lines))
        seen.update(lines)
    found = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fuzzy = sum(n - exact[i] for (i, _), (_, n) in zip(rows, expected, strict=True))
    assert fuzzy > 20
    assert all(exact[i] <= found[i].n_removed_lines <= n for (i, _), (_, n) in zip(rows, expected, strict=True))
    assert sum(found[i].n_removed_lines - exact[i] for i, _ in rows) >= 0.95 * fuzzy


@pytest.mark.parametrize("words", [1 << 20, 4])
def test_bloom_filter(spark, words):
    rng = np.random.default_rng(3)
    ids, others = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 3000))
    bloom = line_dedup.bloom_filter(spark.createDataFrame([(int(x),) for x in ids], "id long"), words)
    assert len(bloom) == min(words, 1024) and line_dedup.may_hold(bloom, ids).all()
    assert line_dedup.may_hold(bloom, others).mean() < 0.1 or words == 4
    assert not line_dedup.may_hold(line_dedup.bloom_filter(spark.createDataFrame([], "id long")), ids).any()


def test_repeated_rows_are_cut_alike(spark):
    rows = [(1, "a line that is there twice\nx"), (1, "a line that is there twice\nx"), (None, "y\nx"), (None, "y\nx"), (2, "a line that is there twice")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text, r.n_removed_lines) for r in found) == [("1", rows[0][1], 0), ("1", rows[0][1], 0), ("2", "", 1), ("None", "y", 1), ("None", "y", 1)]


def test_features_of_long_lines(monkeypatch):
    rng = random.Random(9)
    line = " ".join(str(rng.random()) for _ in range(400))
    whole = line_dedup.features([line, "short one", line], 6, 4, 5)
    monkeypatch.setattr(line_dedup, "PIECE", 300)
    parts = line_dedup.features([line, "short one", line], 6, 4, 5)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    marked = f"<{line}>".replace("<", "\x02").replace(">", "\x03")
    (hashes, starts), (larger, _) = line_dedup.n_grams([marked, marked], 5, 6)
    assert len(set(hashes.tolist())) == len({marked[k : k + 5] for k in range(len(marked) - 4)}) and starts.tolist() == [0, len(marked) - 4]
    assert len(larger) == 2 * (len(marked) - 5) and len(set(larger.tolist())) == len({marked[k : k + 6] for k in range(len(marked) - 5)})
    assert len(whole[1]) == 3 and whole[1][0] == whole[1][2] != whole[1][1]


@pytest.mark.parametrize("size", [3, 50, 4096])
def test_shared_keys(size):
    rng = np.random.default_rng(size)
    keys = np.sort(np.concatenate([rng.integers(0, 300, 200), np.full(40, 77), np.full(9, 500)]))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 17])], names=["key"]) for k in range(0, len(keys), 17)]
    few, many = [], []
    for rows, starts in meeting.shared_keys(iter(batches), 20, size):
        own = rows.column("key").to_pylist()
        if starts is None:
            many += own
        else:
            assert sorted(np.flatnonzero(np.append(True, np.diff(own) != 0)).tolist()) == starts.tolist()
            few += own
    n = dict(zip(*np.unique(keys, return_counts=True), strict=True))
    assert few == [k for k in keys if 1 < n[k] <= 20] and many == [k for k in keys if n[k] > 20]


def test_near_rows_are_bounded():
    """Long runs of near rows: pairs come in blocks, whatever their number, and the blocks hold all of them."""
    import tracemalloc

    rng = np.random.default_rng(4)
    prints = np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 6000, dtype=np.uint64))
    starts = np.array([0, 2000, 4000, 5990, 5999])
    tracemalloc.start()
    n = [sum(len(i) for i, _ in meeting.near_in_runs(prints, starts, 24)), int(meeting.near_others(prints, starts, 24).sum())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == [2 * (2000 * 1999 // 2) + 1990 * 1989 // 2 + 9 * 8 // 2, 5999] and peak < 64 << 20
    small = rng.integers(0, 1 << 64, 150, dtype=np.uint64) & np.uint64(0xFFFFFFFF)
    starts = np.array([0, 1, 4, 40, 75])
    run = np.searchsorted(starts, np.arange(150), side="right")
    expected = {(i, j) for i in range(150) for j in range(i) if run[i] == run[j] and (small[i] ^ small[j]).bit_count() <= 14}
    found = [(i, j) for a, b in meeting.near_in_runs(small, starts, 14, 50) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(found) == len(expected) > 20 and set(found) == expected
    assert np.flatnonzero(meeting.near_others(small, starts, 14)).tolist() == sorted({x for pair in expected for x in pair})


@pytest.mark.parametrize("letters", ["ab ", "abcdefgh é", "".join(chr(0x4E00 + k) for k in range(900))])
def test_alike_many(letters):
    rng = random.Random(len(letters))
    left = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 9, 10, 30, 64, 65, 130, 300]))) for _ in range(400)]
    pairs = [(x, changed(rng, x, letters) if rng.random() < 0.8 else rng.choice(left)) for x in left]
    assert edits.alike_many(pairs, 0.8).tolist() == [edits.alike(a, b, 0.8) for a, b in pairs]


def test_shared_before():
    rng = np.random.default_rng(1)
    here = np.sort(rng.integers(-9, 9, 90))
    keys = [[*rng.integers(-9, 9, rng.integers(0, 5)).tolist(), k] for k in here.tolist()]
    bits_of = meeting.shared_before(keys, here, np.flatnonzero(np.append(True, here[1:] != here[:-1])))
    pairs = [(x, y) for x in range(90) for y in range(x) if here[x] == here[y]]
    assert all((min(set(keys[x]) & set(keys[y])) == here[x]) == (not (bits_of[x] & bits_of[y]).any()) for x, y in pairs)


@pytest.mark.parametrize("few", [1, 24])
@pytest.mark.parametrize("length", [0, 12, 130, 400, 1300, 3000])
def test_lines_alike(length, few, monkeypatch):
    """Bands against whole distances: few and many letters, edits near the limit, blocks that moved, lines of every number of words."""
    monkeypatch.setattr(edits, "BAND_FEW", few)
    rng = random.Random(length)
    for letters in ("ab", "abcdefgh ", "aä\U0001f600\ud800 z"):
        lines = []
        for _ in range(6):
            line = "".join(rng.choice(letters) for _ in range(rng.randint(length // 2, length)))
            lines.append(line)
            for share in (0.15, 0.2, 0.22):
                near, n = list(line), int(share * len(line))
                for _ in range(n // 2):
                    near[rng.randrange(len(near))] = rng.choice(letters)
                at, to = rng.randrange(len(near) + 1), rng.randrange(len(near) + 1)
                near[to:to] = near[at : at + n // 4]
                lines.append("".join(near))
        i, j = np.triu_indices(len(lines), 1)
        i, j = i[:: 1 + length // 400], j[:: 1 + length // 400]
        found = edits.Lines(lines)
        expected = [edits.alike(lines[x], lines[y], 0.8) for x, y in zip(i, j, strict=True)]
        assert found.alike(i, j, 0.8).tolist() == expected
        assert found.alike(i, j, 0.8, np.ones(len(i), bool)).tolist() == expected
        assert (found.sizes_allow(i, j, 0.8) | ~np.array(expected)).all()


def test_many_lines_with_one_passage():
    """Lines that share a passage and are otherwise unlike: all pairs are compared, in a time that whole distances one by one would not keep to."""
    import time

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(25))
    lines = [" ".join([*(word() for _ in range(rng.randint(20, 40))), passage, *(word() for _ in range(20))]) for _ in range(300)]
    i, j = np.triu_indices(len(lines), 1)
    began = time.thread_time()
    found = edits.Lines(lines).alike(i, j, 0.8)
    banded = time.thread_time() - began
    began = time.thread_time()
    some = np.arange(0, len(i), 50)
    expected = edits.alike_many([(lines[x], lines[y]) for x, y in zip(i[some], j[some], strict=True)], 0.8)
    assert (found[some] == expected).all()
    assert banded < 0.6 * 50 * (time.thread_time() - began)


@pytest.mark.parametrize("letters", ["ab c", "abcdefghij klmno", "aé\u4e00\U0001f600 b"])
def test_counts_rule_out_no_like_lines(letters, monkeypatch):
    monkeypatch.setattr(edits, "COUNTED", 4096)
    rng = random.Random(len(letters))
    lines = ["", "", "a", "b", "a" * 700, "a" * 600 + "b" * 100, "a" * 350 + "b" * 350]
    for size in (1, 2, 9, 40, 200, 900):
        line = "".join(rng.choice(letters) for _ in range(size))
        lines += [line, *(changed(rng, line, letters) for _ in range(6)), "".join(rng.choice(letters) for _ in range(size))]
    i, j = np.triu_indices(len(lines), 1)
    expected = np.array([edits.alike(lines[x], lines[y], 0.8) for x, y in zip(i, j, strict=True)])
    found = edits.Lines(lines)
    some = rng.sample(range(len(i)), 40)  # the counters of a few lines first, which do not lie next to each other
    assert (found.counts_allow(i[some], j[some], 0.8) | ~expected[some]).all()
    assert (found.counts_allow(i, j, 0.8) | ~expected).all()
    assert (found.counts_allow(i, j, 0.8) == edits.Lines(lines).counts_allow(i, j, 0.8)).all()
    assert (found.alike(i, j, 0.8) == expected).all()


def test_counts_spare_most_comparisons(monkeypatch):
    """Lines that meet under a common passage of 9 characters and are else unlike do not come to be compared."""
    rng = random.Random(5)
    lines = ["common ab" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(30)] + ["common ab" + "z" * 60, "common ab" + "z" * 59 + "y"]
    n, compared = len(lines), []
    whole = edits.Lines.alike
    monkeypatch.setattr(edits.Lines, "alike", lambda self, i, j, *rest: compared.append(len(i)) or whole(self, i, j, *rest))

    class Rows:
        def mapInArrow(self, run, _):
            self.run = run
            return self

        distinct = lambda self: self

    monkeypatch.setattr(line_dedup, "by_key", lambda rows: rows)
    columns = {"id": list(range(n)), "key": [7] * n, "fp": [0] * n, "keys": [[7]] * n, "text": lines}
    links = [tuple(r.values()) for b in line_dedup.verified_links(Rows(), 24, 0.8).run(iter([pa.RecordBatch.from_pydict(columns)])) for r in b.to_pylist()]
    assert [sorted(x) for x in links] == [[n - 2, n - 1]]
    assert 1 <= sum(compared) <= 20  # of 496 pairs


def test_lines_of():
    spaces = {chr(c) for c in range(0x110000) if chr(c).isspace()} - {" ", "\n"}
    assert set(line_dedup._UNEVEN) == spaces | {"  "}
    for text in ("", "\n \n", " A b \nC  d\n", "ΟΔΟΣ\nΣ x", "İ I\r\nq", *(f"a{x}B\n {x}c" for x in sorted(spaces))):
        assert line_dedup.lines_of(text) == [line_dedup.normalised(x) for x in text.split("\n")]


def test_batches_of_texts_are_bounded(monkeypatch):
    monkeypatch.setattr(meeting, "MOST_TEXT", 1000)
    batches = [pa.RecordBatch.from_pydict({"key": [k // 2 for k in range(low, low + 10)], "text": ["x" * 100] * 10}) for low in range(0, 100, 10)]
    found = list(meeting.shared_keys(iter(batches), float("inf"), 1 << 16, "text"))
    assert [rows.num_rows for rows, _ in found] == [8, *[10] * 9, 2]
    assert len(list(meeting.shared_keys(iter(batches), float("inf"), 1 << 16))) == 1


def test_pairs_come_together():
    pairs = [(np.arange(k), np.arange(k) + 1) for k in (3, 4, 5)]
    found = list(meeting.together(iter(pairs), lambda i, j: i > 0, 4))
    assert [x.tolist() for x, _ in found] == [[1, 2, 1, 2, 3], [1, 2, 3, 4]]
    assert list(meeting.together(iter([]), lambda i, j: i > 0)) == []


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_of_few_and_many_links(spark, few):
    """Chains, stars and rings, with the rounds of many links and in the one task of few."""
    rng = random.Random(2)
    chain = list(range(100))
    rng.shuffle(chain)
    links = [*zip(chain, chain[1:], strict=False), *((-500, k) for k in range(-499, -400)), *((2000 + k, 2000 + (k + 1) % 40) for k in range(40)), (-(1 << 63), (1 << 63) - 1)]
    rng.shuffle(links)
    began = spark.sparkContext.statusTracker().getJobIdsForGroup() if few else []
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), few=few).collect()}
    assert found == roots({n for x in links for n in x}, links)
    assert not few or len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(began) < 12
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long"), few=few).count() == 0


def test_documents_are_kept_by_one_join(spark):
    rows = [(k, " ".join(f"w{(k // 2) * 100 + x}" for x in range(30))) for k in range(8)]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6]


def test_freed_native_memory_goes_back(spark):
    told = trim_native(spark)
    assert told is None or "rim native heap" in told


def test_components_end_in_one_task_after_some_rounds(spark):
    """A chain, which rounds alone shorten by a share each, a star and a pair."""
    links = [(i, i + 1) for i in range(3000)] + [(5000, 5000 + i) for i in range(1, 2000)] + [(9000, 9001)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), max_rounds=4, few=900).collect()}
    assert found == {**dict.fromkeys(range(3001), 0), **dict.fromkeys(range(5000, 7000), 5000), 9000: 9000, 9001: 9000}
