"""Quality rules against a plain version in Python."""

import collections
import math
import re

from millrace.llm import quality_rules as q

TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 2000, "l1 w\nl1 w\n\n \nl2\nl1 w", "#*$%&|<> #a\x0b$b\rc", "é ü ß 漢字 \U0001f600 x",
    "the quick brown fox jumps over the lazy dog and runs away from the bear in the wood today for a long while now " * 1, " ".join(f"w{i}" for i in range(300)),
    " ".join(f"w{i % 9}" for i in range(100)), " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(12)), "BUY!! NOW!! " * 3 + " ".join(f"W{i}!!" for i in range(30)),
    "hello \u2028", "a b \u0085", " a\u2029 b \u2029\n", "x \u2028\n\n", "\u0085", "\u00a0 a",
]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if counts[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    return (*out, out[0] < 20 or 100 * out[4] > 30 * out[0])


def xxh(*parts):
    """Spark's xxhash64: the hash of each part is the seed of the next."""
    import xxhash

    found = 42
    for x in parts:
        found = xxhash.xxh64_intdigest(x.encode(), found)
    return found - (1 << 64) if found >> 63 else found


def grams(text, buckets):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    half = buckets // 2
    return [xxh(w) % half for w in words] + [half + xxh(*words[i : i + 2]) % half for i in range(len(words))]


def frames(spark, texts=TEXTS):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(texts)] + [(None, "a null id", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, llr double")
    labels = spark.createDataFrame([(10, 1, 0), (11, 1, 0), (11, 1, 0), (14, 0, 0), (12, None, None), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_counts_and_scores(spark):
    docs, labels = frames(spark)
    buckets, prior = 512, 1000.0
    found = {r.doc_id: r for r in q.quality_rules(docs, q.trusted_ids(labels), threshold=-0.2, buckets=buckets, prior=prior).collect()}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in [*enumerate(TEXTS), (None, "a null id")]:
        raw.update(grams(t, buckets))
        if i in (10, 11):
            target.update(grams(t, buckets))
    n_raw, n_target = sum(raw.values()) + buckets, sum(target.values())
    ratio = {b: math.log((target[b] + prior * (raw[b] + 1) / n_raw) / (n_target + prior) / ((raw[b] + 1) / n_raw)) for b in range(buckets)}
    for i, t in enumerate(TEXTS):
        r, own = found[i], grams(t, buckets)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), i
        llr = sum(ratio[b] for b in own) / len(own) if own else 0.0
        assert abs(llr - r.llr) < 1e-9
        assert r.kept == (not r.base_failed and r.llr >= -0.2)
    assert found[11].kept and found[11].llr > found[14].llr and not found[12].kept


def test_no_python_in_the_plan(spark):
    docs, labels = frames(spark)
    plan = q.quality_rules(docs, q.trusted_ids(labels))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert q.quality_rules(docs.limit(0), q.trusted_ids(labels)).count() == 0
    found = q.quality_rules(docs, q.trusted_ids(labels.limit(0))).collect()
    assert all(abs(r.llr) < 1e-9 for r in found) and len(found) == len(TEXTS) + 1
