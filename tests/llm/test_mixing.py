"""Mixing against DuckDB and by its own rules."""

import duckdb
import pandas as pd
import pytest

from millrace.llm import mixing
from millrace.llm.queries import OP1_SQL

SCHEMA = "doc_id long, text string, source string, size string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def duck(rows):
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    with duckdb.connect() as con:
        con.register("documents", documents)
        return sorted(map(str, con.execute(OP1_SQL).fetchall()))


def mine(found):
    return sorted(str((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in found.collect())


CASES = {
    "plain": [(i, "a b c " * (i % 7 + 1), f"s{i % 5}") for i in range(200)],
    "nulls, blanks, repeats": [(1, None, None), (2, "", "a"), (3, " \t\n", "é"), (4, "x y", None), (4, "x y", None), (5, "w " * 50, "b"), (6, "q", "")],
    "hot": [(i, "a b", "big") for i in range(300)] + [(1000 + i, "a " * 9, f"t{i}") for i in range(6)],
    "long": [(0, "w " * 20000, "a"), *((i, "w " * 3, "b") for i in range(1, 40)), (99, "w", "c")],
    "null ids": [(None, "a " * (i % 5 + 1) + f"t{i % 60}", "s") for i in range(90)] + [(7, "q " * 40, "t")],
    "no words": [(1, "", "a"), (2, None, "b")],
    "one": [(1, "a b c", "a")],
}


@pytest.mark.parametrize("few", [10_000, 0])
@pytest.mark.parametrize("name", CASES)
def test_same_as_sql(spark, name, few, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = CASES[name]
    assert mine(mixing.mix(docs(spark, rows), bucket_words=40)) == duck(rows)


def test_rules(spark):
    rows = CASES["plain"]
    found = mixing.mix(docs(spark, rows), bucket_words=100).toPandas()
    assert (found.taken <= 3 * found["size"]).all()
    totals = found.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((totals.taken - totals.target).abs() <= 21).all()
    assert (totals.target <= 3 * totals["size"]).all()
    assert abs(totals.target.sum() - found["size"].sum()) < 1e-6
    again = mixing.mix(docs(spark, rows).repartition(7), bucket_words=17).toPandas()
    assert sorted(map(tuple, found[["doc_id", "taken"]].values)) == sorted(map(tuple, again[["doc_id", "taken"]].values))


def test_repeat_and_empty(spark):
    rows = CASES["plain"]
    taken = {r.doc_id: r.copies for r in mixing.mix(docs(spark, rows)).collect()}
    out = mixing.repeat(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "size"]
    assert out.count() == sum(taken.values())
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.repeat(docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", CASES)
def test_repeat_takes_each_row_for_itself(spark, name):
    rows = CASES[name]
    taken = mixing.mix(docs(spark, rows), bucket_words=40).groupBy("source").sum("taken").collect()
    out = mixing.repeat(docs(spark, rows), bucket_words=40)
    found = {r.source: sum(len((x.text or "").split()) for x in out.collect() if x.source == r.source) for r in taken}
    assert found == {r.source: r[1] for r in taken}


def test_no_python_in_the_plan(spark):
    plans = [f(docs(spark, CASES["plain"]))._jdf.queryExecution().executedPlan().toString() for f in (mixing.mix, mixing.repeat)]
    assert not any(x in p for p in plans for x in ("Python", "Arrow", "Pandas"))
