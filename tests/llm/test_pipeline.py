"""The pipeline's stages, each against what its operator gives, and the registry."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as p
    from millrace.llm.common import checkpoint, table

    docs, out = table(spark, SF, "documents"), []
    for name, stage in p.STAGES:
        told = checkpoint(stage(spark, docs, SF))
        out.append((name, docs, told))
        docs = told
    return out


def test_columns_and_order(stages):
    import corpus_pipeline as p

    assert [n for n, _, _ in stages] == ["quality rules", "line dedup", "near duplicates", "mixing", "encoding"]
    for _, _, told in stages[:-1]:
        assert told.columns == list(p.COLUMNS)


def test_decisions_take_effect(spark, stages):
    from millrace.llm import line_dedup, mixing, quality_rules, similar
    from millrace.llm.common import table

    (_, docs, good), (_, _, lined), (_, _, single), (_, _, mixed), (_, _, encoded) = stages
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    rules = quality_rules.quality_rules(docs, quality_rules.trusted_ids(table(spark, SF, "labels")))
    assert ids(good) == ids(rules.where("kept")) and 0 < good.count() < docs.count()
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(good).collect()}
    assert {r.doc_id: r.text for r in lined.collect()} == texts and all(r.n_chars == len(r.text) for r in lined.collect())
    assert ids(single) == sorted({r.component_id for r in similar.similar_documents(lined).collect()})
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect()}
    counts = {}
    for i in ids(mixed):
        counts[i] = counts.get(i, 0) + 1
    assert counts == {i: n for i, n in copies.items() if n}
    assert ids(encoded) == ids(mixed)


def test_round_trip(spark, stages):
    from millrace.llm import bpe

    _, mixed, encoded = stages[-1]
    back = bpe.decode(encoded, bpe.ranks_path()).collect()
    assert sorted((r.doc_id, bytes(r.bytes).decode()) for r in back) == sorted((r.doc_id, r.text or "") for r in mixed.collect())


def test_registry():
    import __spark_entry__ as e

    names = e.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and "op1_mix_sources" in e.oracle_sql()
