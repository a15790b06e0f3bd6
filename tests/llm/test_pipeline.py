"""The pipeline's stages against their operators' rules."""

import corpus_pipeline as cp
from tests.llm.test_joins import brute_components
from voxtab.plans.lineage import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    assert [n for n, _ in cp.STAGES][0] == "toxicity" and len(cp.STAGES) == 5
    for k, (_, stage) in enumerate(cp.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if k == 2 else None
        docs = materialize(stage(spark, docs, SF))
        if k < 4:
            assert docs.columns == columns and docs.count() <= kept
            kept = docs.count()
        if before:
            want = {i for i, (_, c) in brute_components(before, 5, 80).items() if i == c}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == want
    assert docs.select("doc_id").distinct().count() == kept


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
