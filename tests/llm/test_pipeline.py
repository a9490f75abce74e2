from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from framequarry.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        if i < 4:
            assert docs.columns == before.columns
            docs = corpus_pipeline.cut(docs, "test")
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[5] == counts[4]


def test_pipeline_on_awkward_rows(documents, nothing, spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""
    short = documents.filter("doc_id is null or doc_id not in (200, 210)")
    for docs in (short, nothing):
        folder = tmp_path / docs.__hash__().__str__()
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(100)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "a row without an id stands here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:4]:
            now = corpus_pipeline.cut(stage(spark, now, str(folder)), name)
            assert now.columns == docs.columns
        last = corpus_pipeline.sharding(spark, now, str(folder)).collect()
        assert len(last) == now.count() and len({(r.shard, r.slot) for r in last}) == len(last)


def test_every_operator_has_a_query():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert names | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.oracle_sql()) <= names
