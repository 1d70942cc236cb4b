"""The corpus pipeline, stage by stage."""

import pytest

import corpus_pipeline as pipe
from framelake.llm import decontam, jaccard, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(pipe.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_decisions(spark, stages):
    docs, good, single, clean, mixed, ids = stages
    for df in (good, single, clean, mixed):
        assert df.columns == docs.columns
    scores = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    cls = jaccard.jaccard_classes(good).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in cls}
    hits = decontam.hit_digest(decontam.benchmark_hits(single, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in hits.where("not contaminated").collect()}
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert ids.count() == mixed.count()


def test_run(spark, stages):
    assert sorted(map(tuple, pipe.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))
