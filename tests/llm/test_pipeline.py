"""The pipeline's stages, each held against the plain meaning of its operator on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daygrain.llm import decontaminate, queries
from daygrain.llm.common import read_table
from tests.llm.helpers import documents, same_as_oracle, write
from tests.llm.test_operators import _components, _fingerprint

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output folders."""
    folders, docs = [], read_table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        folder = write(spark, documents=docs)
        out = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), SF)
        if name != "tokenize":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.read.parquet(write(spark, documents=out) + "/documents.parquet")
        folders.append((name, folder, docs))
    return {name: (folder, out) for name, folder, out in folders}


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "tokenize"]


def test_quality_drops_junk_and_keeps_clean(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages["quality"][1].select("doc_id").withColumn("kept", F.lit(1))
    rows = labels.join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {r["quality"]: r["share"] for r in rows}
    assert share[1] >= 0.97 and share[0] <= 0.1


def test_line_dedup_takes_effect(spark, stages):
    folder, out = stages["line_dedup"]
    got = spark.read.parquet(f"{folder}/documents.parquet").join(out.select("doc_id", F.col("text").alias("kept"), F.col("n_chars").alias("n")), "doc_id")
    assert got.count() == out.count() and out.where("n_chars != length(text)").count() == 0
    hashed = queries.SQL_LINE_DEDUP.replace("n_lines,", "n_lines,", 1)
    both = queries.op2_line_dedup(spark, folder)
    same_as_oracle(both, folder, hashed, "documents")
    assert got.select("doc_id", F.sha2("kept", 256).alias("h")).exceptAll(both.select("doc_id", F.col("kept_sha256").alias("h"))).count() == 0


def test_one_of_each_group_stays(spark, stages):
    folder, out = stages["near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    labels = _components([_fingerprint(t) for _, t in rows])
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(rows[i][0] for i in set(labels))


def test_leaks_go_and_the_rest_stays(spark, stages):
    folder, out = stages["decontaminate"]
    items = [decontaminate.normal(r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    before = {r["doc_id"]: decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    leaked = {i for i, t in before.items() if any(x in t for x in items)}
    after = {r["doc_id"] for r in out.collect()}
    assert leaked and not leaked & after and before.keys() - after == leaked


def test_every_text_comes_back(stages):
    folder, out = stages["tokenize"]
    assert out.where("not round_trip or n_tokens != size(ids)").count() == 0 and out.count() > 0


def test_odd_rows_pass_every_stage(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, SF)
        assert out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.quality(spark, docs, SF).columns == docs.columns
