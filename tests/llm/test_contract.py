"""Queries with SQL against it, the pipeline stage by stage, and what must hold for the registry."""

import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kgspark.llm import ngram_join, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert oracle.differences(spark, sf, queries.QUERIES[name], queries.oracle_sql()[name]) == ""


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append((docs, out))
        docs = out
    assert len(seen) == 5 and all(b.columns == columns for _, b in seen[:-1])
    a, b = seen[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = a.join(labels, "doc_id").join(b.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").toPandas()
    assert kept[kept.quality == 1].k.notna().mean() > 0.97 and kept[kept.quality == 0].k.isna().mean() > 0.8
    a, b = seen[1]
    assert ngram_join.jaccard_components(spark, b).where("doc_id <> component_id").count() == 0
    assert b.join(a, a.columns, "left_anti").count() == 0 and 0 < b.count() < a.count()
    a, b = seen[2]
    assert a.count() == b.count()
    assert b.where("n_chars <> length(text)").count() == 0
    a, b = seen[3]
    assert a.count() == b.count() and b.where("text like '%[SECRET]%'").count() > 0
    a, b = seen[4]
    assert b.select("doc_id").distinct().count() == a.count() and b.where("`offset` + length > 2048").count() == 0


def test_pipeline_with_awkward_rows(spark, clashing, tmp_path):
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == clashing.columns
        out.write.parquet(f"{tmp_path}/s{i}")
        docs = spark.read.parquet(f"{tmp_path}/s{i}")
        assert docs.where("base is not null and base <> 'own base'").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_on_nothing(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
