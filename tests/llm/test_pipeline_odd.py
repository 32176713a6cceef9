"""The pipeline's stages on odd rows: nulls in every column, empty and long texts, repeated rows, clashing names, no rows at all."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("_all", "_key", "_row", "_size", "size", "copies", "fp", "row", "h", "_t", "score", "piece", "term")


@pytest.fixture(scope="module")
def odd(spark):
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 1) for i, t in enumerate(good)]
    rows += [(100, good[0], "en", "a", 1), (100, good[0], "en", "a", 1), (None, good[1], None, None, None), (101, None, None, "a", None)]
    rows += [(102, "", "en", "a", 0), (103, " \t\n", "en", "b", 3), (104, "long words here " * 60_000, "en", "a", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in CLASHING})


def test_stages_on_odd_rows(spark, odd, tmp_path):
    docs, columns = odd, odd.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        if name != "best_fit_packing":
            assert out.columns == columns, name
        if name == "exact_dedup":
            assert out.groupBy(F.coalesce("text", F.lit(""))).count().filter("count > 1").count() == 0
        if name == "best_fit_packing":
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
        docs = out


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_each_stage_takes_the_odd_rows_themselves_and_none(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    assert out.count() > 0
    if name == "exact_dedup":
        assert out.filter("text is null or text = ''").count() == 1
    assert stage(spark, odd.filter("false"), SF).count() == 0
