import pytest
from pyspark.sql import functions as F

from panelforge.operators import lookup
from panelforge.sources import point_store


def scanned_rows(df):
    """Rows that the file scans of a plan put out, after it has run."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """200,000 rows of 4,000 entities in small row groups."""
    path = str(tmp_path_factory.mktemp("points"))
    rows = spark.range(200_000).select(
        F.concat(F.lit("E"), F.lpad((F.col("id") % 4000).cast("string"), 5, "0")).alias("respondent"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 4000).cast("int")).alias("target_date"),
        F.lit("Large").alias("tier"),
        F.rand(1).alias("target"),
        F.rand(2).alias("benchmark_forecast"),
        F.rand(3).alias("naive_persistence"),
    )
    point_store.write_points(rows, path, entities_per_group=200, group_bytes=64 << 10)
    return path


def test_a_lookup_skips_files_and_row_groups(spark, store):
    asked = spark.createDataFrame([("e00007", None), ("E02500", "2024-01-09"), ("E02500", "2030-01-01"), ("nobody", None)], "respondent string, target_date string")
    got = point_store.lookup_points(spark, store, asked)
    want = lookup.lookup_rows(spark.read.parquet(store), asked)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("found").count() == 2
    one = point_store.points_of(spark, store, asked)
    assert one.count() == 100
    assert scanned_rows(one) < 0.1 * 200_000
    # An entity between two others, within the bounds of a row group: the Bloom filter leaves the group out.
    absent = point_store.points_of(spark, store, spark.createDataFrame([("E02500X",)], "respondent string"))
    assert scanned_rows(absent) == 0


def test_many_requests_are_joined(spark, store):
    asked = spark.read.parquet(store).select("respondent").distinct().filter("respondent < 'E00020'").withColumn("target_date", F.lit(None).cast("date"))
    few = point_store.history_points(spark, store, asked, 3)
    many = point_store.history_points(spark, store, asked, 3, most_values=5)
    assert few.count() == 60 and sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert point_store.points_of(spark, store, asked.filter("false")).count() == 0
