"""Feature rows laid out for point lookups: entities close together in files, with Bloom filters on them.

Rows are dealt out by range of entity and date and sorted within their files, so the bounds of files and row groups leave out
most of the store, and a Parquet Bloom filter on the entity leaves out the row groups whose bounds happen to hold it.  A lookup
hands its entities down to the scan as values; the requests of a service are few.  Beyond ``most_values`` different entities the
bounds and filters would let nearly everything through, and the requests are joined as a table.  Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import lookup

MOST_VALUES = 1000


def write_points(features: DataFrame, path: str, entities_per_group: int = 100_000, group_bytes: int = 8 << 20) -> None:
    """Write ``features`` by range of entity and date; row groups of ``group_bytes`` carry a Bloom filter on the entity."""
    (
        features.repartitionByRange("respondent", "target_date")
        .sortWithinPartitions("respondent", "target_date")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.size", group_bytes)
        .option("parquet.bloom.filter.enabled#respondent", "true")
        .option("parquet.bloom.filter.expected.ndv#respondent", entities_per_group)
        .parquet(path)
    )


def points_of(spark: SparkSession, path: str, requests: DataFrame, most_values: int = MOST_VALUES) -> DataFrame:
    """The stored rows of the requested entities (``respondent``, in any case).

    At most ``most_values`` entities, which is counted first, become values of the scan's filter.
    """
    stored = spark.read.parquet(path)
    wanted = requests.select(F.upper("respondent").alias("respondent")).filter("respondent is not null").distinct()
    few = wanted.limit(most_values + 1).collect()
    if len(few) <= most_values:
        return stored.filter(F.col("respondent").isin([r["respondent"] for r in few]))
    return stored.join(wanted, "respondent", "left_semi")


def lookup_points(spark: SparkSession, path: str, requests: DataFrame, most_values: int = MOST_VALUES) -> DataFrame:
    """``lookup.lookup_rows`` over the rows that the scan lets through."""
    return lookup.lookup_rows(points_of(spark, path, requests, most_values), requests)


def history_points(spark: SparkSession, path: str, requests: DataFrame, limit: int = 60, most_values: int = MOST_VALUES) -> DataFrame:
    """``lookup.history`` over the rows that the scan lets through."""
    return lookup.history(points_of(spark, path, requests, most_values), requests, limit)
