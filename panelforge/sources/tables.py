"""Star-schema tables read as long observations.

Entity is the nation of the supplier (or of the customer), period the ship (or
order) day, and the four series are sums over the rows of that day in whole
currency units.  Amounts are summed as integers, so the result does not depend
on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.schema import RAW_COLUMNS, SERIES

UNITS = "currency"
TIMEZONE = "UTC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(name: str):
    """A two-decimal amount as an integer: sums are exact and stay in primitive code.

    ``floor(x + 0.5)`` and not ``round``, which goes through a decimal object per row.
    """
    return F.floor(F.col(name) * 100 + 0.5)


def supplier_panel(spark: SparkSession, sf_dir: str, series: list[str] | None = None) -> DataFrame:
    """Wide daily panel per supplier nation: demand, forecast, generation, interchange.

    ``series`` names the series to build; the part table is joined for the forecast alone.

    Sums per (day, nation) are combined map-side, so a nation with a third of
    all rows sends one row per day and map task.  No join is hinted: Spark
    broadcasts a table only while its measured size allows and otherwise sorts
    and merges, splitting skewed keys at run time.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("period"),
        "l_suppkey",
        "l_partkey",
        "l_returnflag",
        _hundredths("l_quantity").alias("quantity"),
        _hundredths("l_extendedprice").alias("price"),
        _hundredths("l_discount").alias("discount"),
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", _hundredths("p_retailprice").alias("retail"))

    signed = F.when(F.col("l_returnflag") == "R", -F.col("price")).otherwise(F.col("price"))
    wanted = list(SERIES.values()) if series is None else series
    sums = {
        "D": (F.sum("price"), 100),
        "DF": (F.sum(F.col("quantity") * F.col("retail")), 10000),
        "NG": (F.sum(F.col("price") * (100 - F.col("discount"))), 10000),
        "TI": (F.sum(signed), 100),
    }
    codes = [code for code, name in SERIES.items() if name in wanted]
    if "DF" in codes:
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("period", "s_nationkey")
        .agg(*[sums[code][0].alias(code) for code in codes])
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "period",
            F.col("n_name").alias("respondent"),
            F.col("n_nationkey").alias("nationkey"),
            F.col("n_regionkey").alias("regionkey"),
            *[F.round(F.col(code) / sums[code][1]).alias(SERIES[code]) for code in codes],
        )
    )


def panel_to_long(panel: DataFrame) -> DataFrame:
    """The four series of a wide panel as rows in the raw schema."""
    pairs = ", ".join(f"'{code}', {name}" for code, name in SERIES.items())
    return (
        panel.select("period", "respondent", F.expr(f"stack({len(SERIES)}, {pairs}) as (type, value)"))
        .withColumns(
            {
                "respondent_name": F.lower("respondent"),
                "type_name": F.lower("type"),
                "value_units": F.lit(UNITS),
                "timezone": F.lit(TIMEZONE),
                "_ingested_at": F.col("period").cast("timestamp"),
                "_source_route": F.lit("lineitem"),
            }
        )
        .select(*RAW_COLUMNS)
    )


def with_regions(panel: DataFrame, regions: DataFrame) -> DataFrame:
    """Nation rows of the panel plus region rows that sum them (the roll-up entities)."""
    by_region = (
        panel.groupBy("period", "regionkey")
        .agg(*[F.sum(name).alias(name) for name in SERIES.values()])
        .join(regions, F.col("regionkey") == F.col("r_regionkey"))
        .select("period", F.col("r_name").alias("respondent"), *SERIES.values())
    )
    return panel.select("period", "respondent", *SERIES.values()).unionByName(by_region)


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw text rows of one page source: one per order, values as text.

    Orders in status P carry no readable amount yet, and unspecified priority
    stands for a missing one.
    """
    orders = table(spark, sf_dir, "orders")
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return orders.select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("?")))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("period"),
        F.col("o_custkey").cast("string").alias("respondent"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("respondent-name"),
        F.col("o_orderstatus").alias("type"),
        F.col("o_orderpriority").alias("type-name"),
        F.when(F.col("o_orderstatus") == "P", "n/a")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None))
        .otherwise(amount)
        .alias("value"),
        F.lit(UNITS).alias("value-units"),
        F.lit(TIMEZONE).alias("timezone"),
    )


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as revisions: the last event of a user, type and day is its value."""
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("period"),
        F.col("user_id").cast("string").alias("respondent"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("respondent_name"),
        F.col("event_type").alias("type"),
        F.upper("event_type").alias("type_name"),
        "value",
        F.lit(UNITS).alias("value_units"),
        F.lit(TIMEZONE).alias("timezone"),
        F.col("ts").cast("timestamp").alias("_ingested_at"),
        F.lit("events").alias("_source_route"),
        "event_id",
    )


def nation_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static size tier of each nation, by its key."""
    key = F.col("n_nationkey")
    tier = F.when(key <= 5, "Large").when(key <= 15, "Medium").otherwise("Small")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("respondent"), tier.alias("tier"))
