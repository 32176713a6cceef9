"""Every registered query: a Spark plan over the whole tables and, where SQL can say it, its SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.dates import calendar_parts, cyclical_parts, holiday_flags
from panelforge.operators import (
    distribution,
    drift,
    explore,
    features,
    ingest,
    lookup,
    metrics,
    models,
    panel,
    quality,
    scoring,
    splits,
)
from panelforge.plans import sql as q
from panelforge.schema import NUMERIC_FEATURES, SERIES, TIER_NAMES
from panelforge.session import checkpoint_dir, cut_lineage
from panelforge.sources import pages, sinks, store, tables
from panelforge.sources.ingest_job import ingest_landed
from panelforge.streaming.ingest import append_stream, drop_repeats, stream_observations, stream_pages, upsert_stream
from panelforge.streaming.rollups import daily_quality, daily_rollup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ------------------------------------------------------------------ shared inputs


def wide(spark: SparkSession, sf_dir: str, *series: str) -> DataFrame:
    names = list(series or SERIES.values())
    return tables.supplier_panel(spark, sf_dir, names).select("period", "respondent", *names)


def stored_wide(spark: SparkSession, sf_dir: str, *series: str) -> DataFrame:
    """The panel as a written table, for plans that use it more than once: the raw rows are read once."""
    return cut_lineage(wide(spark, sf_dir, *series))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.panel_to_long(wide(spark, sf_dir))


def region_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut_lineage(tables.supplier_panel(spark, sf_dir))
    return tables.panel_to_long(tables.with_regions(stored, tables.table(spark, sf_dir, "region")))


def build(spark: SparkSession, sf_dir: str, source: DataFrame, drop_na_target: bool = True) -> DataFrame:
    return features.build_features(source, tables.nation_tiers(spark, sf_dir), drop_na_target)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir, wide(spark, sf_dir))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir, stored_wide(spark, sf_dir))


def with_prediction(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", scoring.stand_in_prediction())


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_prediction(feature_table(spark, sf_dir))


def split_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_time_series(with_prediction(stored_features(spark, sf_dir)))


def with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cut_lineage(split_predicted(spark, sf_dir).withColumn("prediction", F.col("demand_lag_6")))
    fallback = scoring.fallback_entities(df.filter("split = 'val'"), "prediction")
    return scoring.apply_fallback(df, fallback, "prediction")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_features(df: DataFrame) -> DataFrame:
    means = [c for c in df.columns if c.startswith("demand_rolling_mean")]
    spreads = [c for c in df.columns if c.startswith(("demand_rolling_std", "demand_trend"))]
    circles = [c for c in df.columns if c.startswith(("sin_", "cos_"))]
    return rounded(rounded(rounded(df, 4, *means), 2, *spreads), 6, *circles)


APPROACHES = {"model": "prediction", "benchmark": "benchmark_forecast", "naive": "naive_persistence"}

# ------------------------------------------------------------------ ingest and scans

RAW_TEXT = """
raw AS (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS period,
         CAST(o_custkey AS VARCHAR) AS respondent, 'customer ' || CAST(o_custkey AS VARCHAR) AS respondent_name,
         o_orderstatus AS type, o_orderpriority AS type_name,
         CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '4-NOT SPECIFIED' THEN NULL
              ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS value,
         'currency' AS value_units, 'UTC' AS timezone, 'orders' AS _source_route
  FROM orders
)"""


@query("normalise_rows", q.with_(RAW_TEXT, "SELECT * FROM raw"))
def _(spark, sf_dir):
    return pages.normalise_rows(tables.order_rows(spark, sf_dir), "orders").drop("_ingested_at")


@query("entity_discovery", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS respondent FROM events")
def _(spark, sf_dir):
    return ingest.distinct_entities(tables.event_observations(spark, sf_dir))


@query(
    "keep_latest_revision",
    """SELECT CAST(ts AS DATE) AS period, CAST(user_id AS VARCHAR) AS respondent, event_type AS type,
              ARG_MAX(value, (ts, value, event_id)) AS value, ARG_MAX(event_id, (ts, value, event_id)) AS event_id
       FROM events GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    rows = tables.event_observations(spark, sf_dir).select(
        "period", "respondent", "type", "_ingested_at", "value", "event_id"
    )
    return ingest.keep_latest(rows).drop("_ingested_at")


@query("stored_entities", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS respondent FROM orders")
def _(spark, sf_dir):
    return ingest.distinct_entities(tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("c")), "c")


def _customers(spark, sf_dir):
    return tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("respondent"))


def _customer_days(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("respondent"), F.to_date("o_orderdate").alias("period")
    )


@query(
    "resume_missing_entities",
    """SELECT CAST(c_custkey AS VARCHAR) AS respondent FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1996-01-01')""",
)
def _(spark, sf_dir):
    stored = _customer_days(spark, sf_dir).filter("period < date '1996-01-01'")
    return ingest.not_stored(_customers(spark, sf_dir), stored)


@query("incremental_start", "SELECT CAST(MAX(CAST(l_shipdate AS DATE)) - 7 AS DATE) AS start FROM lineitem")
def _(spark, sf_dir):
    return ingest.incremental_start(tables.table(spark, sf_dir, "lineitem"), 7, "l_shipdate")


STATUS = """
WITH fetched AS (SELECT o_custkey AS k, COUNT(*) AS rows FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1),
known AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < DATE '1992-03-01'),
status AS (
  SELECT CAST(c_custkey AS VARCHAR) AS respondent,
         CASE WHEN known.k IS NOT NULL THEN 'skipped' WHEN c_acctbal < 0 THEN 'failed'
              WHEN rows IS NULL THEN 'no_data' ELSE 'ok' END AS status, rows
  FROM customer LEFT JOIN fetched ON c_custkey = fetched.k LEFT JOIN known ON c_custkey = known.k
)
"""


def _status(spark, sf_dir):
    days = _customer_days(spark, sf_dir)
    failures = tables.table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").cast("string").alias("respondent"), F.lit("timeout").alias("reason")
    )
    return ingest.ingest_status(
        _customers(spark, sf_dir),
        days.filter("period >= date '1996-01-01'"),
        days.filter("period < date '1992-03-01'"),
        failures,
    )


@query(
    "ingest_status",
    STATUS
    + """SELECT respondent, status, CASE WHEN status = 'ok' THEN rows ELSE 0 END AS rows,
                CASE WHEN status = 'failed' THEN 'timeout' END AS reason FROM status""",
)
def _(spark, sf_dir):
    return _status(spark, sf_dir)


@query(
    "ingest_status_counts",
    STATUS
    + """SELECT status, COUNT(*) AS respondents,
                CAST(SUM(CASE WHEN status = 'ok' THEN rows ELSE 0 END) AS BIGINT) AS rows FROM status GROUP BY 1""",
)
def _(spark, sf_dir):
    return ingest.status_counts(_status(spark, sf_dir))


@query("full_scan", q.with_(q.OBS, "SELECT * FROM obs"))
def _(spark, sf_dir):
    return observations(spark, sf_dir).drop("_ingested_at", "_source_route")


@query(
    "scan_years",
    """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS period, l_extendedprice AS value FROM lineitem
       WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-06-01' AND DATE '1996-05-31'""",
)
def _(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem")
    # The bound is on the stored timestamp, so that it reaches the scan.
    kept = lines.filter("l_shipdate >= timestamp_ntz'1995-06-01' and l_shipdate < timestamp_ntz'1996-06-01'")
    return kept.select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("period"), F.col("l_extendedprice").alias("value")
    )


# ------------------------------------------------------------------ landed pages and the store, written and read back


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


LOST = "(n_name = 'NATION_12' OR (n_name = 'NATION_20' AND YEAR(l_shipdate) = 1995))"
LANDED = f"""
landed AS (SELECT CAST(l_shipdate AS DATE) AS period, n_name AS respondent, n_nationkey, {LOST} AS lost,
                  ROUND(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) / 100) AS value
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3, 4)"""


def _landing(spark, sf_dir):
    """Demand as JSON pages, a document per nation and year (at most 366 rows); the source lost the rows of some."""
    lost = "respondent = 'NATION_12' or (respondent = 'NATION_20' and year = 1995)"
    rows = wide(spark, sf_dir, "demand").select(
        "respondent",
        F.year("period").alias("year"),
        F.struct(
            F.date_format("period", "yyyy-MM-dd").alias("period"),
            "respondent",
            F.lower("respondent").alias("respondent-name"),
            F.lit("D").alias("type"),
            F.lit("demand").alias("type-name"),
            F.col("demand").cast("decimal(20,0)").cast("string").alias("value"),
            F.lit(tables.UNITS).alias("value-units"),
            F.lit(tables.TIMEZONE).alias("timezone"),
        ).alias("row"),
    )
    page = rows.groupBy("respondent", "year").agg(F.collect_list("row").alias("rows"))
    total = F.sum(F.size("rows")).over(Window.partitionBy("respondent")).cast("string")
    data = F.when(F.expr(lost), F.filter("rows", lambda _: F.lit(False))).otherwise(F.col("rows"))
    body = F.to_json(F.struct(F.struct(total.alias("total"), data.alias("data")).alias("response")))
    path = _scratch(spark, "landing")
    page.select(body.alias("value"), F.col("respondent").alias("entity"), "year").write.partitionBy("entity", "year").text(path)
    return path


@query(
    "landed_rows",
    q.with_(
        LANDED,
        """SELECT period, respondent, LOWER(respondent) AS respondent_name, 'D' AS type, value, 'currency' AS value_units,
                  'UTC' AS timezone, '1999-01-01 06:00' AS ingested_at, 'pages' AS _source_route FROM landed WHERE NOT lost""",
    ),
)
def _(spark, sf_dir):
    rows = pages.page_rows(pages.read_pages(spark, _landing(spark, sf_dir)))
    out = pages.normalise_rows(rows, "pages", "1999-01-01 06:00:00").withColumn("ingested_at", F.date_format("_ingested_at", "yyyy-MM-dd HH:mm"))
    return out.select(
        "period", "respondent", "respondent_name", "type", "value", "value_units", "timezone", "ingested_at", "_source_route"
    )


@query(
    "page_audit",
    q.with_(
        LANDED,
        """SELECT respondent, COUNT(*) FILTER (WHERE NOT lost) AS fetched, COUNT(*) AS reported,
                  COUNT(*) FILTER (WHERE lost) = 0 AS complete FROM landed GROUP BY 1""",
    ),
)
def _(spark, sf_dir):
    landed = pages.read_pages(spark, _landing(spark, sf_dir))
    asked = landed.select("page", F.regexp_extract("page", "entity=([^/]+)", 1).alias("respondent"))
    return pages.page_audit(landed, asked).drop("page")


@query(
    "ingest_job",
    q.with_(
        LANDED + ", found AS (SELECT respondent, COUNT(*) FILTER (WHERE NOT lost) AS n, COUNT(*) AS seen FROM landed GROUP BY 1)",
        """SELECT n_name AS respondent, CASE WHEN n_nationkey < 10 AND seen > 0 THEN 'skipped' WHEN n_nationkey = 24 THEN 'failed'
                  WHEN COALESCE(n, 0) = 0 THEN 'no_data' ELSE 'ok' END AS status,
                  CASE WHEN n_nationkey >= 10 AND n_nationkey <> 24 THEN COALESCE(n, 0) ELSE 0 END AS rows,
                  CASE WHEN n_nationkey = 24 THEN 'timeout' END AS reason
           FROM nation LEFT JOIN found ON n_name = found.respondent""",
    ),
)
def _(spark, sf_dir):
    """A run that resumes: the store holds the first ten nations already."""
    nations = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("respondent"), "n_nationkey")
    path = _scratch(spark, "store")
    store.upsert(ingest.restrict_to(observations(spark, sf_dir), nations.filter("n_nationkey < 10")), path)
    failures = nations.filter("n_nationkey = 24").select("respondent", F.lit("timeout").alias("reason"))
    return ingest_landed(
        spark, _landing(spark, sf_dir), path, nations, "pages", resume=True, failures=failures, log=_scratch(spark, "failures")
    )


def _event_store(spark, sf_dir):
    """Events upserted in two batches that share a week, as a run with lookback does."""
    path = _scratch(spark, "store")
    df = tables.event_observations(spark, sf_dir)
    middle = df.agg(F.expr("timestamp_micros((unix_micros(min(_ingested_at)) + unix_micros(max(_ingested_at))) div 2)").alias("m")).first()["m"]
    store.upsert(df.filter(F.col("_ingested_at") < F.lit(middle)), path, grain="month")
    store.upsert(df.filter(F.col("_ingested_at") >= F.lit(middle) - F.expr("interval 7 days")), path, grain="month")
    return path


NEWEST = """SELECT CAST(ts AS DATE) AS period, CAST(user_id AS VARCHAR) AS respondent, event_type AS type,
                   ARG_MAX(value, (ts, value)) AS value FROM events GROUP BY 1, 2, 3"""


@query("store_full_scan", NEWEST)
def _(spark, sf_dir):
    return store.read_store(spark, _event_store(spark, sf_dir)).select("period", "respondent", "type", "value")


@query(
    "store_window_scan",
    f"WITH n AS ({NEWEST}), m AS (SELECT MAX(period) AS d FROM n) SELECT n.* FROM n, m WHERE period BETWEEN d - 9 AND d - 3",
)
def _(spark, sf_dir):
    last = tables.table(spark, sf_dir, "events").agg(F.to_date(F.max("ts")).alias("d")).first()["d"]
    days = [last - dt.timedelta(days=k) for k in (9, 3)]
    return store.scan_store(spark, _event_store(spark, sf_dir), *days).select("period", "respondent", "type", "value")


@query(
    "feature_store_tier",
    q.with_(q.FEATURES, "SELECT respondent, target_date, target, demand_t FROM features WHERE tier = 'Medium'"),
)
def _(spark, sf_dir):
    path = _scratch(spark, "features")
    sinks.write_features(feature_table(spark, sf_dir), path)
    return sinks.read_features(spark, path, "Medium").select("respondent", "target_date", "target", "demand_t")


FOCUS = ["NATION_1", "NATION_7", "NATION_12", "NATION_20"]
FOCUS_SQL = ", ".join(f"'{n}'" for n in FOCUS)


@query(
    "window_entity_type_filter",
    q.with_(
        q.OBS,
        f"""SELECT period, respondent, type, value FROM obs
            WHERE period BETWEEN DATE '1994-01-01' AND DATE '1997-12-31'
              AND respondent IN ({FOCUS_SQL}) AND type IN ('D', 'TI')""",
    ),
)
def _(spark, sf_dir):
    df = observations(spark, sf_dir)
    out = panel.filter_window(df, "1994-01-01", "1997-12-31", FOCUS, ["D", "TI"])
    return out.select("period", "respondent", "type", "value")


@query(
    "entity_semi_join",
    q.with_(
        q.OBS,
        """SELECT period, respondent, type, value FROM obs WHERE respondent IN
           (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""",
    ),
)
def _(spark, sf_dir):
    nations = tables.table(spark, sf_dir, "nation")
    asia = tables.table(spark, sf_dir, "region").filter("r_name = 'ASIA'")
    names = nations.join(asia, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(
        F.col("n_name").alias("respondent")
    )
    df = ingest.restrict_to(observations(spark, sf_dir), names)
    return df.select("period", "respondent", "type", "value")


@query("long_view", q.with_(q.OBS, "SELECT period, respondent, type, value FROM obs ORDER BY 1, 2, 3"))
def _(spark, sf_dir):
    return panel.long_view(observations(spark, sf_dir)).select("period", "respondent", "type", "value")


@query(
    "wide_pivot",
    q.with_(
        RAW_TEXT,
        """SELECT period, respondent, MAX(value) FILTER (WHERE type = 'O') AS open_value,
                  MAX(value) FILTER (WHERE type = 'F') AS filled_value, MAX(value) FILTER (WHERE type = 'P') AS pending_value
           FROM raw WHERE value IS NOT NULL GROUP BY 1, 2""",
    ),
)
def _(spark, sf_dir):
    rows = pages.normalise_rows(tables.order_rows(spark, sf_dir), "orders")
    return panel.to_wide(rows, {"O": "open_value", "F": "filled_value", "P": "pending_value"})


@query(
    "missing_series",
    q.with_(
        q.PANEL,
        """SELECT period, respondent, demand, CAST(NULL AS DOUBLE) AS demand_forecast, CAST(NULL AS DOUBLE) AS net_generation,
                  CAST(NULL AS DOUBLE) AS interchange FROM panel WHERE demand IS NOT NULL""",
    ),
)
def _(spark, sf_dir):
    return panel.with_missing_series(wide(spark, sf_dir, "demand"))


@query("wide_panel", q.with_(q.PANEL, "SELECT period, respondent, demand, demand_forecast, net_generation, interchange FROM panel"))
def _(spark, sf_dir):
    return panel.to_wide(observations(spark, sf_dir))


@query(
    "pruned_scan",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45",
)
def _(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem")
    return lines.filter("l_returnflag = 'R' and l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("pin_label", "SELECT event_id, user_id, value FROM events WHERE event_type = 'view'")
def _(spark, sf_dir):
    return ingest.pin_timezone(tables.table(spark, sf_dir, "events"), "view", "event_type").select(
        "event_id", "user_id", "value"
    )


@query(
    "first_entities_window",
    q.with_(
        q.OBS,
        """SELECT period, respondent, type, value FROM obs
           WHERE respondent IN (SELECT DISTINCT respondent FROM obs ORDER BY 1 LIMIT 5)
             AND period BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'""",
    ),
)
def _(spark, sf_dir):
    df = observations(spark, sf_dir)
    names = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("respondent"))
    known = ingest.restrict_to(names, ingest.distinct_entities(df))
    out = ingest.restrict_to(panel.filter_window(df, "1995-01-01", "1996-12-31"), ingest.first_entities(known, 5))
    return out.select("period", "respondent", "type", "value")


# ------------------------------------------------------------------ validation


@query(
    "unit_check",
    "SELECT COUNT(DISTINCT o_orderpriority) AS n_values, COUNT(DISTINCT o_orderpriority) <= 1 AS single FROM orders",
)
def _(spark, sf_dir):
    return quality.label_check(tables.table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    "timezone_check",
    "SELECT COUNT(DISTINCT event_type) AS n_values, COUNT(DISTINCT event_type) <= 1 AS single FROM events",
)
def _(spark, sf_dir):
    return quality.label_check(tables.table(spark, sf_dir, "events"), "event_type")


@query(
    "duplicate_keys",
    """SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows, COUNT(*) FILTER (WHERE n > 1) AS duplicate_keys
       FROM (SELECT COUNT(*) AS n FROM events GROUP BY CAST(ts AS DATE), user_id, event_type)""",
)
def _(spark, sf_dir):
    return quality.duplicate_keys(tables.event_observations(spark, sf_dir))


@query(
    "missing_values",
    q.with_(
        RAW_TEXT,
        """SELECT type, GROUPING(type) = 1 AS total, COUNT(*) AS rows, COUNT(*) FILTER (WHERE value IS NULL) AS missing,
                  ROUND(COUNT(*) FILTER (WHERE value IS NULL) / COUNT(*) * 100, 4) AS pct
           FROM raw GROUP BY ROLLUP (type)""",
    ),
)
def _(spark, sf_dir):
    return quality.missing_values(pages.normalise_rows(tables.order_rows(spark, sf_dir), "orders"))


NEGATIVE_BY_ENTITY = q.with_(
    q.OBS,
    "SELECT type, respondent, COUNT(*) AS n FROM obs WHERE value < 0 AND type <> 'NG' GROUP BY 1, 2",
)


@query("negative_values", NEGATIVE_BY_ENTITY)
def _(spark, sf_dir):
    return quality.negative_values(observations(spark, sf_dir), ["NG"])


@query("negative_top_entities", f"SELECT respondent, CAST(SUM(n) AS BIGINT) AS n FROM ({NEGATIVE_BY_ENTITY}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf_dir):
    return quality.top_entities(quality.negative_values(observations(spark, sf_dir), ["NG"]))


def _discount_rows(spark, sf_dir):
    """Discount of each line as a demand value, zero where no discount was given."""
    lines = tables.table(spark, sf_dir, "lineitem")
    return lines.select(
        F.to_date("l_shipdate").alias("period"),
        F.col("l_suppkey").cast("string").alias("respondent"),
        F.lit("D").alias("type"),
        F.col("l_discount").alias("value"),
    )


ZERO_SQL = """SELECT CAST(l_suppkey AS VARCHAR) AS respondent, COUNT(*) AS n FROM lineitem
              WHERE l_discount = 0 GROUP BY 1"""


@query("zero_demand", ZERO_SQL)
def _(spark, sf_dir):
    return quality.zero_demand(_discount_rows(spark, sf_dir))


@query("zero_demand_top_entities", ZERO_SQL + " ORDER BY n DESC, respondent LIMIT 10")
def _(spark, sf_dir):
    return quality.top_entities(quality.zero_demand(_discount_rows(spark, sf_dir)))


def _coverage(spark, sf_dir):
    regions = tables.table(spark, sf_dir, "region").select(F.col("r_name").alias("respondent"))
    return quality.build_coverage(region_observations(spark, sf_dir), regions)


@query("coverage_matrix", q.with_(q.COVERAGE, "SELECT * FROM coverage"))
def _(spark, sf_dir):
    return _coverage(spark, sf_dir)


MIN_COVERAGE = 50.0


def _selected(spark, sf_dir):
    return quality.select_entities(_coverage(spark, sf_dir), MIN_COVERAGE)


@query("aggregate_exclusion", q.with_(q.COVERAGE, "SELECT respondent FROM coverage WHERE role <> 'aggregate'"))
def _(spark, sf_dir):
    members = _coverage(spark, sf_dir)
    aggregates = members.filter(F.col("role") == quality.AGGREGATE_ROLE)
    return members.join(aggregates, "respondent", "left_anti").select("respondent")


@query("modeling_set", q.with_(q.COVERAGE, "SELECT respondent FROM coverage WHERE role <> 'aggregate' AND coverage_pct >= 50"))
def _(spark, sf_dir):
    return _selected(spark, sf_dir).filter("selection = 'keep'").select("respondent")


@query("approved_entities", q.with_(q.COVERAGE, "SELECT respondent FROM coverage WHERE role <> 'aggregate' AND coverage_pct >= 50"))
def _(spark, sf_dir):
    """The gate's result saved, its approved entities read back."""
    path = _scratch(spark, "validation")
    regions = tables.table(spark, sf_dir, "region").select(F.col("r_name").alias("respondent"))
    sinks.save_validation(quality.validate(region_observations(spark, sf_dir), MIN_COVERAGE, aggregates=regions), path)
    return sinks.read_approved(spark, path)


@query(
    "low_coverage",
    q.with_(
        q.COVERAGE,
        """SELECT respondent, coverage_pct, days, first_day, last_day FROM coverage
           WHERE role <> 'aggregate' AND coverage_pct < 50""",
    ),
)
def _(spark, sf_dir):
    low = _selected(spark, sf_dir).filter("selection = 'low_coverage'")
    return low.select("respondent", "coverage_pct", "days", "first_day", "last_day")


@query(
    "interior_gaps",
    q.with_(
        q.COVERAGE,
        """SELECT respondent, interior_gaps FROM coverage
           WHERE role <> 'aggregate' AND coverage_pct >= 50 AND interior_gaps > 0""",
    ),
)
def _(spark, sf_dir):
    return _selected(spark, sf_dir).filter("selection = 'keep' and interior_gaps > 0").select("respondent", "interior_gaps")


@query("leakage_watch", q.with_(q.OBS, "SELECT BOOL_OR(type = 'D') AND BOOL_OR(type = 'DF') AS forecast_present FROM obs"))
def _(spark, sf_dir):
    return quality.leakage_watch(observations(spark, sf_dir))


VALIDATION_SQL = (
    q.COVERAGE
    + """,
t AS (
  SELECT (SELECT COUNT(*) FROM obs) AS rows,
         (SELECT COUNT(*) FROM obs WHERE value < 0 AND type NOT IN ('TI', 'NG')) AS negatives,
         (SELECT COUNT(*) FROM obs WHERE value = 0 AND type = 'D') AS zeros,
         (SELECT COUNT(*) FROM obs WHERE value IS NULL) AS missing,
         (SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT COUNT(*) AS n FROM obs GROUP BY period, respondent, type)) AS duplicates,
         (SELECT COUNT(*) FROM coverage WHERE role = 'aggregate') AS aggregates,
         (SELECT COUNT(*) FROM coverage WHERE role <> 'aggregate' AND coverage_pct >= 50) AS keep,
         (SELECT COUNT(*) FROM coverage WHERE role <> 'aggregate' AND coverage_pct < 50) AS low,
         (SELECT COUNT(*) FROM coverage WHERE role <> 'aggregate' AND coverage_pct >= 50 AND interior_gaps > 0) AS gapped
)"""
)


def _validated(spark, sf_dir):
    regions = tables.table(spark, sf_dir, "region").select(F.col("r_name").alias("respondent"))
    return quality.validate(region_observations(spark, sf_dir), MIN_COVERAGE, aggregates=regions)


@query(
    "validation_findings",
    q.with_(
        VALIDATION_SQL,
        """SELECT 'units' AS "check", 'INFO' AS severity, NULL AS n FROM t
           UNION ALL SELECT 'duplicates', CASE WHEN duplicates > 0 THEN 'ERROR' ELSE 'INFO' END,
                            CASE WHEN duplicates > 0 THEN CAST(duplicates AS VARCHAR) END FROM t
           UNION ALL SELECT 'timezone', 'INFO', NULL FROM t
           UNION ALL SELECT 'missing_values', CASE WHEN missing > 0 THEN 'WARNING' ELSE 'INFO' END,
                            CASE WHEN missing > 0 THEN CAST(missing AS VARCHAR) END FROM t
           UNION ALL SELECT 'negative_values', CASE WHEN negatives > 0 THEN 'WARNING' ELSE 'INFO' END,
                            CASE WHEN negatives > 0 THEN CAST(negatives AS VARCHAR) END FROM t
           UNION ALL SELECT 'zero_demand', CASE WHEN zeros > 0 THEN 'WARNING' ELSE 'INFO' END,
                            CASE WHEN zeros > 0 THEN CAST(zeros AS VARCHAR) END FROM t
           UNION ALL SELECT 'aggregates', 'INFO', CAST(aggregates AS VARCHAR) FROM t
           UNION ALL SELECT 'coverage', 'WARNING', CAST(low AS VARCHAR) FROM t WHERE low > 0
           UNION ALL SELECT 'interior_gaps', 'WARNING', CAST(gapped AS VARCHAR) FROM t WHERE gapped > 0
           UNION ALL SELECT 'coverage', 'INFO', CAST(keep AS VARCHAR) FROM t
           UNION ALL SELECT 'leakage_watch', 'INFO', NULL FROM t""",
    ),
)
def _(spark, sf_dir):
    details = F.col("details")
    number = F.coalesce(*[details[k] for k in ("count", "excluded", "respondents", "n_selected")])
    return _validated(spark, sf_dir).findings.select("check", "severity", number.alias("n"))


@query(
    "validation_verdict",
    q.with_(
        VALIDATION_SQL,
        """SELECT duplicates = 0 AS passed, CAST(duplicates > 0 AS BIGINT) AS n_errors,
                  CAST(missing > 0 AS BIGINT) + CAST(negatives > 0 AS BIGINT) + CAST(zeros > 0 AS BIGINT)
                  + CAST(low > 0 AS BIGINT) + CAST(gapped > 0 AS BIGINT) AS n_warnings, rows AS row_count FROM t""",
    ),
)
def _(spark, sf_dir):
    return _validated(spark, sf_dir).verdict


# ------------------------------------------------------------------ features


@query(
    "tier_lookup",
    """SELECT n_name AS respondent, CASE WHEN n_nationkey <= 5 THEN 'Large' WHEN n_nationkey <= 15 THEN 'Medium'
              ELSE 'Unknown' END AS tier, COUNT(*) AS suppliers
       FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    nations = tables.table(spark, sf_dir, "nation")
    suppliers = tables.table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    known = tables.nation_tiers(spark, sf_dir).filter("tier <> 'Small'")
    counts = suppliers.groupBy(F.col("n_name").alias("respondent")).agg(F.count(F.lit(1)).alias("suppliers"))
    return features.assign_tier(counts, known).select("respondent", "tier", "suppliers")


@query(
    "tier_by_threshold",
    q.with_(
        q.PANEL,
        """SELECT respondent, ROUND(AVG(demand), 4) AS mean_demand, CASE WHEN AVG(demand) >= 100000 THEN 'Large'
                  WHEN AVG(demand) >= 80000 THEN 'Medium' ELSE 'Small' END AS tier FROM panel GROUP BY 1""",
    ),
)
def _(spark, sf_dir):
    return rounded(features.tier_by_threshold(wide(spark, sf_dir, "demand"), 100_000, 80_000), 4, "mean_demand")


@query("daily_reindex", q.with_(q.DAILY, "SELECT * FROM daily"))
def _(spark, sf_dir):
    return panel.reindex_daily(wide(spark, sf_dir))


def _windowed(spark, sf_dir, columns, *series):
    daily = panel.reindex_daily(wide(spark, sf_dir, *series))
    return daily.select("respondent", "period", *[c.alias(n) for n, c in columns.items()])


def _window_sql(columns: str) -> str:
    return q.with_(
        q.DAILY, f"SELECT respondent, period, {columns} FROM daily WINDOW w AS (PARTITION BY respondent ORDER BY period)"
    )


@query(
    "next_day_target",
    q.with_(
        q.DAILY,
        """SELECT respondent, period, period + 1 AS target_date, LEAD(demand) OVER w AS target,
                  LEAD(demand_forecast) OVER w AS benchmark_forecast, demand AS naive_persistence
           FROM daily WINDOW w AS (PARTITION BY respondent ORDER BY period)""",
    ),
)
def _(spark, sf_dir):
    return _windowed(spark, sf_dir, {"target_date": F.date_add("period", 1), **features.next_day_columns()})


@query("demand_lags", _window_sql("demand AS demand_t, " + q.lags("demand", [1, 2, 6, 7, 13, 14, 364], "demand")))
def _(spark, sf_dir):
    return _windowed(spark, sf_dir, features.demand_lag_columns(), "demand")


@query("rolling_statistics", _window_sql(q.ROLLING))
def _(spark, sf_dir):
    return rounded_features(_windowed(spark, sf_dir, features.rolling_columns(), "demand"))


@query("rolling_trend", _window_sql(q.TRENDS))
def _(spark, sf_dir):
    return rounded_features(_windowed(spark, sf_dir, features.trend_columns()))


EXOGENOUS = (
    "net_generation AS net_generation_t, "
    + q.lags("net_generation", [1, 7], "net_generation")
    + ", interchange AS interchange_t, "
    + q.lags("interchange", [1, 7], "interchange")
)


@query("exogenous_lags", _window_sql(EXOGENOUS))
def _(spark, sf_dir):
    return _windowed(spark, sf_dir, features.exogenous_columns())


def _order_days(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("target_date"))


@query("calendar_parts", f"SELECT o_orderkey, target_date, {q.CALENDAR} FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS target_date FROM orders)")
def _(spark, sf_dir):
    return _order_days(spark, sf_dir).withColumns(calendar_parts(F.col("target_date")))


@query("cyclical_parts", f"SELECT o_orderkey, target_date, {q.CYCLICAL} FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS target_date FROM orders)")
def _(spark, sf_dir):
    return rounded_features(_order_days(spark, sf_dir).withColumns(cyclical_parts(F.col("target_date"))))


ORDER_YEARS = "holiday_range AS (SELECT MIN(YEAR(o_orderdate)) AS a, MAX(YEAR(o_orderdate)) AS b FROM orders),"


@query(
    "federal_holidays",
    q.with_(
        ORDER_YEARS + q.HOLIDAYS,
        """SELECT day, MIN(holiday) AS holiday FROM holidays, holiday_range
           WHERE YEAR(day) BETWEEN a - 1 AND b + 1 GROUP BY day""",
    ),
)
def _(spark, sf_dir):
    return features.holiday_calendar(tables.table(spark, sf_dir, "orders"), "o_orderdate")


@query(
    "holiday_flags",
    q.with_(
        ORDER_YEARS + q.HOLIDAYS,
        f"""SELECT o_orderkey, target_date, {q.holiday_flags('target_date')}
            FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS target_date FROM orders)""",
    ),
)
def _(spark, sf_dir):
    return _order_days(spark, sf_dir).withColumns(holiday_flags("target_date"))


MATRIX = (
    "holiday_range AS (SELECT MIN(YEAR(l_shipdate)) AS a, MAX(YEAR(l_shipdate)) + 1 AS b FROM lineitem),"
    + q.HOLIDAYS + ", " + q.DAILY
    + f""",
tiers AS (SELECT n_name AS respondent, {q.TIER_CASE} AS tier FROM nation),
shifted AS (
  SELECT period AS forecast_date, period + 1 AS target_date, respondent,
         LEAD(demand) OVER w AS target, LEAD(demand_forecast) OVER w AS benchmark_forecast,
         demand AS naive_persistence, demand AS demand_t,
         {q.lags("demand", [1, 2, 6, 7, 13, 14, 364], "demand")}, {q.ROLLING}, {q.TRENDS}, {EXOGENOUS}
  FROM daily WINDOW w AS (PARTITION BY respondent ORDER BY period)
),
matrix AS (
  SELECT s.*, tier, {q.CALENDAR}, {q.CYCLICAL}, {q.holiday_flags('target_date')}
  FROM shifted s JOIN tiers USING (respondent) WHERE target IS NOT NULL
)"""
)


@query("feature_matrix", q.with_(MATRIX, "SELECT * FROM matrix"))
def _(spark, sf_dir):
    return rounded_features(feature_table(spark, sf_dir))


# ------------------------------------------------------------------ splits and folds

SPLIT_KEYS = "respondent, target_date, split"


@query("chronological_split", q.with_(q.SPLITS, f"SELECT {SPLIT_KEYS} FROM split_features"))
def _(spark, sf_dir):
    return split_predicted(spark, sf_dir).select("respondent", "target_date", "split")


@query(
    "split_leakage_check",
    q.with_(
        q.SPLITS,
        """SELECT MAX(target_date) FILTER (WHERE split = 'train') < MIN(target_date) FILTER (WHERE split = 'val')
              AND MAX(target_date) FILTER (WHERE split = 'val') < MIN(target_date) FILTER (WHERE split = 'test') AS clean
           FROM split_features""",
    ),
)
def _(spark, sf_dir):
    return splits.split_is_clean(split_predicted(spark, sf_dir))


@query(
    "split_profile",
    q.with_(
        q.SPLITS,
        """SELECT split, COUNT(*) AS rows, MIN(target_date) AS first_date, MAX(target_date) AS last_date
           FROM split_features GROUP BY split""",
    ),
)
def _(spark, sf_dir):
    return splits.split_profile(split_predicted(spark, sf_dir))


FOLDS = (
    q.FEATURES
    + """,
dates AS (SELECT target_date AS d, ROW_NUMBER() OVER (ORDER BY target_date) AS i FROM (SELECT DISTINCT target_date FROM features)),
sizes AS (SELECT COUNT(*) AS n, GREATEST(CAST(FLOOR(COUNT(*) * CAST(0.5 AS DOUBLE)) AS BIGINT), 2) AS initial FROM dates),
steps AS (SELECT n, initial, (n - initial) // 3 AS size, UNNEST([0, 1, 2]) AS fold FROM sizes),
edges AS (SELECT fold, initial + fold * size AS a, CASE WHEN fold = 2 THEN n ELSE initial + (fold + 1) * size END AS b FROM steps),
folds AS (
  SELECT CAST(fold AS INTEGER) AS fold, (SELECT d FROM dates WHERE i = a) AS train_end,
         (SELECT d FROM dates WHERE i = a + 1) AS val_start, (SELECT d FROM dates WHERE i = b) AS val_end FROM edges
)"""
)


@query("walk_forward_folds", q.with_(FOLDS, "SELECT * FROM folds"))
def _(spark, sf_dir):
    return splits.walk_forward_folds(feature_table(spark, sf_dir))


@query(
    "fold_assignment",
    q.with_(
        FOLDS,
        """SELECT respondent, target_date, fold, CASE WHEN target_date <= train_end THEN 'train' ELSE 'val' END AS role
           FROM features JOIN folds ON target_date <= train_end OR target_date BETWEEN val_start AND val_end""",
    ),
)
def _(spark, sf_dir):
    return splits.assign_folds(stored_features(spark, sf_dir)).select("respondent", "target_date", "fold", "role")


@query(
    "nearest_quantile_split",
    q.with_(
        q.PANEL
        + """, dates AS (SELECT period AS d, ROW_NUMBER() OVER (ORDER BY period) - 1 AS i, COUNT(*) OVER () AS n
                         FROM (SELECT DISTINCT period FROM panel)),
        cuts AS (SELECT MAX(d) FILTER (WHERE i <= ROUND_EVEN((n - 1) * CAST(0.70 AS DOUBLE), 0)) AS a,
                        MAX(d) FILTER (WHERE i <= ROUND_EVEN((n - 1) * CAST(0.85 AS DOUBLE), 0)) AS b FROM dates)""",
        """SELECT split, COUNT(*) AS rows, MIN(period) AS first_date, MAX(period) AS last_date
           FROM (SELECT period, CASE WHEN period <= a THEN 'train' WHEN period <= b THEN 'val' ELSE 'test' END AS split
                 FROM panel, cuts) GROUP BY split""",
    ),
)
def _(spark, sf_dir):
    return splits.split_profile(splits.split_nearest_quantile(stored_wide(spark, sf_dir)), "period")


@query("monitoring_windows", q.with_(q.WINDOWS, 'SELECT respondent, target_date, win AS "window" FROM windowed'))
def _(spark, sf_dir):
    return splits.monitoring_windows(stored_features(spark, sf_dir)).select("respondent", "target_date", "window")


@query(
    "tuning_pool",
    q.with_(q.SPLITS, "SELECT respondent, target_date, tier, target FROM split_features WHERE split <> 'test'"),
)
def _(spark, sf_dir):
    pool = splits.train_and_validation(split_predicted(spark, sf_dir))
    return pool.select("respondent", "target_date", "tier", "target")


# ------------------------------------------------------------------ baselines, guardrail, metrics


@query("naive_baseline", q.with_(q.FEATURES, "SELECT respondent, target_date, naive_persistence AS prediction FROM features"))
def _(spark, sf_dir):
    return scoring.naive_forecast(feature_table(spark, sf_dir)).select("respondent", "target_date", "prediction")


@query("published_baseline", q.with_(q.FEATURES, "SELECT respondent, target_date, benchmark_forecast AS prediction FROM features"))
def _(spark, sf_dir):
    return scoring.benchmark_forecast(feature_table(spark, sf_dir)).select("respondent", "target_date", "prediction")


@query(
    "guardrail",
    q.with_(
        q.FALLBACK,
        """SELECT tier, respondent, ROUND(model_mae, 4) AS model_mae, ROUND(naive_mae, 4) AS naive_mae,
                  model_mae > naive_mae AS fallback FROM guard""",
    ),
)
def _(spark, sf_dir):
    val = split_predicted(spark, sf_dir).filter("split = 'val'")
    return rounded(scoring.guardrail(val, "demand_lag_6"), 4, "model_mae", "naive_mae")


@query("fallback_prediction", q.with_(q.FALLBACK, "SELECT respondent, target_date, prediction FROM scored"))
def _(spark, sf_dir):
    return with_fallback(spark, sf_dir).select("respondent", "target_date", "prediction")


@query("tier_metrics", q.with_(q.FEATURES, "SELECT * EXCLUDE (approach) FROM (" + q.comparison("features", {"m": "prediction"}) + ")"))
def _(spark, sf_dir):
    return metrics.evaluate(predicted(spark, sf_dir), "prediction")


TEST_SCORED = q.FALLBACK + ", test_scored AS (SELECT * FROM scored WHERE split = 'test')"


@query("three_way_comparison", q.with_(TEST_SCORED, q.comparison("test_scored", APPROACHES)))
def _(spark, sf_dir):
    return metrics.compare_predictions(with_fallback(spark, sf_dir).filter("split = 'test'"), APPROACHES)


def _val_and_test(spark, sf_dir):
    columns = ["split", "tier", "target", "prediction"]
    df = cut_lineage(split_predicted(spark, sf_dir).filter("split <> 'train'").select(*columns))
    return (
        metrics.evaluate(df.filter("split = 'val'"), "prediction"),
        metrics.evaluate(df.filter("split = 'test'"), "prediction"),
    )


VAL_TEST = (
    q.SPLITS
    + ", val_rows AS (SELECT * FROM split_features WHERE split = 'val'), test_rows AS (SELECT * FROM split_features WHERE split = 'test'),"
    + "old AS (" + q.comparison("val_rows", {"m": "prediction"}) + "), new AS (" + q.comparison("test_rows", {"m": "prediction"}) + ")"
)


@query(
    "metric_delta",
    q.with_(
        VAL_TEST,
        """SELECT tier, old.smape AS prior_smape, new.smape AS new_smape, ROUND(new.smape - old.smape, 2) AS delta_smape,
                  old.wmape AS prior_wmape, new.wmape AS new_wmape, ROUND(new.wmape - old.wmape, 2) AS delta_wmape
           FROM old JOIN new USING (tier)""",
    ),
)
def _(spark, sf_dir):
    val, test = _val_and_test(spark, sf_dir)
    return rounded(metrics.delta_report(val, test), 2, "delta_smape", "delta_wmape")


@query(
    "promotion_gate",
    q.with_(
        VAL_TEST,
        """SELECT COUNT(*) FILTER (WHERE new.wmape - old.wmape > 2.0) = 0 AS promote, COUNT(*) AS tiers_compared,
                  COALESCE(STRING_AGG(tier, ',' ORDER BY tier) FILTER (WHERE new.wmape - old.wmape > 2.0), '') AS regressions,
                  ROUND(MAX(new.wmape - old.wmape), 2) AS worst_delta FROM old JOIN new USING (tier)
           WHERE old.wmape IS NOT NULL AND new.wmape IS NOT NULL""",
    ),
)
def _(spark, sf_dir):
    val, test = _val_and_test(spark, sf_dir)
    return rounded(metrics.promotion_gate(test, val), 2, "worst_delta")


@query(
    "win_rate",
    q.with_(
        q.FEATURES
        + """, per_entity AS (
          SELECT tier, respondent, AVG(ABS(target - prediction)) AS m, AVG(ABS(target - naive_persistence)) AS b
          FROM features WHERE prediction IS NOT NULL AND naive_persistence IS NOT NULL GROUP BY 1, 2)""",
        """SELECT CASE WHEN GROUPING(tier) = 1 THEN 'Overall' ELSE tier END AS tier, COUNT(*) FILTER (WHERE m < b) AS wins,
                  COUNT(*) AS entities, ROUND(COUNT(*) FILTER (WHERE m < b) / COUNT(*) * 100, 2) AS win_pct
           FROM per_entity GROUP BY GROUPING SETS ((tier), ())""",
    ),
)
def _(spark, sf_dir):
    return metrics.win_rate(predicted(spark, sf_dir), "prediction")


@query(
    "metric_log_rows",
    q.with_(
        q.FEATURES + ", m AS (" + q.comparison("features", {"model": "prediction", "naive": "naive_persistence"}) + ")",
        " UNION ALL ".join(
            f"SELECT approach || '_' || LOWER(tier) || '_{m}' AS name, CAST({m} AS DOUBLE) AS value FROM m WHERE {m} IS NOT NULL"
            for m in ("mae", "smape", "wmape", "r2", "n_samples")
        ),
    ),
)
def _(spark, sf_dir):
    table = metrics.compare_predictions(
        predicted(spark, sf_dir), {"model": "prediction", "naive": "naive_persistence"}
    )
    return metrics.flatten_metrics(
        {f"{name}_": table.filter(F.col("approach") == name) for name in ("model", "naive")}
    )


@query("evaluation_period", q.with_(q.SPLITS, """SELECT MIN(target_date) AS start, MAX(target_date) AS "end", COUNT(*) AS rows FROM split_features WHERE split = 'test'"""))
def _(spark, sf_dir):
    return metrics.evaluation_period(split_predicted(spark, sf_dir).filter("split = 'test'"))


# ------------------------------------------------------------------ drift and monitoring

DRIFT_NUMERIC = [*NUMERIC_FEATURES, "target", "prediction"]


def _windows(spark, sf_dir):
    """Rows of both windows as a written table: drift reads them several times."""
    return cut_lineage(splits.monitoring_windows(with_prediction(rounded_features(stored_features(spark, sf_dir)))))


MATRIX_WINDOWS = (
    MATRIX
    + """,
bounds AS (SELECT MAX(target_date) - 30 AS split, MAX(target_date) - 120 AS start FROM matrix),
windowed AS (
  SELECT f.*, (demand_t + demand_lag_6) / 2 AS prediction, CASE WHEN target_date >= split THEN 'current' ELSE 'reference' END AS win
  FROM matrix f, bounds WHERE target_date >= start
)"""
)


LONG = "long_values AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, win, CAST({c} AS DOUBLE) AS value FROM windowed WHERE {c} IS NOT NULL" for c in DRIFT_NUMERIC
) + ")"
ECDF = (
    MATRIX_WINDOWS
    + ","
    + LONG
    + """,
counts AS (SELECT feature, value, COUNT(*) FILTER (WHERE win = 'reference') AS r, COUNT(*) FILTER (WHERE win = 'current') AS c
           FROM long_values GROUP BY 1, 2),
curve AS (
  SELECT feature, value, LEAD(value) OVER w AS next_value,
         SUM(r) OVER w / NULLIF(SUM(r) OVER f, 0) AS fr, SUM(c) OVER w / NULLIF(SUM(c) OVER f, 0) AS fc, SUM(r) OVER f AS nr, SUM(c) OVER f AS nc
  FROM counts WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY feature)
),
ks AS (
  SELECT feature, CAST(MAX(nr) AS BIGINT) AS n_reference, CAST(MAX(nc) AS BIGINT) AS n_current,
         MAX(ABS(fr - fc)) AS d, CASE WHEN MAX(nr) > 0 AND MAX(nc) > 0 THEN COALESCE(SUM(ABS(fr - fc) * (next_value - value)), 0) END AS w
  FROM curve GROUP BY feature
),
spread AS (SELECT feature, STDDEV_POP(value) AS s FROM long_values WHERE win = 'reference' GROUP BY feature),
scaled AS (
  SELECT ks.*, w / GREATEST(s, 0.001) AS wn,
         (SQRT(CAST(n_reference AS DOUBLE) * n_current / (n_reference + n_current)) + 0.12
          + 0.11 / SQRT(CAST(n_reference AS DOUBLE) * n_current / (n_reference + n_current))) * d AS x
  FROM ks JOIN spread USING (feature)
),
p AS (
  SELECT l.*, CASE WHEN x IS NULL THEN NULL WHEN x < 0.2 THEN 1.0 ELSE GREATEST(0.0, LEAST(1.0,
           (SELECT SUM(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * EXP(-2.0 * j * j * x * x)) FROM RANGE(1, 101) AS r(j)))) END AS p_value
  FROM scaled l
),
numeric_drift AS (
  SELECT feature, COALESCE(n_reference, 0) AS n_reference, COALESCE(n_current, 0) AS n_current, d AS ks_statistic, p_value,
         w AS wasserstein, wn AS wasserstein_norm, 'ks' AS method, p_value AS score, coalesce(p_value < 0.05, false) AS ks_drifted,
         coalesce(wn >= 0.1, false) AS distance_drifted, coalesce(p_value < 0.05, false) AS drifted
  FROM (SELECT UNNEST([""" + ", ".join(f"'{c}'" for c in DRIFT_NUMERIC) + """]) AS feature) LEFT JOIN p USING (feature)
)"""
)


@query(
    "numeric_drift",
    q.with_(
        ECDF,
        """SELECT feature, n_reference, n_current, ROUND(ks_statistic, 6) AS ks_statistic, ROUND(p_value, 6) AS p_value,
                  ROUND(wasserstein, 2) AS wasserstein, ROUND(wasserstein_norm, 6) AS wasserstein_norm, method,
                  ROUND(score, 6) AS score, ks_drifted, distance_drifted, drifted FROM numeric_drift""",
    ),
)
def _(spark, sf_dir):
    out = drift.numeric_drift(_windows(spark, sf_dir), DRIFT_NUMERIC)
    return rounded(rounded(out, 6, "ks_statistic", "p_value", "wasserstein_norm", "score"), 2, "wasserstein")


CATEGORICAL_SQL = """
category_counts AS (
  SELECT feature, category, COUNT(*) FILTER (WHERE win = 'reference') AS r, COUNT(*) FILTER (WHERE win = 'current') AS c
  FROM (SELECT 'respondent' AS feature, respondent AS category, win FROM windowed
        UNION ALL SELECT 'tier', tier, win FROM windowed) GROUP BY 1, 2
),
shares AS (
  SELECT *, CAST(SUM(r) OVER f AS DOUBLE) AS nr, CAST(SUM(c) OVER f AS DOUBLE) AS nc FROM category_counts WINDOW f AS (PARTITION BY feature)
),
pq AS (SELECT *, r / nr AS p, c / nc AS q, (r / nr + c / nc) / 2 AS m, (r + c) * nr / (nr + nc) AS er, (r + c) * nc / (nr + nc) AS ec FROM shares),
categorical_drift AS (
  SELECT feature, CAST(MAX(nr) AS BIGINT) AS n_reference, CAST(MAX(nc) AS BIGINT) AS n_current,
         SUM((r - er) ** 2 / er + (c - ec) ** 2 / ec) AS chi_square,
         SQRT(GREATEST(SUM((CASE WHEN p > 0 THEN p * LOG2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * LOG2(q / m) ELSE 0 END) / 2), 0.0)) AS js_distance,
         COUNT(*) AS categories
  FROM pq GROUP BY feature
)"""


@query(
    "categorical_drift",
    q.with_(
        q.WINDOWS + "," + CATEGORICAL_SQL,
        """SELECT feature, n_reference, n_current, ROUND(chi_square, 6) AS chi_square, ROUND(js_distance, 6) AS js_distance,
                  categories, js_distance >= 0.1 AS drifted FROM categorical_drift""",
    ),
)
def _(spark, sf_dir):
    out = drift.categorical_drift(_windows(spark, sf_dir), ["respondent", "tier"])
    return rounded(out, 6, "chi_square", "js_distance")


DATASET = (
    ECDF
    + ","
    + CATEGORICAL_SQL
    + """,
column_drift AS (
  SELECT feature, method, score, drifted FROM numeric_drift
  UNION ALL SELECT feature, 'jensen_shannon', js_distance, js_distance >= 0.1 FROM categorical_drift WHERE feature = 'respondent'
)"""
)


@query(
    "dataset_drift",
    q.with_(
        DATASET,
        """SELECT COUNT(*) AS total_features, COUNT(*) FILTER (WHERE drifted) AS drifted_features,
                  ROUND(COUNT(*) FILTER (WHERE drifted) / COUNT(*), 4) AS drift_share,
                  COUNT(*) FILTER (WHERE drifted) / COUNT(*) >= 0.3 AS dataset_drift FROM column_drift""",
    ),
)
def _(spark, sf_dir):
    df = _windows(spark, sf_dir)
    return drift.dataset_drift(drift.column_drift(df, drift.drift_columns(df)))


@query(
    "target_drift",
    q.with_(DATASET, "SELECT feature, method, ROUND(score, 6) AS score, drifted FROM column_drift WHERE feature = 'target'"),
)
def _(spark, sf_dir):
    df = _windows(spark, sf_dir)
    columns = drift.column_drift(df, drift.drift_columns(df))
    return rounded(drift.target_drift(columns), 6, "score")


PROFILE = ["demand", "demand_forecast", "net_generation", "interchange"]


def _profile_sql(column: str, source: str = "windowed") -> str:
    return f"""SELECT '{column}' AS feature, COUNT(*) AS rows, COUNT(*) - COUNT({column}) AS missing,
      ROUND(AVG({column}), 4) AS mean, ROUND(STDDEV_SAMP({column}), 2) AS std, COUNT(DISTINCT {column}) AS "distinct",
      MIN({column}) AS min, MAX({column}) AS max, QUANTILE_CONT({column}, 0.25) AS q25, QUANTILE_CONT({column}, 0.5) AS q50,
      QUANTILE_CONT({column}, 0.75) AS q75,
      ROUND((SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY {column})) / COUNT({column}), 8) AS top_share
      FROM {source}"""


@query("quality_profile", q.with_(MATRIX_WINDOWS, " UNION ALL ".join(_profile_sql(c) for c in DRIFT_NUMERIC)))
def _(spark, sf_dir):
    out = drift.quality_profile(_windows(spark, sf_dir), DRIFT_NUMERIC)
    return rounded(rounded(rounded(out, 4, "mean"), 2, "std"), 8, "top_share")


@query(
    "regression_quality",
    q.with_(
        q.WINDOWS,
        """SELECT win AS "window", COUNT(*) AS n_samples, ROUND(AVG(prediction - target), 4) AS mean_error,
                  ROUND(AVG(ABS(prediction - target)), 4) AS mae, ROUND(SQRT(AVG((prediction - target) ** 2)), 4) AS rmse,
                  ROUND(AVG(ABS(prediction - target) / NULLIF(target, 0)) * 100, 4) AS mape,
                  ROUND(100 * SUM(ABS(prediction - target)) / (SUM(ABS(target)) + 1e-8), 4) AS wmape,
                  MAX(ABS(prediction - target)) AS max_error
           FROM windowed WHERE prediction IS NOT NULL GROUP BY win""",
    ),
)
def _(spark, sf_dir):
    out = drift.regression_quality(_windows(spark, sf_dir))
    return rounded(out, 4, "mean_error", "mae", "rmse", "mape", "wmape")


@query(
    "drift_summary",
    q.with_(
        # Every compared column is taken where the first one (the entity) is present: all rows.
        DATASET
        + """, s AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE drifted) AS n, BOOL_OR(drifted) FILTER (WHERE feature = 'target') AS td,
                     MAX(score) FILTER (WHERE feature = 'target') AS ts FROM column_drift),
        b AS (SELECT MIN(target_date) FILTER (WHERE win = 'reference') AS a1, MAX(target_date) FILTER (WHERE win = 'reference') AS a2,
                     MIN(target_date) FILTER (WHERE win = 'current') AS b1, MAX(target_date) FILTER (WHERE win = 'current') AS b2,
                     100 * SUM(ABS(target - prediction)) FILTER (WHERE win = 'reference')
                       / (SUM(ABS(target)) FILTER (WHERE win = 'reference' AND prediction IS NOT NULL) + 1e-8) AS w1,
                     100 * SUM(ABS(target - prediction)) FILTER (WHERE win = 'current')
                       / (SUM(ABS(target)) FILTER (WHERE win = 'current' AND prediction IS NOT NULL) + 1e-8) AS w2 FROM windowed)""",
        """SELECT a1 AS reference_start_date, a2 AS reference_end_date, b1 AS current_start_date, b2 AS current_end_date,
                  total AS total_features_evaluated, n AS drifted_features_count, ROUND(n / total, 4) AS share_of_drifted_features,
                  n / total >= 0.3 AS dataset_drift_detected, td AS target_drift_detected, ROUND(ts, 4) AS target_drift_score,
                  ROUND(w1, 4) AS wmape_reference, ROUND(w2, 4) AS wmape_current FROM s, b""",
    ),
)
def _(spark, sf_dir):
    df = _windows(spark, sf_dir)
    out = drift.drift_summary(df, drift.drift_columns(df), prediction="prediction")
    return rounded(out, 4, "wmape_reference", "wmape_current")


@query(
    "repeated_keys",
    """SELECT CAST(ts AS DATE) AS period, CAST(user_id AS VARCHAR) AS respondent, event_type AS type, COUNT(*) AS n
       FROM events GROUP BY 1, 2, 3 HAVING COUNT(*) > 1""",
)
def _(spark, sf_dir):
    return quality.repeated_keys(tables.event_observations(spark, sf_dir))


TWO_LABELS = """
WITH k AS (SELECT CAST(ts AS DATE) AS p, user_id AS r, event_type AS t, COUNT(*) AS n FROM events GROUP BY 1, 2, 3)"""


@query(
    "failed_validation",
    TWO_LABELS
    + """ SELECT 'duplicates' AS "check", 'ERROR' AS severity, CAST(SUM(n - 1) AS DOUBLE) AS number FROM k
          UNION ALL SELECT 'timezone', 'ERROR', CAST(COUNT(DISTINCT CASE WHEN user_id % 2 = 0 THEN 'UTC' ELSE 'CET' END) AS DOUBLE) FROM events""",
)
def _(spark, sf_dir):
    """Rows with repeated keys and two time zones: the errors of the gate."""
    df = tables.event_observations(spark, sf_dir).withColumn(
        "timezone", F.when(F.col("respondent").cast("long") % 2 == 0, "UTC").otherwise("CET")
    )
    findings = quality.validate(df, exclude_aggregates=False).findings.filter("check in ('duplicates', 'timezone')")
    return findings.select("check", "severity", F.coalesce(F.col("details")["count"], F.col("details")["distinct"]).cast("double").alias("number"))


@query("mixed_units", """SELECT 'units' AS "check", 'ERROR' AS severity, CAST(COUNT(DISTINCT event_type) AS DOUBLE) AS number FROM events""")
def _(spark, sf_dir):
    """Mixed units stop the gate: the only finding."""
    df = tables.event_observations(spark, sf_dir).withColumn("value_units", F.col("type"))
    findings = quality.validate(df).findings
    return findings.select("check", "severity", F.col("details")["distinct"].cast("double").alias("number"))


# ------------------------------------------------------------------ lookups


@query(
    "entities_by_tier",
    f"""WITH t AS (SELECT s_name AS respondent, {q.TIER_CASE} AS tier FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT tier, respondent, COUNT(*) OVER (PARTITION BY tier) AS tier_regions, COUNT(*) OVER () AS total_regions FROM t""",
)
def _(spark, sf_dir):
    nations = tables.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    suppliers = tables.table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    tiers = tables.nation_tiers(spark, sf_dir).withColumnRenamed("respondent", "nation")
    return lookup.entities_by_tier(suppliers.join(tiers, "nation").select(F.col("s_name").alias("respondent"), "tier"))


def _requests(spark, sf_dir):
    """Requested entities in lower case, as callers may send them; some with a date."""
    nations = tables.table(spark, sf_dir, "nation")
    dates = F.when(F.col("n_regionkey") == 0, F.lit("1997-03-15")).when(F.col("n_regionkey") == 1, F.lit("2030-01-01"))
    return nations.select(F.lower("n_name").alias("respondent"), dates.cast("date").alias("target_date"))


@query(
    "history",
    q.with_(
        q.FEATURES,
        """SELECT respondent, tier, target_date, ROUND(target, 1) AS actual_demand, ROUND(benchmark_forecast, 1) AS benchmark_forecast,
                  ROUND(naive_persistence, 1) AS naive_persistence
           FROM features QUALIFY ROW_NUMBER() OVER (PARTITION BY respondent ORDER BY target_date DESC) <= 60""",
    ),
)
def _(spark, sf_dir):
    return lookup.history(feature_table(spark, sf_dir), _requests(spark, sf_dir))


LOOKUP = (
    q.FEATURES
    + """,
asked AS (SELECT n_name AS respondent, CASE n_regionkey WHEN 0 THEN DATE '1997-03-15' WHEN 1 THEN DATE '2030-01-01' END AS requested_date FROM nation),
resolved AS (SELECT a.respondent, requested_date, COALESCE(requested_date, m) AS target_date
             FROM asked a LEFT JOIN (SELECT respondent, MAX(target_date) AS m FROM features GROUP BY 1) l USING (respondent)),
found AS (SELECT r.respondent, r.requested_date, r.target_date, f.* EXCLUDE (respondent, target_date), f.respondent IS NOT NULL AS found
          FROM resolved r LEFT JOIN features f ON r.respondent = f.respondent AND r.target_date = f.target_date)"""
)


@query("row_lookup", q.with_(LOOKUP, "SELECT respondent, requested_date, target_date, found, target, demand_t FROM found"))
def _(spark, sf_dir):
    out = lookup.lookup_rows(stored_features(spark, sf_dir), _requests(spark, sf_dir))
    return out.select("respondent", "requested_date", "target_date", "found", "target", "demand_t")


@query(
    "scored_response",
    q.with_(
        LOOKUP,
        """SELECT respondent, tier, forecast_date, target_date, ROUND(prediction, 1) AS predicted_demand,
                  ROUND(naive_persistence, 1) AS naive_persistence, ROUND(benchmark_forecast, 1) AS benchmark_forecast,
                  ROUND(target, 1) AS actual_demand, ROUND(ABS(target - prediction), 1) AS model_abs_error,
                  ROUND(ABS(target - prediction) / NULLIF(target, 0) * 100, 2) AS model_error_pct,
                  ROUND(ABS(target - benchmark_forecast) / NULLIF(target, 0) * 100, 2) AS benchmark_error_pct,
                  ROUND(ABS(target - naive_persistence) / NULLIF(target, 0) * 100, 2) AS naive_error_pct,
                  CASE WHEN target <> 0 AND naive_persistence <> 0 THEN ABS(target - prediction) < ABS(target - naive_persistence) END AS beats_naive,
                  CASE WHEN target <> 0 AND benchmark_forecast <> 0 THEN ABS(target - prediction) < ABS(target - benchmark_forecast) END AS beats_benchmark
           FROM found WHERE found""",
    ),
)
def _(spark, sf_dir):
    rows = lookup.lookup_rows(with_prediction(stored_features(spark, sf_dir)), _requests(spark, sf_dir)).filter("found")
    return lookup.scored_response(rows, "prediction")


# ------------------------------------------------------------------ exploration


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, COUNT({c}) AS n, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 2) AS std, MIN({c}) AS min,
      QUANTILE_CONT({c}, 0.25) AS q25, QUANTILE_CONT({c}, 0.5) AS q50, QUANTILE_CONT({c}, 0.75) AS q75, MAX({c}) AS max FROM panel"""


@query("describe_series", q.with_(q.PANEL, " UNION ALL ".join(_describe_sql(c) for c in PROFILE)))
def _(spark, sf_dir):
    return rounded(rounded(explore.describe(stored_wide(spark, sf_dir)), 4, "mean"), 2, "std")


@query(
    "missing_by_column",
    q.with_(
        q.DAILY,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS n_missing, ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 3) AS pct FROM daily"""
            for c in ["period", "respondent", *PROFILE]
        ),
    ),
)
def _(spark, sf_dir):
    return explore.missing_by_column(panel.reindex_daily(wide(spark, sf_dir)), ["period", "respondent", *PROFILE])


@query(
    "duplicate_panel_keys",
    """SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows, COUNT(*) FILTER (WHERE n > 1) AS duplicate_keys
       FROM (SELECT COUNT(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE), o_custkey)""",
)
def _(spark, sf_dir):
    return quality.duplicate_keys(_customer_days(spark, sf_dir), ["period", "respondent"])


@query(
    "demand_histogram",
    q.with_(
        q.PANEL + ", lim AS (SELECT MIN(demand) AS a, MAX(demand) AS b FROM panel), bins AS (SELECT CAST(UNNEST(RANGE(1, 81)) AS INTEGER) AS bin),"
        " placed AS (SELECT LEAST(CAST(FLOOR((demand - a) / (b - a) * 80) AS INTEGER) + 1, 80) AS bin, COUNT(*) AS n FROM panel, lim WHERE demand IS NOT NULL GROUP BY 1)",
        """SELECT bins.bin, ROUND(a + (bins.bin - 1) * ((b - a) / 80), 4) AS left_edge, COALESCE(n, 0) AS n
           FROM bins CROSS JOIN lim LEFT JOIN placed ON bins.bin = placed.bin""",
    ),
)
def _(spark, sf_dir):
    return rounded(explore.histogram(stored_wide(spark, sf_dir, "demand")), 4, "left_edge")


RANKING = q.PANEL + ", ranking AS (SELECT respondent, AVG(demand) AS mean_demand FROM panel GROUP BY 1)"


@query(
    "demand_ranking",
    q.with_(
        RANKING,
        """(SELECT respondent, ROUND(mean_demand, 4) AS mean_demand, 'largest' AS "end" FROM ranking ORDER BY ranking.mean_demand DESC, respondent LIMIT 5)
           UNION ALL (SELECT respondent, ROUND(mean_demand, 4), 'smallest' FROM ranking ORDER BY ranking.mean_demand, respondent LIMIT 5)""",
    ),
)
def _(spark, sf_dir):
    return rounded(explore.both_ends(explore.demand_ranking(wide(spark, sf_dir, "demand")), "mean_demand"), 4, "mean_demand")


@query("size_ratio", q.with_(RANKING, "SELECT ROUND(MAX(mean_demand) / MIN(mean_demand), 6) AS ratio FROM ranking"))
def _(spark, sf_dir):
    return rounded(explore.size_ratio(explore.demand_ranking(wide(spark, sf_dir, "demand"))), 6, "ratio")


@query("focus_series", q.with_(q.PANEL, f"SELECT respondent, period, demand FROM panel WHERE respondent IN ({FOCUS_SQL})"))
def _(spark, sf_dir):
    return explore.focus_series(wide(spark, sf_dir, "demand"), FOCUS)


def _season_sql(part: str, expr: str) -> str:
    return q.with_(
        q.PANEL + f", means AS (SELECT respondent, CAST({expr} AS INTEGER) AS {part}, AVG(demand) AS m FROM panel GROUP BY 1, 2)",
        f"SELECT respondent, {part}, ROUND(m, 4) AS mean_demand, ROUND(m / AVG(m) OVER (PARTITION BY respondent), 6) AS relative FROM means",
    )


@query("monthly_seasonality", _season_sql("month", "MONTH(period)"))
def _(spark, sf_dir):
    out = explore.seasonality(wide(spark, sf_dir, "demand"), "month")
    return rounded(rounded(out, 4, "mean_demand"), 6, "relative")


@query("weekly_seasonality", _season_sql("dayofweek", "ISODOW(period) - 1"))
def _(spark, sf_dir):
    out = explore.seasonality(wide(spark, sf_dir, "demand"), "dayofweek")
    return rounded(rounded(out, 4, "mean_demand"), 6, "relative")


BENCH_OK = "FROM panel WHERE demand IS NOT NULL AND demand_forecast IS NOT NULL"
BENCH_MAPE = "AVG(ABS(demand - demand_forecast) / NULLIF(demand, 0) * 100)"


@query(
    "benchmark_errors",
    q.with_(
        q.PANEL,
        f"""SELECT COUNT(*) AS rows, ROUND(AVG(ABS(demand - demand_forecast)), 4) AS mae,
                   ROUND(SQRT(AVG((demand - demand_forecast) ** 2)), 4) AS rmse, ROUND({BENCH_MAPE}, 6) AS mape {BENCH_OK}""",
    ),
)
def _(spark, sf_dir):
    return rounded(rounded(explore.benchmark_errors(wide(spark, sf_dir, "demand", "demand_forecast")), 4, "mae", "rmse"), 6, "mape")


ENTITY_MAPE = q.PANEL + f", e AS (SELECT respondent, {BENCH_MAPE} AS mape, COUNT(*) AS n {BENCH_OK} GROUP BY 1)"


@query(
    "benchmark_mape_by_entity",
    q.with_(
        ENTITY_MAPE,
        """(SELECT respondent, ROUND(mape, 6) AS mape, n, 'largest' AS "end" FROM e ORDER BY e.mape DESC, respondent LIMIT 5)
           UNION ALL (SELECT respondent, ROUND(mape, 6), n, 'smallest' FROM e ORDER BY e.mape, respondent LIMIT 5)""",
    ),
)
def _(spark, sf_dir):
    per_entity = explore.benchmark_mape_by_entity(wide(spark, sf_dir))
    return rounded(explore.both_ends(per_entity, "mape"), 6, "mape")


@query(
    "naive_mape_by_row",
    q.with_(
        q.PANEL + ", l AS (SELECT demand, LAG(demand) OVER (PARTITION BY respondent ORDER BY period) AS naive FROM panel)",
        "SELECT COUNT(*) AS rows, ROUND(AVG(ABS(demand - naive) / NULLIF(demand, 0) * 100), 6) AS mape FROM l WHERE demand IS NOT NULL AND naive IS NOT NULL",
    ),
)
def _(spark, sf_dir):
    return rounded(explore.naive_mape_by_row(wide(spark, sf_dir, "demand")), 6, "mape")


@query(
    "panel_coverage",
    q.with_(
        q.PANEL + ", span AS (SELECT MAX(period) - MIN(period) + 1 AS d FROM panel)",
        """SELECT respondent, COUNT(DISTINCT period) AS days, MIN(period) AS first_day, MAX(period) AS last_day,
                  COUNT(*) FILTER (WHERE demand IS NULL) AS missing_demand, ROUND(COUNT(DISTINCT period) / (SELECT d FROM span) * 100, 2) AS coverage_pct,
                  GREATEST(MAX(period) - MIN(period) + 1 - COUNT(DISTINCT period), 0) AS interior_gaps FROM panel GROUP BY 1""",
    ),
)
def _(spark, sf_dir):
    return explore.panel_coverage(stored_wide(spark, sf_dir, "demand"))


@query(
    "panel_overview",
    q.with_(q.PANEL, "SELECT COUNT(*) AS rows, COUNT(DISTINCT respondent) AS respondents, MIN(period) AS first_day, MAX(period) AS last_day FROM panel"),
)
def _(spark, sf_dir):
    return explore.overview(wide(spark, sf_dir, "demand"))


@query(
    "first_rows",
    q.with_(q.PANEL, "SELECT period, respondent, demand, demand_forecast, net_generation, interchange FROM panel WHERE respondent = 'NATION_7' ORDER BY period LIMIT 8"),
)
def _(spark, sf_dir):
    return explore.first_rows(wide(spark, sf_dir), "NATION_7")


# ------------------------------------------------------------------ batch twins of the streams

DAY_TYPE = "SELECT CAST(ts AS DATE) AS day, event_type AS respondent"


@query("daily_rollup", DAY_TYPE + ", COUNT(*) AS n, ROUND(SUM(CAST(value AS DECIMAL(18,2))), 2) AS total FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select(
        F.col("ts").alias("event_ts"), F.col("event_type").alias("respondent"), "value"
    )
    return daily_rollup(events).select("day", "respondent", "n", F.col("total").cast("decimal(38,2)").alias("total"))


@query(
    "daily_quality_counters",
    "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n, COUNT(*) FILTER (WHERE value IS NULL) AS missing, "
    "COUNT(*) FILTER (WHERE value < 0) AS negatives, COUNT(*) FILTER (WHERE value = 0 AND event_type = 'view') AS zeros FROM events GROUP BY 1",
)
def _(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select(
        F.col("ts").alias("event_ts"), F.col("event_type").alias("type"), "value"
    )
    return daily_quality(events, target="view", negative_allowed=[])


# ------------------------------------------------------------------ streams, run over all that has landed and read back


def _event_stream(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    # A pattern, since a stream takes a plain path for a folder.
    stream = stream_observations(spark, f"{sf_dir}/events[.]parquet", events.schema)
    return stream.withColumn("event_ts", F.col("ts").cast("timestamp"))


def _streamed(spark, stream):
    path = _scratch(spark, "stream")
    append_stream(stream, path, _scratch(spark, "stream-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


#: A day is closed, and emitted, when it ends two days before the newest event.
CLOSED = "WHERE CAST(ts AS DATE) + INTERVAL 3 DAY <= (SELECT MAX(ts) FROM events)"


@query(
    "stream_daily_rollup",
    f"{DAY_TYPE}, COUNT(*) AS n, ROUND(SUM(CAST(value AS DECIMAL(18,2))), 2) AS total FROM events {CLOSED} GROUP BY 1, 2",
)
def _(spark, sf_dir):
    out = _streamed(spark, daily_rollup(_event_stream(spark, sf_dir).withColumnRenamed("event_type", "respondent"), "2 days"))
    return out.select("day", "respondent", "n", F.col("total").cast("decimal(38,2)").alias("total"))


@query(
    "stream_daily_quality",
    f"""SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n, COUNT(*) FILTER (WHERE value IS NULL) AS missing,
               COUNT(*) FILTER (WHERE value < 0) AS negatives, COUNT(*) FILTER (WHERE value = 0 AND event_type = 'view') AS zeros
        FROM events {CLOSED} GROUP BY 1""",
)
def _(spark, sf_dir):
    stream = _event_stream(spark, sf_dir).withColumnRenamed("event_type", "type")
    return _streamed(spark, daily_quality(stream, "2 days", target="view", negative_allowed=[]))


@query("stream_repeats", "SELECT DISTINCT CAST(ts AS DATE) AS day, user_id, event_type FROM events")
def _(spark, sf_dir):
    """One row per user, day and kind of event."""
    keyed = _event_stream(spark, sf_dir).withColumn("day", F.to_date("event_ts"))
    out = _streamed(spark, drop_repeats(keyed, ["day", "user_id", "event_type"], time="day"))
    return out.select("day", "user_id", "event_type")


@query(
    "stream_upsert",
    q.with_(LANDED, "SELECT period, respondent, 'D' AS type, value FROM landed WHERE NOT lost"),
)
def _(spark, sf_dir):
    path = _scratch(spark, "store")
    upsert_stream(stream_pages(spark, _landing(spark, sf_dir), "pages"), path, _scratch(spark, "stream-state")).awaitTermination()
    return store.read_store(spark, path).select("period", "respondent", "type", "value")


# ------------------------------------------------------------------ fitted models (no SQL counterpart)


_FITTED: dict[tuple[str, str], tuple] = {}


def _fitted(spark, sf_dir):
    """Split features as a written table, and the three fitted tiers; fitted once a session for both queries below."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        df = cut_lineage(splits.split_time_series(stored_features(spark, sf_dir)))
        _FITTED[key] = df, models.train_all_tiers(df.filter("split = 'train'"), df.filter("split = 'val'"))
    return _FITTED[key]


@query("tier_model_metrics")
def _(spark, sf_dir):
    df, fitted = _fitted(spark, sf_dir)
    scored = models.predict_with_tier_models(df.filter("split = 'test'"), fitted)
    return metrics.compare_predictions(scored, {**APPROACHES, "model": "model_prediction"})


@query("walk_forward_search")
def _(spark, sf_dir):
    """Thirty candidates for every tier by successive halving over three folds."""
    df = cut_lineage(splits.train_and_validation(splits.split_time_series(stored_features(spark, sf_dir))))
    return models.search_tiers(df, TIER_NAMES, models.random_candidates(30, seed=42))


@query("next_day_forecast")
def _(spark, sf_dir):
    _, fitted = _fitted(spark, sf_dir)
    latest = models.latest_rows(build(spark, sf_dir, wide(spark, sf_dir), drop_na_target=False))
    return models.predict_with_tier_models(latest, fitted).select(
        "respondent", "tier", "forecast_date", "target_date", "model_prediction"
    )
