"""Validation gate: structural errors, statistical warnings, documented facts.

One shuffle on the key serves every check.  Rows are counted per key with
map-side combine; key counts are then summed per entity and per series type,
which is a table the size of the entity list.  Findings, coverage, breakdowns
and the verdict are all read from that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.schema import (
    AGGREGATE_RESPONDENTS,
    FORECAST_TYPE,
    KEY,
    NEGATIVE_ALLOWED,
    REQUIRED_COLUMNS,
    TARGET_TYPE,
)
from panelforge.session import cut_lineage

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
AGGREGATE_ROLE, MEMBER_ROLE = "aggregate", "balancing_authority"
FINDING_TYPE = "struct<check:string,severity:string,message:string,details:map<string,string>>"
FINDING_SCHEMA = "check string, severity string, message string, details map<string,string>"


# ------------------------------------------------------------------ building blocks


def schema_errors(df: DataFrame) -> list[str]:
    """Structural faults that show in the schema alone; no job runs."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        return [f"missing columns: {missing}"]
    types = {f.name: f.dataType for f in df.schema}
    errors = []
    if not isinstance(types["period"], (T.DateType, T.TimestampType, T.TimestampNTZType)):
        errors.append("`period` is not a date or timestamp")
    if not isinstance(types["value"], T.NumericType):
        errors.append("`value` is not numeric")
    return errors


def _is_missing(df: DataFrame) -> Column:
    value = F.col("value")
    if isinstance(df.schema["value"].dataType, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def _is_invalid_negative(df: DataFrame, allowed: list[str]) -> Column:
    return ~_is_missing(df) & (F.col("value") < 0) & ~F.coalesce(F.col("type").isin(allowed), F.lit(False))


def _is_zero_demand(df: DataFrame) -> Column:
    return (F.col("type") == TARGET_TYPE) & (F.col("value") == 0)


def key_counts(df: DataFrame, negative_allowed: list[str] = NEGATIVE_ALLOWED) -> DataFrame:
    """Rows, missing, invalid negative and zero-demand rows per key.

    Only numbers and dates are aggregated, here and in the summary, so that Spark
    hashes; a text aggregate would make it sort all rows.
    """
    return df.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(_is_missing(df)).alias("n_missing"),
        F.count_if(_is_invalid_negative(df, negative_allowed)).alias("n_negative"),
        F.count_if(_is_zero_demand(df)).alias("n_zero"),
    )


def entity_names(df: DataFrame) -> DataFrame:
    """One name per entity of the target series, from the distinct pairs.

    Pairs are counted and the count is used, since Spark drops a plain
    ``distinct`` under a minimum and would then sort all rows.
    """
    target = df.filter((F.col("type") == TARGET_TYPE) & F.col("respondent").isNotNull())
    pairs = target.groupBy("respondent", F.col("respondent_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.filter("n > 0").groupBy("respondent").agg(F.min("name").alias("name"))


def quality_summary(df: DataFrame, negative_allowed: list[str] = NEGATIVE_ALLOWED) -> DataFrame:
    """All counters per entity and per series type (column ``level`` says which)."""
    keys = key_counts(df, negative_allowed)
    is_target = F.col("type") == TARGET_TYPE
    target_day = F.when(is_target, F.col("period"))
    duplicate_day = F.when(F.col("n") > 1, F.col("period"))
    return (
        keys.groupingSets([["respondent"], ["type"]], "respondent", "type")
        .agg(
            F.when(F.grouping("respondent") == 0, "respondent").otherwise("type").alias("level"),
            F.sum("n").alias("rows"),
            F.sum(F.col("n") - 1).alias("duplicates"),
            F.sum("n_missing").alias("missing"),
            F.sum("n_negative").alias("negatives"),
            F.sum("n_zero").alias("zeros"),
            F.max(duplicate_day).alias("duplicate_day"),
            F.max(F.when(F.col("n") > 1, F.struct("period", "type"))).alias("duplicate_key"),
            F.count_if(is_target).alias("target_keys"),
            F.count_if(F.col("type") == FORECAST_TYPE).alias("forecast_keys"),
            F.count(target_day).alias("days"),
            F.min(target_day).alias("first_day"),
            F.max(target_day).alias("last_day"),
            F.sum(F.when(is_target, F.col("n_missing"))).alias("target_missing"),
            F.min("period").alias("min_period"),
            F.max("period").alias("max_period"),
        )
    )


def label_values(df: DataFrame) -> DataFrame:
    """Distinct (unit, time zone) pairs."""
    return df.select("value_units", "timezone").distinct()


def label_check(df: DataFrame, column: str) -> DataFrame:
    """One row: number of distinct values of a label and whether it is pinned to one."""
    return df.agg(
        F.count_distinct(column).alias("n_values"),
        (F.count_distinct(column) <= 1).alias("single"),
    )


def duplicate_keys(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row: rows beyond the first per key, and the number of keys with copies."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
    )


def repeated_keys(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Every key that occurs more than once, with its number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and share per type and in total (``type`` NULL with ``total`` true)."""
    return (
        df.rollup("type")
        .agg(
            (F.grouping("type") == 1).alias("total"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(_is_missing(df)).alias("missing"),
        )
        .withColumn("pct", F.round(F.col("missing") / F.col("rows") * 100, 4))
    )


def negative_values(df: DataFrame, allowed: list[str] = NEGATIVE_ALLOWED) -> DataFrame:
    """Invalid negatives per type and entity."""
    bad = df.filter(_is_invalid_negative(df, allowed))
    return bad.groupBy("type", "respondent").agg(F.count(F.lit(1)).alias("n"))


def zero_demand(df: DataFrame) -> DataFrame:
    """Zero-valued target rows per entity."""
    return df.filter(_is_zero_demand(df)).groupBy("respondent").agg(F.count(F.lit(1)).alias("n"))


def top_entities(counts: DataFrame, n: int = 10) -> DataFrame:
    """Entities with the largest totals of ``n``; ties by id."""
    return (
        counts.groupBy("respondent")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "respondent")
        .limit(n)
    )


def leakage_watch(df: DataFrame) -> DataFrame:
    """One row: are both the target series and its published forecast present?"""
    return df.agg(
        (
            F.coalesce(F.bool_or(F.col("type") == TARGET_TYPE), F.lit(False))
            & F.coalesce(F.bool_or(F.col("type") == FORECAST_TYPE), F.lit(False))
        ).alias("forecast_present")
    )


def _with_coverage(entities: DataFrame, span_days: Column, aggregates: list[str] | DataFrame) -> DataFrame:
    if isinstance(aggregates, DataFrame):
        marked = aggregates.select("respondent").distinct().withColumn("_aggregate", F.lit(True))
        entities = entities.join(marked, "respondent", "left")
        is_aggregate = F.coalesce("_aggregate", F.lit(False))
    else:
        is_aggregate = F.col("respondent").isin(list(aggregates))
    return entities.select(
        "respondent",
        "name",
        "days",
        "first_day",
        "last_day",
        "n_missing",
        F.round(F.col("days") / span_days * 100, 2).alias("coverage_pct"),
        F.greatest(F.datediff("last_day", "first_day") + 1 - F.col("days"), F.lit(0)).alias("interior_gaps"),
        F.when(is_aggregate, AGGREGATE_ROLE).otherwise(MEMBER_ROLE).alias("role"),
    )


def build_coverage(df: DataFrame, aggregates: list[str] | DataFrame = AGGREGATE_RESPONDENTS) -> DataFrame:
    """Completeness of the target series per entity, against the span of all rows."""
    df = df.withColumn("period", F.to_date("period"))
    span = df.agg((F.datediff(F.max("period"), F.min("period")) + 1).alias("days")).scalar()
    target = df.filter(F.col("type") == TARGET_TYPE).filter("respondent is not null")
    # Counted per day first: distinct days without shuffling every row to its entity.
    days = target.groupBy("respondent", "period").agg(F.count_if(_is_missing(target)).alias("n_missing"))
    entities = days.groupBy("respondent").agg(
        F.count("period").alias("days"),
        F.min("period").alias("first_day"),
        F.max("period").alias("last_day"),
        F.sum("n_missing").alias("n_missing"),
    )
    return _with_coverage(entities.join(entity_names(df), "respondent", "left"), span, aggregates)


def _selection(exclude_aggregates: bool, min_coverage_pct: float) -> Column:
    low = F.col("coverage_pct") < min_coverage_pct
    if exclude_aggregates:
        return (
            F.when(F.col("role") == AGGREGATE_ROLE, "aggregate").when(low, "low_coverage").otherwise("keep")
        )
    return F.when(low, "low_coverage").otherwise("keep")


def select_entities(
    coverage: DataFrame, min_coverage_pct: float = 95.0, exclude_aggregates: bool = True
) -> DataFrame:
    """Coverage with ``selection``: keep, low_coverage or aggregate."""
    return coverage.withColumn("selection", _selection(exclude_aggregates, min_coverage_pct))


# ------------------------------------------------------------------ runner


@dataclass(frozen=True)
class ValidationResult:
    """Tables of one validation run.

    findings              check, severity, message, details
    entity_details        check, item, measure, value: one row per named item
    coverage              coverage matrix with ``selection``
    modeling_respondents  approved entities
    verdict               one row: passed, error and warning counts, rows
    """

    findings: DataFrame
    entity_details: DataFrame
    coverage: DataFrame
    modeling_respondents: DataFrame
    verdict: DataFrame

    @property
    def passed(self) -> bool:
        return bool(self.verdict.first()["passed"])


def _finding(check: str, severity: str, message: Column, details: dict[str, Column] | None = None) -> Column:
    pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]
    mapping = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        mapping.alias("details"),
    ).cast(FINDING_TYPE)


def _text(template: str, *parts: Column) -> Column:
    return F.format_string(template, *parts)


def _none() -> Column:
    return F.lit(None).cast(FINDING_TYPE)


def _label_finding(check: str, severity_text: str, n: Column, low: Column, high: Column) -> Column:
    return F.when(
        n > 1,
        _finding(check, ERROR, _text(severity_text + ": %s .. %s", n, low, high), {"distinct": n}),
    ).otherwise(_finding(check, INFO, _text(f"single {check}: %s", F.coalesce(low, F.lit("n/a")))))


def validate(
    df: DataFrame,
    min_coverage_pct: float = 95.0,
    exclude_aggregates: bool = True,
    aggregates: list[str] | DataFrame = AGGREGATE_RESPONDENTS,
    negative_allowed: list[str] = NEGATIVE_ALLOWED,
    materialise: bool = True,
) -> ValidationResult:
    """Run every check.

    Faults of the schema stop the run before any job; an empty input or mixed
    units stop it before the other checks.  With ``materialise`` the summary is
    checkpointed, so the five result tables share one scan of the data.
    """
    spark = df.sparkSession
    faults = schema_errors(df)
    if faults and faults[0].startswith("missing columns"):
        findings = spark.createDataFrame([("schema", ERROR, m, {}) for m in faults], FINDING_SCHEMA)
        return _stopped(findings)

    hold = cut_lineage if materialise else (lambda x: x)
    labels = hold(label_values(df))
    units = labels.agg(
        F.struct(
            F.count_distinct("value_units").alias("n_units"),
            F.min("value_units").alias("low_unit"),
            F.max("value_units").alias("high_unit"),
            F.count_distinct("timezone").alias("n_zones"),
            F.min("timezone").alias("low_zone"),
            F.max("timezone").alias("high_zone"),
        )
    ).scalar()
    units_finding = _label_finding(
        "units", "mixed units (%d)", units["n_units"], units["low_unit"], units["high_unit"]
    )
    if faults:
        schema = [_finding("schema", ERROR, F.lit(m)) for m in faults]
        findings = spark.range(1).select(F.inline(F.array(*schema, units_finding)))
        return _stopped(findings)

    df = df.withColumn("period", F.to_date("period"))
    summary = hold(quality_summary(df, negative_allowed).join(entity_names(df), "respondent", "left"))
    per_entity = summary.filter("level = 'respondent'")
    per_type = summary.filter("level = 'type'")
    # Sums over types: a handful of rows, whatever the number of entities.
    total = per_type.agg(
        F.struct(
            *[
                F.coalesce(F.sum(c), F.lit(0)).alias(c)
                for c in ("rows", "duplicates", "missing", "negatives", "zeros", "target_keys", "forecast_keys")
            ],
            (F.datediff(F.max("max_period"), F.min("min_period")) + 1).alias("span_days"),
        )
    ).scalar()

    entities = per_entity.filter("target_keys > 0 and respondent is not null").withColumn(
        "n_missing", F.col("target_missing")
    )
    coverage = select_entities(
        _with_coverage(entities, total["span_days"], aggregates), min_coverage_pct, exclude_aggregates
    )
    chosen = coverage.agg(
        F.struct(
            F.count_if(F.col("role") == AGGREGATE_ROLE).alias("aggregates"),
            F.count_if(F.col("selection") == "keep").alias("keep"),
            F.count_if(F.col("selection") == "low_coverage").alias("low"),
            F.count_if((F.col("selection") == "keep") & (F.col("interior_gaps") > 0)).alias("gapped"),
        )
    ).scalar()

    row = spark.range(1).select(units.alias("u"), total.alias("t"), chosen.alias("c"))
    u, t, c = F.col("u"), F.col("t"), F.col("c")
    units_finding = _label_finding("units", "mixed units (%d)", u["n_units"], u["low_unit"], u["high_unit"])
    zone_finding = _label_finding(
        "timezone", "%d time zones present, values are repeated", u["n_zones"], u["low_zone"], u["high_zone"]
    )
    no_target = t["target_keys"] == 0
    checks = [
        units_finding,
        F.when(
            t["duplicates"] > 0,
            _finding("duplicates", ERROR, _text("%d duplicate rows on the key", t["duplicates"]),
                     {"count": t["duplicates"]}),
        ).otherwise(_finding("duplicates", INFO, F.lit("every key occurs once"))),
        zone_finding,
        F.when(
            t["missing"] > 0,
            _finding("missing_values", WARNING,
                     _text("%d missing values (%.4f%%), left missing", t["missing"],
                           t["missing"] / t["rows"] * 100),
                     {"count": t["missing"], "pct": F.round(t["missing"] / t["rows"] * 100, 4)}),
        ).otherwise(_finding("missing_values", INFO, F.lit("no missing values"))),
        F.when(
            t["negatives"] > 0,
            _finding("negative_values", WARNING,
                     _text("%d negative values where they are not physical", t["negatives"]),
                     {"count": t["negatives"]}),
        ).otherwise(_finding("negative_values", INFO, F.lit("no invalid negatives"))),
        F.when(
            t["zeros"] > 0,
            _finding("zero_demand", WARNING, _text("%d zero-valued target rows", t["zeros"]),
                     {"count": t["zeros"]}),
        ).otherwise(_finding("zero_demand", INFO, F.lit("no zero-valued target rows"))),
        F.when(no_target, _finding("coverage", ERROR, F.lit("no rows of the target series"))),
        F.when(
            ~no_target & F.lit(exclude_aggregates),
            _finding("aggregates", INFO, _text("excluding %d aggregate entities", c["aggregates"]),
                     {"excluded": c["aggregates"]}),
        ),
        F.when(
            c["low"] > 0,
            _finding("coverage", WARNING,
                     _text(f"%d entities below {min_coverage_pct:g}%% coverage", c["low"]),
                     {"excluded": c["low"]}),
        ),
        F.when(
            c["gapped"] > 0,
            _finding("interior_gaps", WARNING, _text("%d approved entities have interior gaps", c["gapped"]),
                     {"respondents": c["gapped"]}),
        ),
        F.when(
            ~no_target,
            _finding("coverage", INFO,
                     _text(f"%d entities at or above {min_coverage_pct:g}%% coverage", c["keep"]),
                     {"n_selected": c["keep"]}),
        ),
        F.when(
            (t["target_keys"] > 0) & (t["forecast_keys"] > 0),
            _finding("leakage_watch", INFO, F.lit("published forecast present: a benchmark, not a feature")),
        ),
    ]
    findings = row.select(
        F.inline(
            F.when(t["rows"] == 0, F.array(_finding("input", ERROR, F.lit("no rows in the input"))))
            .when(u["n_units"] > 1, F.array(units_finding))
            .otherwise(F.filter(F.array(*checks), lambda f: f.isNotNull()))
        )
    )
    stopped = (total["rows"] == 0) | (units["n_units"] > 1)
    coverage = coverage.filter(~stopped)
    modeling = coverage.filter("selection = 'keep'").select("respondent")
    return ValidationResult(
        findings=findings,
        entity_details=_entity_details(labels, per_entity, per_type, coverage, stopped),
        coverage=coverage,
        modeling_respondents=modeling,
        verdict=_verdict(findings).withColumn("row_count", total["rows"]),
    )


def _verdict(findings: DataFrame) -> DataFrame:
    return findings.agg(
        (F.count_if(F.col("severity") == ERROR) == 0).alias("passed"),
        F.count_if(F.col("severity") == ERROR).alias("n_errors"),
        F.count_if(F.col("severity") == WARNING).alias("n_warnings"),
    )


def _stopped(findings: DataFrame) -> ValidationResult:
    spark = findings.sparkSession
    coverage = spark.createDataFrame(
        [],
        "respondent string, name string, days bigint, first_day date, last_day date, n_missing bigint,"
        " coverage_pct double, interior_gaps int, role string, selection string",
    )
    return ValidationResult(
        findings=findings,
        entity_details=spark.createDataFrame([], "check string, item string, measure string, value string"),
        coverage=coverage,
        modeling_respondents=coverage.select("respondent"),
        verdict=_verdict(findings).withColumn("row_count", F.lit(None).cast("long")),
    )


def _entity_details(
    labels: DataFrame, per_entity: DataFrame, per_type: DataFrame, coverage: DataFrame, stopped: Column
) -> DataFrame:
    def rows(df: DataFrame, check: str, item: str, measure: str, value: str | Column) -> DataFrame:
        value = F.col(value) if isinstance(value, str) else value
        return df.select(
            F.lit(check).alias("check"),
            F.col(item).cast("string").alias("item"),
            F.lit(measure).alias("measure"),
            value.cast("string").alias("value"),
        )

    def occurring(counter: str) -> DataFrame:
        return per_entity.filter(F.col(counter) > 0)

    low = coverage.filter("selection = 'low_coverage'")
    later = [
        rows(per_type.filter("missing > 0"), "missing_values", "type", "by_type", "missing"),
        rows(per_type.filter("negatives > 0"), "negative_values", "type", "by_type", "negatives"),
        rows(occurring("negatives"), "negative_values", "respondent", "by_respondent", "negatives"),
        rows(occurring("zeros"), "zero_demand", "respondent", "by_respondent", "zeros"),
        rows(
            per_entity.filter("duplicates > 0"),
            "duplicates", "respondent", "last_day", "duplicate_day",
        ),
        rows(
            per_entity.filter("duplicates > 0"), "duplicates", "respondent", "last_key",
            F.concat_ws(" ", F.col("duplicate_key.period").cast("string"), "duplicate_key.type"),
        ),
        rows(coverage.filter("selection = 'aggregate'"), "aggregates", "respondent", "excluded", "days"),
        rows(low, "coverage", "respondent", "coverage_pct", "coverage_pct"),
        rows(low, "coverage", "respondent", "days", "days"),
        rows(low, "coverage", "respondent", "first_day", "first_day"),
        rows(low, "coverage", "respondent", "last_day", "last_day"),
        rows(
            coverage.filter("selection = 'keep' and interior_gaps > 0"),
            "interior_gaps", "respondent", "days", "interior_gaps",
        ),
        rows(labels.select("timezone").distinct(), "timezone", "timezone", "present", F.lit(1)),
    ]
    out = rows(labels.select("value_units").distinct(), "units", "value_units", "present", F.lit(1))
    for part in later:
        out = out.unionByName(part.filter(~stopped))
    return out
