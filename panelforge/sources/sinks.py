"""Report, log, feature-store and metric sinks, and the reads that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.quality import ValidationResult


def append_log(records: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    records.write.mode("append").json(path)


def save_validation(result: ValidationResult, path: str) -> None:
    """Write a validation result under ``path``: findings, coverage, excluded and approved entities."""
    result.findings.write.mode("overwrite").json(f"{path}/findings")
    result.entity_details.write.mode("overwrite").json(f"{path}/entity_details")
    result.coverage.write.mode("overwrite").option("header", True).csv(f"{path}/coverage_matrix")
    result.modeling_respondents.write.mode("overwrite").json(f"{path}/modeling_respondents")
    result.verdict.write.mode("overwrite").json(f"{path}/verdict")


def read_approved(spark: SparkSession, path: str) -> DataFrame:
    """Approved entities of a saved validation result."""
    return spark.read.schema("respondent string").json(f"{path}/modeling_respondents")


def read_report_list(spark: SparkSession, path: str) -> DataFrame:
    """Approved entities of a single-document report with a ``modeling_respondents`` array."""
    report = spark.read.schema("modeling_respondents array<string>").option("multiLine", True).json(path)
    return report.select(F.explode("modeling_respondents").alias("respondent"))


def write_features(features: DataFrame, path: str) -> None:
    """Feature store: one folder per tier, so that a tier fit reads its own rows only."""
    (
        features.hint("rebalance", "tier")
        .sortWithinPartitions("tier", "respondent", "target_date")
        .write.mode("overwrite")
        .partitionBy("tier")
        .parquet(path)
    )


def read_features(spark: SparkSession, path: str, tier: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("tier") == tier) if tier is not None else df


def save_summary(summary: DataFrame, path: str) -> None:
    """Small result tables (evaluation, drift) as JSON lines."""
    summary.write.mode("overwrite").json(path)
