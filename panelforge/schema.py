"""Schemas, keys and the fixed values every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["period", "respondent", "type"]

RAW_SCHEMA = T.StructType(
    [
        T.StructField("period", T.DateType()),
        T.StructField("respondent", T.StringType()),
        T.StructField("respondent_name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("type_name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("value_units", T.StringType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("_ingested_at", T.TimestampType()),
        T.StructField("_source_route", T.StringType()),
    ]
)
RAW_COLUMNS = RAW_SCHEMA.fieldNames()
REQUIRED_COLUMNS = RAW_COLUMNS[:8]

# Series codes and the panel column each one becomes.
SERIES = {
    "D": "demand",
    "DF": "demand_forecast",
    "NG": "net_generation",
    "TI": "interchange",
}
TARGET_TYPE = "D"
FORECAST_TYPE = "DF"

# Series where a negative value is physically meaningful.
NEGATIVE_ALLOWED = ["TI", "NG"]

# Roll-up entities whose value is the sum of other entities.
AGGREGATE_RESPONDENTS = [
    "US48", "CAL", "CAR", "CENT", "FLA", "MIDA", "MIDW",
    "NE", "NW", "NY", "SE", "TEN", "TEX",
]

# Default size tier of each entity.
TIERS = {
    "Large": ["CISO", "ERCO", "MISO", "PJM", "SOCO", "SWPP"],
    "Medium": [
        "AECI", "AZPS", "BPAT", "CPLE", "DUK", "FMPP", "FPC", "FPL", "IPCO",
        "ISNE", "LDWP", "LGEE", "NEVP", "NYIS", "PACE", "PACW", "PGE", "PSCO",
        "PSEI", "SC", "SCEG", "SRP", "SW", "TEC", "TVA",
    ],
    "Small": [
        "AVA", "BANC", "CHPD", "CPLW", "DOPD", "EPE", "GCPD", "GVL", "HST",
        "IID", "JEA", "NWMT", "PNM", "SCL", "SEC", "SPA", "TAL", "TEPC", "TIDC",
        "TPWR", "WALC",
    ],
}
TIER_NAMES = ["Large", "Medium", "Small"]
UNKNOWN_TIER = "Unknown"
OVERALL = "Overall"

# Feature offsets, window lengths and minimum observation counts.
DEMAND_LAGS = [1, 2, 6, 7, 13, 14, 364]
EXOGENOUS_LAGS = [1, 7]
ROLLING_MEANS = {7: 4, 14: 7, 30: 15}
ROLLING_STDS = {7: 4, 30: 15}
TREND_WINDOWS = [7, 30]

# Columns of the feature table, which must equal the compared library's.
METADATA_COLUMNS = [
    "forecast_date",
    "target_date",
    "respondent",
    "tier",
    "target",
    "benchmark_forecast",
    "naive_persistence",
]
CATEGORICAL_FEATURES = ["respondent"]
NUMERIC_FEATURES = [
    "demand_t",
    *[f"demand_lag_{k}" for k in DEMAND_LAGS],
    "demand_rolling_mean_7",
    "demand_rolling_std_7",
    "demand_rolling_mean_14",
    "demand_rolling_mean_30",
    "demand_rolling_std_30",
    *[f"demand_trend_{k}" for k in TREND_WINDOWS],
    *[f"{series}_{suffix}" for series in ("net_generation", "interchange") for suffix in ("t", *(f"lag_{k}" for k in EXOGENOUS_LAGS))],
    "target_dayofweek",
    "target_is_weekend",
    "target_month",
    "target_dayofyear",
    "sin_dayofweek",
    "cos_dayofweek",
    "sin_dayofyear",
    "cos_dayofyear",
    "is_holiday",
    "is_day_before_holiday",
    "is_day_after_holiday",
    "is_bridge_day",
]
FEATURE_COLUMNS = CATEGORICAL_FEATURES + NUMERIC_FEATURES
FORBIDDEN_FEATURES = ["target", "benchmark_forecast", "demand_forecast"]


def check_feature_contract(columns: list[str]) -> None:
    """Raise when a feature list repeats a name or holds the target or the benchmark."""
    leaked = [c for c in columns if c in FORBIDDEN_FEATURES]
    if leaked:
        raise ValueError(f"target or benchmark columns used as features: {leaked}")
    if len(set(columns)) != len(columns):
        raise ValueError("repeated feature names")


def nan_to_null(column: str | Column) -> Column:
    """NaN stands for a missing value in files; inside the library that is NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def with_nulls_for_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: nan_to_null(name) for name in names if name in df.columns})
