"""Landed API pages: JSON documents with a ``response`` of data rows or facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.schema import RAW_COLUMNS, RAW_SCHEMA

# Leaf values arrive as text; numbers in their place are read as text too.
ROW_FIELDS = [
    "period", "respondent", "respondent-name", "type",
    "type-name", "value", "value-units", "timezone",
]
ROW_TYPE = T.StructType([T.StructField(name, T.StringType()) for name in ROW_FIELDS])
PAGE_SCHEMA = T.StructType(
    [
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField("total", T.StringType()),
                    T.StructField("data", T.ArrayType(ROW_TYPE)),
                    T.StructField(
                        "facets",
                        T.ArrayType(
                            T.StructType(
                                [T.StructField("id", T.StringType()), T.StructField("name", T.StringType())]
                            )
                        ),
                    ),
                ]
            ),
        ),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str | list[str], on_bad: str = "raise") -> DataFrame:
    """One row per page: ``page``, ``response`` and ``bad_reason``.

    A file that is not JSON, or has no ``response``, is a bad page.  ``raise``
    fails the job that meets one, ``keep`` leaves it in with its reason.
    """
    reader = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record")
    return checked_pages(reader.json(path), on_bad)


def checked_pages(raw: DataFrame, on_bad: str) -> DataFrame:
    """``page``, ``response`` and ``bad_reason`` of pages as the JSON reader gives them, batch or stream."""
    if on_bad not in ("raise", "keep"):
        raise ValueError("on_bad is 'raise' or 'keep'")
    pages = raw.select(
        F.col("_metadata.file_path").alias("page"),
        "response",
        F.when(F.col("_corrupt_record").isNotNull(), "invalid JSON")
        .when(F.col("response").isNull(), "no response in payload")
        .alias("bad_reason"),
    )
    if on_bad == "keep":
        return pages
    failure = F.raise_error(F.concat_ws(": ", F.col("bad_reason"), F.col("page")))
    checked = F.when(F.col("bad_reason").isNull(), F.col("response")).otherwise(failure)
    return pages.withColumn("response", checked)


def page_rows(pages: DataFrame) -> DataFrame:
    """The data rows of all good pages, still as text."""
    return pages.select(F.explode("response.data").alias("row")).select("row.*")


def page_audit(pages: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Rows fetched against the row total the source reported: (respondent, page, fetched, reported, complete).

    ``requests`` (page, respondent) tells whom each page was asked for: one row per requested entity then,
    with 0 rows where its pages hold none or never landed.  Without it a page counts for the one entity that
    all its rows name; a page without rows, or with rows of several entities, is a row of its own under
    ``page``.  Pages with neither rows nor a total above 0 (facet lists) are left out unless they were requested.
    ``complete`` false is a warning: the source may publish while it is read.
    """
    data = F.coalesce("response.data", F.array().cast(T.ArrayType(ROW_TYPE)))
    names = F.array_distinct(F.transform(data, lambda r: r["respondent"]))
    per_page = pages.select(
        "page",
        F.when(F.size(names) == 1, F.get(names, F.lit(0))).alias("_named"),
        F.size(data).alias("n"),
        F.try_to_number(F.col("response.total"), F.lit("999999999999")).cast("long").alias("total"),
    )
    if requests is None:
        keyed = per_page.filter("n > 0 or total > 0").select(
            F.col("_named").alias("respondent"), F.when(F.col("_named").isNull(), F.col("page")).alias("page"), "n", "total"
        )
    else:
        asked = requests.select("page", "respondent").distinct()
        keyed = asked.join(per_page, "page", "left").select(
            "respondent", F.lit(None).cast("string").alias("page"), "n", "total"
        )
    return (
        keyed.groupBy("respondent", "page")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fetched"), F.max("total").alias("reported"))
        .withColumn("complete", F.col("fetched").eqNullSafe(F.col("reported")))
    )


def facet_ids(pages: DataFrame) -> DataFrame:
    """Distinct entity ids listed on facet pages."""
    return pages.select(F.explode("response.facets.id").alias("respondent")).distinct()


def empty_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW_SCHEMA)


def normalise_rows(rows: DataFrame, route: str, ingested_at: str | None = None) -> DataFrame:
    """Text rows in the fixed raw schema; what cannot be read becomes NULL, never zero.

    Columns the source did not send are NULL.  ``ingested_at`` is the batch
    time; the default is the start of the query, equal for all of its rows.
    """
    stamp = F.lit(ingested_at).cast("timestamp") if ingested_at else F.current_timestamp()

    def text(name: str):
        return F.col(f"`{name}`").cast("string") if name in rows.columns else F.lit(None).cast("string")

    number = F.expr("try_cast(_value as double)")
    return (
        rows.select(*[text(name).alias(f"_{name.replace('-', '_')}") for name in ROW_FIELDS])
        .select(
            F.expr("try_cast(try_cast(_period as timestamp) as date)").alias("period"),
            F.col("_respondent").alias("respondent"),
            F.col("_respondent_name").alias("respondent_name"),
            F.col("_type").alias("type"),
            F.col("_type_name").alias("type_name"),
            F.when(~F.isnan(number), number).alias("value"),
            F.col("_value_units").alias("value_units"),
            F.col("_timezone").alias("timezone"),
            stamp.alias("_ingested_at"),
            F.lit(route).alias("_source_route"),
        )
        .select(*RAW_COLUMNS)
    )
