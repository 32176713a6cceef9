"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column) -> Column:
    """Number of words as long; null counts 0."""
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = 1 << 20, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of Arrow batches of at most ``rows`` rows and about ``size`` bytes of ``text``.

    Bounds the memory of a worker whatever Spark's batch size; a single longer text is a part of its own.
    """
    for batch in batches:
        lengths = pc.binary_length(batch.column(text).cast(pa.large_binary())).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (held + (n or 0) > size or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)
