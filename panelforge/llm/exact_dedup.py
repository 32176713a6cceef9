"""Exact dedup: counting quotient filters per partition, merged losslessly; repeated fingerprints are compared byte by byte.

Texts are equal when their bytes are; null counts as the empty text.  Every map task folds the fingerprints
of its rows into counting quotient filters, one per range of quotients.  A filter keeps, in order of quotient, the
remainders and their counts, so filters of one range merge by merging sorted remainders and adding counts: the sum
is the filter that one pass over all rows would have built.  A text that a third of all rows hold is one entry per task.
Only fingerprints with a count above one go on to the comparison of whole texts, which is a grouping by the text
itself, combined before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import filled
from panelforge.session import cut_lineage

FILTER = "shard long, quotients binary, runs binary, remainders binary, counts binary"


def encode(keys: np.ndarray, counts: np.ndarray, shard: int, shard_bits: int) -> dict:
    """The counting quotient filter of sorted unique 64-bit keys that share their first ``shard_bits`` bits.

    The next bits are the quotient, as many as give about one slot per quotient.  ``quotients`` is the bitmap of
    quotients in use, ``runs`` the bitmap with a bit at the last slot of each run, then come the remainders in
    order and their counts.
    """
    q = max(3, int(len(keys)).bit_length()) if len(keys) else 3
    r = 64 - shard_bits - q
    body = keys & np.uint64((1 << (64 - shard_bits)) - 1)
    quotient = (body >> np.uint64(r)).astype(np.int64)
    used = np.zeros(1 << q, bool)
    used[quotient] = True
    last = np.ones(len(keys), bool)
    last[:-1] = quotient[1:] != quotient[:-1]
    return {
        "shard": shard,
        "quotients": np.packbits(used).tobytes(),
        "runs": np.packbits(last).tobytes(),
        "remainders": (body & np.uint64((1 << r) - 1)).tobytes(),
        "counts": counts.astype(np.int64).tobytes(),
    }


def decode(part: dict, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of a filter: the inverse of :func:`encode`."""
    remainders = np.frombuffer(part["remainders"], np.uint64)
    counts = np.frombuffer(part["counts"], np.int64)
    used = np.flatnonzero(np.unpackbits(np.frombuffer(part["quotients"], np.uint8)))
    q = (len(part["quotients"]) * 8).bit_length() - 1
    last = np.unpackbits(np.frombuffer(part["runs"], np.uint8))[: len(remainders)].astype(np.int64)
    run = np.cumsum(last) - last
    body = (used[run].astype(np.uint64) << np.uint64(64 - shard_bits - q)) | remainders
    return body | (np.uint64(part["shard"]) << np.uint64(64 - shard_bits)), counts


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unique keys with their counts added."""
    unique, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, where, np.concatenate(counts))
    return unique, total


def _build(shard_bits: int, fold: int = 1 << 20):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, loose = [], [], 0
        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys.append(new)
            counts.append(np.ones(len(new), np.int64))
            loose += len(new)
            if loose > fold:
                one, two = merged(keys, counts)
                keys, counts, loose = [one], [two], 0
        if not keys:
            return
        one, two = merged(keys, counts)
        shard = (one >> np.uint64(64 - shard_bits)).astype(np.int64)
        bounds = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(one) else [0]
        rows = [encode(one[a:b], two[a:b], int(shard[a]), shard_bits) for a, b in zip(bounds[:-1], bounds[1:])]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_FILTER_ARROW)

    return build


_FILTER_ARROW = pa.schema(
    [("shard", pa.int64()), *((n, pa.binary()) for n in ("quotients", "runs", "remainders", "counts"))]
)


def _merge(shard_bits: int):
    def merge(table: pa.Table) -> pa.Table:
        parts = [decode(row, shard_bits) for row in table.to_pylist()]
        keys, counts = merged([k for k, _ in parts], [c for _, c in parts])
        again = counts > 1
        return pa.table({"fp": keys[again].view(np.int64), "n": counts[again]})

    return merge


def repeated_fingerprints(prints: DataFrame, rows_per_shard: int = 1 << 19) -> DataFrame:
    """``fp`` and count of every 64-bit fingerprint that more than one row of ``prints`` (one column ``fp``) has.

    ``rows_per_shard`` splits the work only: a merge holds about so many fingerprints, counts are exact for any value.
    """
    shard_bits = max(5, math.ceil(math.log2(max(1, prints.count()) / rows_per_shard)))
    filters = prints.select("fp").mapInArrow(_build(shard_bits), FILTER)
    return filters.groupBy("shard").applyInArrow(_merge(shard_bits), "fp long, n long")


def _compared(base: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row per text that several rows hold, by comparison of whole texts.

    ``sha`` stands for the text from here on; that no two compared texts share a digest is checked.
    """
    texts = (
        base.join(repeated.select("fp"), "fp", "left_semi")
        .groupBy("sha", "_text")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    one = texts.groupBy("sha").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    return one.select(
        "sha",
        "keep_id",
        F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("two different texts share a SHA-256 digest")).cast("long")
        ).alias("group_size"),
    )


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays; of rows that repeat that id too, exactly one.  Null ids come before
    all others, null texts are empty texts.  An empty table gives an empty table; columns beside id and text
    are not read.
    """
    base = docs.select(F.col(id_column).alias("_id"), filled(text_column).alias("_text")).select(
        "_id", "_text", F.xxhash64("_text").alias("fp"), F.sha2("_text", 256).alias("sha")
    )
    narrow = cut_lineage(base.select("_id", "fp", "sha", F.monotonically_increasing_id().alias("row")))
    repeated = cut_lineage(repeated_fingerprints(narrow.select("fp")))
    last = (
        narrow.join(repeated, "fp", "left_semi")
        .groupBy("sha")
        .agg(F.max(F.struct("_id", "row")).getField("row").alias("keep_row"))
    )
    # A table of its own, so that the join below can be split where one text has a third of all rows.
    groups = cut_lineage(_compared(base, repeated).join(last, "sha"))
    return narrow.join(groups, "sha", "left").select(
        "_id",
        F.when(F.col("keep_row").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep_row").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row per text: the one :func:`exact_groups` keeps, with all its columns.

    Rows whose fingerprint occurs once pass by; the others are grouped by their whole text.  Rows that repeat
    text and id but differ elsewhere: the one with the largest hash of the other columns stays.
    """
    keyed = docs.withColumns({"_all": F.struct(*docs.columns), "_key": filled(text_column)}).select(
        "_all", "_key", F.xxhash64("_key").alias("_fp")
    )
    repeated = cut_lineage(repeated_fingerprints(keyed.select(F.col("_fp").alias("fp")))).select(F.col("fp").alias("_fp"))
    order = F.struct(F.col(f"_all.{id_column}"), F.xxhash64("_all"))
    kept = keyed.join(repeated, "_fp", "left_semi").groupBy("_key").agg(F.max_by("_all", order).alias("_all"))
    alone = keyed.join(repeated, "_fp", "left_anti")
    return alone.select("_all").unionByName(kept.select("_all")).select("_all.*")
