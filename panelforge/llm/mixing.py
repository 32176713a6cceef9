"""Mixing sources to target weights by systematic sampling.

Every document of a source gets the same expected number of copies, the source's target over its size.  The expected
copies are summed up along the source in order of size and id, one random offset per source is added, and a document is
taken once for each whole number that the running sum crosses on it.  In order of size, neighbours stand for each
other, which keeps the words taken close to the target.

The running sum is computed in blocks: rows are dealt out by range, so a source with a third of all rows fills many
blocks; block totals are summed per source, and rows are summed within their block.  Sums are exact whole numbers of ticks,
so the result does not depend on how the rows fell into blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.text import word_count
from panelforge.session import cut_lineage

TICKS = 1 << 40


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of ``source`` and ``size``.

    Sources in order of code point, null last, take the weights in turn.  Targets share the sum of all sizes
    by weight; none exceeds ``cap`` times its source's size, and what is cut off is shared by weight among the rest
    until none does.  That is ``least(cap * size, level * weight)`` for one level, found by running sums over the
    sources in order of cap over weight.  The windows hold one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighed = per_source.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    weighed = weighed.withColumns(
        {"_cap": F.lit(cap) * F.col("source_size"), "_turn": F.lit(cap) * F.col("source_size") / F.col("_weight")}
    )
    rising = Window.orderBy("_turn", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    beyond = F.sum("_weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    leveled = weighed.withColumn("_level", (F.sum("source_size").over(whole) - before) / beyond)
    return leveled.select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.max("_level").over(whole) * F.col("_weight")).alias("target"),
    )


def offset_ticks(source: Column, seed: str) -> Column:
    """The source's random offset in [0, 1), in ticks: 32 bits of a digest of seed and source."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * F.lit(TICKS >> 32)


def with_copies(rows: DataFrame, order: list[str], targets: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows (``source``, ``size``, the ``order`` columns, any others) with ``source_size``, ``target`` and ``copies``.

    ``order`` places rows of equal size; rows that agree in it are placed by chance but differ in nothing then.
    """
    keys = ["source", "size", *order]
    placed = cut_lineage(rows.repartitionByRange(*keys).withColumn("_block", F.spark_partition_id()))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = targets.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.floor(rate * F.lit(float(TICKS))).cast("decimal(20,0)").alias("_expected"),
    )
    valued = placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    running = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = valued.groupBy("source", "_block").agg(F.sum("_expected").alias("_sum")).select(
        F.col("source").alias("_source"),
        F.col("_block").alias("_at"),
        F.coalesce(F.sum("_sum").over(running), F.lit(0)).cast("decimal(38,0)").alias("_start"),
    )
    inside = Window.partitionBy("source", "_block").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    summed = valued.withColumn("_before", F.coalesce(F.sum("_expected").over(inside), F.lit(0)).cast("decimal(38,0)"))
    joined = summed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_at")))
    joined = joined.withColumn("_low", (F.col("_start") + F.col("_before") + offset_ticks(F.col("source"), seed)).cast("decimal(38,0)"))
    copies = F.expr(f"cast((_low + _expected) div {TICKS} as long) - cast(_low div {TICKS} as long)")
    return joined.withColumn("copies", copies).drop("_source", "_at", "_start", "_before", "_low", "_block", "_expected")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``copies``, ``taken``.

    Null texts have size 0; a source of size 0 has target 0; null is a source of its own.  An empty table gives none.
    """
    sized = cut_lineage(docs.select("doc_id", "source", word_count("text").alias("size")))
    out = with_copies(sized, ["doc_id"], cut_lineage(source_targets(sized, weights, cap)), seed)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, with the columns of ``docs``.

    Rows are numbered in a written copy, so that rows that repeat an id are told apart; only the numbers,
    ids and sizes are sorted.
    """
    numbered = cut_lineage(
        docs.select(
            F.struct(*docs.columns).alias("_all"),
            F.monotonically_increasing_id().alias("_row"),
            word_count("text").alias("_size"),
        )
    )
    sized = numbered.select(
        F.col("_all.source").alias("source"), F.col("_size").alias("size"), F.col("_all.doc_id").alias("doc_id"), "_row"
    )
    taken = with_copies(sized, ["doc_id", "_row"], cut_lineage(source_targets(sized, weights, cap)), seed)
    taken = taken.filter("copies > 0").select("_row", "copies")
    repeated = numbered.join(taken, "_row").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("_all.*")
