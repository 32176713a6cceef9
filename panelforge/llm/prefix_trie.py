"""Prefix trie of conversations that share turns, from fingerprints that compose.

The fingerprint of a sequence of turns is a polynomial in a fixed base modulo the prime 2**127 - 1.  Fingerprints form a monoid:
``f(x + y) = f(x) * base**len(y) + f(y)``, so the one of a rebuilt conversation, a base's head and an own suffix, follows from three
stored prefixes, ``(f(head) - f(own head)) * base**n + f(own prefix)``, and no rebuilt text is ever put together.  Stored
prefixes are found block by block along the sorted turns and joined by the same rule, so a conversation of any length fills many tasks.

A node of the trie is a group of equal depth and fingerprint.  Groups are verified: all members must agree in the digest of the last turn
they refer to and in the fingerprint one turn up, which by induction from the root makes them equal turn by turn, and
turns of equal digest are compared by role and text.  A violation ends the job.

Sums over a subtree need no walk: every node belongs to its smallest conversation, whose turns lead through all
nodes above it.  What a conversation owns is added up along its own path, then over the members of each node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.text import filled
from panelforge.session import cut_lineage

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"base of turn fingerprints").digest()[:15], "big")
_INVERSE = pow(BASE, -1, PRIME)
_LOW, _SIGN = (1 << 64) - 1, 1 << 63


def halves(value: int) -> tuple[int, int]:
    """A fingerprint as two signed 64-bit numbers."""
    low = value & _LOW
    return value >> 64, low - (1 << 64) if low & _SIGN else low


def joined(high: int, low: int) -> int:
    return (high << 64) | (low & _LOW)


def turn_value(d1: int, d2: int) -> int:
    """What a turn adds to a fingerprint, from the two halves of its digest."""
    return (((d1 & _LOW) << 64) | (d2 & _LOW)) % PRIME


def _rows(batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[list[dict]]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size).to_pylist()


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


_PLACED = "conv_id long, block int, pos long, f1 long, f2 long, d1 long, d2 long, chars long"


def _run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position and fingerprint of each turn within its conversation's part of this partition."""
    block, conv, pos, value = TaskContext.get().partitionId(), None, 0, 0
    for rows in _rows(batches):
        out = []
        for row in rows:
            if row["conv_id"] != conv:
                conv, pos, value = row["conv_id"], 0, 0
            pos += 1
            value = (value * BASE + turn_value(row["d1"], row["d2"])) % PRIME
            out.append((conv, block, pos, *halves(value), row["d1"], row["d2"], row["chars"]))
        yield _batch(out, _PLACED)


_STARTS = "conv_id long, block int, pos0 long, s1 long, s2 long"


def _block_starts(blocks: pa.Table) -> pa.Table:
    """Composition of the blocks of one conversation; a row per partition that it reaches into."""
    pos, value, out = 0, 0, []
    for row in blocks.sort_by("block").to_pylist():
        out.append((row["conv_id"], row["block"], pos, *halves(value)))
        pos += row["n"]
        value = (value * pow(BASE, row["n"], PRIME) + joined(row["f1"], row["f2"])) % PRIME
    return pa.Table.from_batches([_batch(out, _STARTS)])


_PREFIX = "conv_id long, pos long, f1 long, f2 long, d1 long, d2 long, chars long"


def _compose_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _rows(batches):
        out = []
        for r in rows:
            f1, f2, pos = r["f1"], r["f2"], r["pos"]
            if r["pos0"]:
                f1, f2 = halves((joined(r["s1"], r["s2"]) * pow(BASE, pos, PRIME) + joined(f1, f2)) % PRIME)
                pos += r["pos0"]
            out.append((r["conv_id"], pos, f1, f2, r["d1"], r["d2"], r["chars"]))
        yield _batch(out, _PREFIX)


def stored_prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), the fingerprint up to there, digest and code points of the turn; texts are read here only."""
    base = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        filled("role").alias("role"),
        filled("text").alias("text"),
    ).filter("conv_id is not null")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    half = lambda at: F.conv(F.substring("_digest", at, 16), 16, -10).cast("long")
    base = base.withColumn("_digest", digest).withColumns({"d1": half(1), "d2": half(17)}).drop("_digest")
    narrow = cut_lineage(base.select("conv_id", "turn", "role", "d1", "d2", F.length("text").cast("long").alias("chars")))
    _compare_turns(base)

    keys = ["conv_id", "turn", "role", "d1", "d2"]
    dealt = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(dealt.mapInArrow(_run_blocks, _PLACED))
    blocks = placed.groupBy("conv_id", "block").agg(
        F.max("pos").alias("n"), F.max(F.struct("pos", "f1", "f2")).alias("last")
    )
    blocks = blocks.select("conv_id", "block", "n", "last.f1", "last.f2")
    # Only conversations that reach into several partitions: at most two rows and one inner row per partition.
    cut = blocks.join(blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "conv_id")
    starts = cut.groupBy("conv_id").applyInArrow(_block_starts, _STARTS)
    return cut_lineage(placed.join(starts, ["conv_id", "block"], "left").mapInArrow(_compose_blocks, _PREFIX))


def _compare_turns(base: DataFrame) -> None:
    """Turns that share a digest must have the same role and text; a turn that many conversations share is one row per task."""
    said = base.groupBy("d1", "d2", "role", "text").agg(F.lit(1).alias("one"))
    clash = said.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not clash.isEmpty():
        raise ValueError("two different turns share a digest")


_PATHS = "conv_id long, depth long, f1 long, f2 long, u1 long, u2 long, d1 long, d2 long, chars long, ends boolean"


def _compose_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of rebuilt prefixes, and of the prefix one turn shorter."""
    for rows in _rows(batches):
        out = []
        for r in rows:
            shift = joined(r["b1"], r["b2"]) - joined(r["h1"], r["h2"])
            value = (shift * pow(BASE, r["n"], PRIME) + joined(r["f1"], r["f2"])) % PRIME
            above = (value - turn_value(r["d1"], r["d2"])) * _INVERSE % PRIME
            out.append(
                (r["conv_id"], r["depth"], *halves(value), *halves(above), r["d1"], r["d2"], r["chars"], r["ends"])
            )
        yield _batch(out, _PATHS)


def rebuilt_paths(prefixes: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """One row per rebuilt conversation and depth, from the root on: fingerprints and the turn referred to.

    Conversation ``c`` takes the first ``h = crc32(c) % heads`` turns of ``c - c % every``, then its own from ``h`` on.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    known = prefixes.withColumn("h", head)
    own = known.groupBy("conv_id", "h").agg(
        F.max("pos").alias("len"),
        F.max(F.when(F.col("pos") == F.col("h"), F.struct("pos", "f1", "f2"))).alias("own_head"),
    )
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    first = prefixes.filter((F.col("conv_id") % every == 0) & (F.col("pos") < heads))
    bases = first.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("f1", "f2")))).alias("at"))
    convs = own.join(bases.select(F.col("conv_id").alias("base"), "at"), "base", "left")
    taken = F.least("h", F.coalesce(F.size("at"), F.lit(0))).cast("long")
    convs = convs.withColumn("taken", F.when(F.col("at").isNull(), F.lit(0)).otherwise(taken).cast("long"))
    convs = convs.withColumn("head", F.when(F.col("taken") > 0, F.try_element_at("at", "taken")))
    zero = F.lit(0).cast("long")
    convs = cut_lineage(
        convs.select(
            "conv_id", "base", "h", "len", "taken",
            F.coalesce("head.f1", zero).alias("b1"), F.coalesce("head.f2", zero).alias("b2"),
            F.coalesce("own_head.f1", zero).alias("h1"), F.coalesce("own_head.f2", zero).alias("h2"),
        )
    )
    turn = ["f1", "f2", "d1", "d2", "chars"]
    suffix = prefixes.join(convs, "conv_id").filter("pos > h").select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), (F.col("pos") - F.col("h")).alias("n"),
        "b1", "b2", "h1", "h2", *turn, (F.col("pos") == F.col("len")).alias("ends"),
    )
    heads_of = first.select(F.col("conv_id").alias("base"), "pos", *turn)
    shown = convs.join(heads_of, "base").filter("pos <= taken").select(
        "conv_id", F.col("pos").alias("depth"), zero.alias("n"),
        *(zero.alias(c) for c in ("b1", "b2", "h1", "h2")), *turn,
        ((F.col("pos") == F.col("taken")) & (F.col("len") <= F.col("h"))).alias("ends"),
    )
    paths = suffix.unionByName(shown).mapInArrow(_compose_paths, _PATHS)
    roots = convs.select(
        "conv_id", *(zero.alias(c) for c in ("depth", "f1", "f2", "u1", "u2", "d1", "d2", "chars")),
        ((F.col("taken") == 0) & (F.col("len") <= F.col("h"))).alias("ends"),
    )
    return cut_lineage(roots.unionByName(paths))


NODE = ["depth", "f1", "f2"]


def verified_nodes(paths: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``n_convs``, the fingerprint one turn up, ``own`` (what this node saves).

    The job ends where members of a node differ in their last turn or in what is above it.  The check stands in ``conv_id``, which
    every use of a node reads.
    """
    shared = ["u1", "u2", "d1", "d2", "chars"]
    nodes = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("least"),
        F.count(F.lit(1)).alias("n_convs"),
        *(F.min(c).alias(c) for c in shared),
        *(F.max(c).alias(f"{c}_") for c in shared),
    )
    same = F.lit(True)
    for c in shared:
        same &= F.col(c) == F.col(f"{c}_")
    clash = F.raise_error(F.lit("different sequences of turns share a fingerprint")).cast("long")
    return nodes.select(
        *NODE,
        F.when(same, F.col("least")).otherwise(clash).alias("conv_id"),
        "n_convs",
        "u1",
        "u2",
        ((F.col("n_convs") - 1) * F.col("chars")).alias("own"),
    )


_ENDS = "depth long, f1 long, f2 long, ends_sha256 string"


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and conversation; of a node one running hash is held."""
    node, running, out = None, None, []
    for rows in _rows(batches):
        for r in rows:
            here = (r["depth"], r["f1"], r["f2"])
            if here != node:
                if node is not None:
                    out.append((*node, running.hexdigest()))
                node, running = here, hashlib.sha256(str(r["conv_id"]).encode())
            else:
                running.update(f",{r['conv_id']}".encode())
        yield _batch(out, _ENDS)
        out = []
    if node is not None:
        yield _batch([(*node, running.hexdigest())], _ENDS)


def _owned_above(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """Per node: ``above``, what its smallest conversation owns at smaller depths; summed in range blocks.

    Conversations that own nothing of weight are left out.
    """
    weighty = nodes.select(*NODE, "conv_id", "own").join(owners.filter("saved > 0"), "conv_id", "left_semi")
    placed = cut_lineage(weighty.repartitionByRange("conv_id", "depth").withColumn("block", F.spark_partition_id()))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("conv_id", "block").agg(F.sum("own").alias("s"))
    starts = starts.select("conv_id", "block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("within", F.coalesce(F.sum("own").over(inside), F.lit(0)))
    return summed.join(starts, ["conv_id", "block"]).select(*NODE, (F.col("start") + F.col("within")).alias("above"))


def prefix_trie(turns: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (code points),
    ``ends_sha256``.  Turns go by number, null first; rows that repeat a number go by role, then by digest; null roles and texts
    are empty.  Rows without a conv_id belong to no conversation and are passed over.  ``%`` takes the sign of the conversation's id.
    An empty table gives no rows, not even a root; only conv_id, turn, role and text are read.

    The ids that end at one node are one running hash in one task, as its definition asks; nothing of them is held.
    """
    paths = rebuilt_paths(stored_prefixes(turns), every, heads)
    nodes = cut_lineage(verified_nodes(paths))
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("u1").alias("f1"), F.col("u2").alias("f2")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, NODE, "left").fillna(0, ["n_children"]))
    owners = cut_lineage(
        nodes.groupBy("conv_id").agg(
            F.sum("own").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves")
        )
    )
    summed = paths.select("conv_id", *NODE).join(owners, "conv_id").groupBy(*NODE).agg(
        F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves")
    )
    ends = paths.filter("ends").select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    ends = ends.mapInArrow(_end_digests, _ENDS)
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("f1").alias("u1"), F.col("f2").alias("u2"), F.col("conv_id").alias("parent_conv_id")
    )
    whole = nodes.join(summed, NODE).join(_owned_above(nodes, owners), NODE, "left").join(ends, NODE, "left")
    whole = whole.join(above, ["depth", "u1", "u2"], "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("saved") - F.coalesce("above", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
