"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming radius by BK-trees.

A shard is the set of fingerprints that agree in two of six blocks of bits.  Fingerprints that differ in at most four
bits differ in at most four blocks, so every such pair meets in some shard: nothing is lost.  A shard's BK-tree hangs
each fingerprint under its parent by their Hamming distance; a search follows only edges within the radius of the
distance at hand.  Copies of one fingerprint are one node.  A shard returns a spanning set of its links, not all pairs.

Trees hold at most ``tile`` fingerprints: a larger shard, such as a third of all documents being variants of one, is dealt into
tiles; each pair of tiles is a task that meets the tree of one with the fingerprints of the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.components import components
from panelforge.llm.text import filled, slices
from panelforge.session import cut_lineage

SEED = 42


def fingerprint(text: str, width: int = 4) -> int:
    """The unsigned fingerprint of a text: bit set if it is set in over half the XXH64 values of its shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = max(1, len(words) - width + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        upto = min(n, at + (1 << 15))
        tails = ends[at + width - 1 : upto + width - 1] or [len(joined) + 1]
        hashes = np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[at:upto], tails)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _prints(width: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            values = np.array([fingerprint(t, width) for t in part.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_hash"), pa.array(values.view(np.int64))], ["_id", "_hash", "fp"])

    return prints


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``_id``, ``_hash`` (of the text) and ``fp`` (the fingerprint's bits as a signed long) per row; null texts are empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), filled("text").alias("_text"))
    return rows.select("_id", "_text", F.xxhash64("_text").alias("_hash")).mapInArrow(_prints(width), "_id long, _hash long, fp long")


def shard_keys(fp: Column, radius: int, shared: int = 2) -> Column:
    """All shards of a fingerprint: one per choice of ``shared`` of ``radius + shared`` blocks, with the bits there."""
    blocks = radius + shared
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(masks, shared))]
    return F.array(*(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)))


def build_tree(items: np.ndarray) -> list:
    """A BK-tree ``[index of the node, {distance: subtree}]`` over 64-bit items, built subtree by subtree."""
    root: list = [None, {}]
    todo = [(root, np.arange(len(items)))]
    while todo:
        node, members = todo.pop()
        node[0], rest = int(members[0]), members[1:]
        if len(rest):
            distance = np.bitwise_count(items[rest] ^ items[node[0]])
            for d in np.unique(distance):
                child: list = [None, {}]
                node[1][int(d)] = child
                todo.append((child, rest[distance == d]))
    return root


def search(tree: list, items: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per node of the tree, the indices of the queries within the radius of it; all queries descend together."""
    todo = [(tree, np.arange(len(queries)))]
    while todo:
        (node, children), active = todo.pop()
        distance = np.bitwise_count(queries[active] ^ items[node]).astype(np.int64)
        near = active[distance <= radius]
        if len(near):
            yield node, near
        for edge, child in children.items():
            follow = active[np.abs(distance - edge) <= radius]
            if len(follow):
                todo.append((child, follow))


def spanning_links(items: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links within the radius connect: each item with its group's first one."""
    every = items if queries is None else np.concatenate([items, queries])
    asked = every if queries is None else queries
    shift = 0 if queries is None else len(items)
    label = np.arange(len(every))
    for node, near in search(build_tree(items), items, asked, radius):
        groups = np.unique(label[np.append(near + shift, node)])
        if len(groups) > 1:
            label[np.isin(label, groups)] = groups[0]
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def _link(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go on in the next batch."""
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if held:
                rows = np.concatenate([*held, rows])
            cut = np.flatnonzero(np.any(rows[1:, :4] != rows[:-1, :4], axis=1)) + 1
            if len(cut):
                yield from _groups(rows[: cut[-1]], cut, radius)
                rows = rows[cut[-1] :]
            held = [rows]
        if held and len(held[0]):
            yield from _groups(held[0], np.array([len(held[0])]), radius)

    return link


def _groups(rows: np.ndarray, cut: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    left, right = [], []
    for group in np.split(rows, cut[cut < len(rows)]):
        prints, own, i, j = group[:, 4].view(np.uint64), group[:, 5], group[0, 2], group[0, 3]
        items, queries = (prints, None) if i == j else (prints[own == i], prints[own == j])
        if len(items) and (queries is None or len(queries)):
            a, b = spanning_links(np.ascontiguousarray(items), queries, radius)
            left.append(a)
            right.append(b)
    if left:
        ends = [pa.array(np.concatenate(side).view(np.int64)) for side in (left, right)]
        yield pa.RecordBatch.from_arrays(ends, ["a", "b"])


def near_links(prints: DataFrame, radius: int = 4, tile: int = 8192) -> DataFrame:
    """Links ``a``, ``b`` that span every group of distinct fingerprints (column ``fp``) connected within the radius."""
    placed = prints.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("s")).select("s.choice", "s.bits", "fp")
    sizes = placed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = placed.join(sizes, ["choice", "bits"]).withColumn("m", F.ceil(F.col("n") / tile).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    tiles = F.expr("transform(sequence(0, m - 1), t -> struct(least(t, own) as i, greatest(t, own) as j))")
    dealt = met.withColumn("t", F.explode(tiles)).select("choice", "bits", "t.i", "t.j", "fp", "own")
    keys = ["choice", "bits", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link(radius), "a long, b long")


def near_groups(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """Per row of ``docs``: ``_id``, ``_hash``, ``fp`` and ``component_id``, the smallest id reachable by links.

    Ids of null come before all others in that order.  Texts without words have fingerprint 0 and link like any other;
    equal fingerprints are linked.  An empty table gives no rows; only doc_id and text are read.
    """
    printed = cut_lineage(fingerprints(docs, width))
    nodes = cut_lineage(printed.groupBy("fp").agg(F.min(F.struct("_id")).alias("least")))
    links = components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(links, nodes.fp == links.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").getField("_id").alias("component_id"))
    return printed.join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """``docs`` without the rows that link to a smaller id: of each group the document of the smallest id stays.

    Should that id name several texts of the group, the one with the smallest hash stays; rows that repeat both are one document.
    """
    groups = cut_lineage(near_groups(docs, radius, width))
    first = groups.filter(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("_id").agg(F.min("_hash").alias("_least"))
    first = first.withColumnRenamed("_id", "_first")
    gone = groups.join(first, groups.component_id.eqNullSafe(first["_first"]), "left").filter(
        ~F.col("_id").eqNullSafe(F.col("component_id")) | (F.col("_hash") != F.col("_least"))
    )
    gone = gone.select(F.col("_id").alias("_gone"), F.col("_hash").alias("_of")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id").cast("long").alias("_mine"), F.xxhash64(filled("text")).alias("_key"))
    same = F.col("_mine").eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_of"))
    return keyed.join(gone, same, "left_anti").select("_all.*")
