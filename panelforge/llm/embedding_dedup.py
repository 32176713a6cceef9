"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order of nearness.  Pivots keep a distance from each other, so
that a dense group has few.  A pivot that stands for several candidates has a ball list: its core, the vectors next to it, and as guests
all vectors that could link to the core by the triangle inequality, so that links of a core are all met, whatever the group's size.
The other vectors meet in inverted lists.  Inverted lists hold them by
pairs of pivots among their first few, so two of them meet in a list when they share at least two pivots.  Inside a list
cosines are verified in blocks, in double precision.  A pair that meets in several lists counts in the one
of its two smallest shared pivots, so links need not be collected to count them.

Equal vectors are one entry with a weight.  A long list, such as a third of all vectors around one point, is dealt into tiles; each
pair of tiles is a task of bounded size.  The number of pivots grows as the square root of the number of vectors, up to ``max_pivots``;
the pivots are what is sent to all tasks, at most ``max_pivots`` vectors.  Lists have no cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.components import components
from panelforge.session import cut_lineage


#: Pivots keep a cosine below this to each other.
APART = 0.8
#: A ball list holds at most so many times its core, as far as the candidates tell.
MOST_MET = 4


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """Rows of unit length in double precision."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _apart(candidates: np.ndarray, least_cosine: float, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the candidates kept as pivots, and for each candidate the place of the pivot that stands for it.

    A candidate is dropped when its cosine to a pivot kept before reaches ``least_cosine``.
    """
    kept: list[int] = []
    stands = np.zeros(len(candidates), np.int64)
    for at in range(0, len(candidates), block):
        part = candidates[at : at + block]
        best, place = np.full(len(part), -2.0), np.zeros(len(part), np.int64)
        if kept:
            cosines = part @ candidates[kept].T
            place = cosines.argmax(axis=1)
            best = cosines[np.arange(len(part)), place]
        among = part @ part.T
        for i in range(len(part)):
            if best[i] < least_cosine:
                better = among[i] > best
                best, place = np.where(better, among[i], best), np.where(better, len(kept), place)
                kept.append(at + i)
        stands[at : at + len(part)] = place
    return np.array(kept, np.int64), stands


def _dense(pivots: np.ndarray, candidates: np.ndarray, stands: np.ndarray, reach: float, most: int, block: int = 256) -> np.ndarray:
    """Which pivots get a ball list: those of two candidates and more whose list is at most ``most`` times its core, by the candidates."""
    cores, met = np.bincount(stands, minlength=len(pivots)), np.zeros(len(pivots), np.int64)
    for at in range(0, len(candidates), block):
        met += (candidates[at : at + block] @ pivots.T >= reach).sum(axis=0)
    return (cores >= 2) & (met <= most * cores)


def _describe(pivots: np.ndarray, dense: np.ndarray, first: int, near_cosine: float, reach: float):
    """Per vector the numbers of its ``first`` nearest pivots, nearest first, and its lists: twice the key, plus 1 for a guest.

    A vector within ``near_cosine`` of its nearest pivot, where that is dense, is in the core of that pivot's ball list and in no list of
    a pair.  All vectors are guests of the dense pivots within ``reach``; two cores meet in the list of the lower pivot only.
    """
    count = len(pivots)
    near = min(first, count)
    pairs = list(combinations(range(near), 2)) or [(0, 0)]
    left, right = np.array(pairs).T

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vectors = _matrix(part.column("v"), part.num_rows)
                cosines = vectors @ pivots.T
                order = np.argsort(-cosines, axis=1, kind="stable")[:, :near]
                ordered = np.sort(order, axis=1)
                keys = 2 * (ordered[:, left] * count + ordered[:, right])
                home = order[:, 0]
                core = dense[home] & (cosines[np.arange(len(home)), home] >= near_cosine)
                guest = dense & (cosines >= reach) & (~core[:, None] | (np.arange(count) < home[:, None]))
                lists = []
                for i in range(len(home)):
                    own = [2 * (count * count + home[i])] if core[i] else keys[i]
                    lists.append(np.concatenate([own, 2 * (count * count + np.flatnonzero(guest[i])) + 1]).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        part.column("weight"),
                        part.column("v"),
                        pa.array(list(order.astype(np.int64)), pa.list_(pa.int64())),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    ["node", "weight", "v", "pivots", "keys"],
                )

    return describe


def _first_shared(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Key of the two smallest pivots that rows of ``a`` and ``b`` share."""
    shared = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, count)
    shared.sort(axis=1)
    return shared[:, 0] * count + shared[:, 1] if a.shape[1] > 1 else shared[:, 0] * count + shared[:, 0]


def _verify(threshold: float, count: int, block: int = 256):
    def verify(table: pa.Table) -> pa.Table:
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        ball = key >= count * count
        table = table.combine_chunks()
        n = table.num_rows
        node, weight, own = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "weight", "own"))
        vectors = _matrix(table.column("v").chunk(0), n)
        pivots = table.column("pivots").chunk(0).flatten().to_numpy().reshape(n, -1)
        rows = np.flatnonzero(own == i)
        others = np.flatnonzero(own == j)
        links, label = np.zeros(n, np.int64), np.arange(n)
        for at in range(0, len(rows), block):
            mine = rows[at : at + block]
            linked = vectors[mine] @ vectors[others].T >= threshold
            if i == j:
                linked &= mine[:, None] < others
            x, y = np.nonzero(linked)
            a, b = mine[x], others[y]
            if ball:  # every pair of a ball list is met there alone
                links[mine] += (linked @ weight[others].astype(np.float64)).astype(np.int64)
                links[others] += (weight[mine].astype(np.float64) @ linked).astype(np.int64)
            for left, right in () if ball else ((a[s : s + (1 << 18)], b[s : s + (1 << 18)]) for s in range(0, len(a), 1 << 18)):
                here = _first_shared(pivots[left], pivots[right], count) == key
                np.add.at(links, left[here], weight[right[here]])
                np.add.at(links, right[here], weight[left[here]])
            for a_row, near in zip(*_by_first(a, b)):
                groups = np.unique(label[np.append(near, a_row)])
                if len(groups) > 1:
                    label[np.isin(label, groups)] = groups[0]
        out = np.flatnonzero((links > 0) | (label != np.arange(n)))
        return pa.table({"a": node[out], "b": node[label[out]], "links": links[out]})

    return verify


def _by_first(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(a):
        return a, []
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return a[starts], np.split(b, starts[1:])


def link_counts(
    nodes: DataFrame, threshold: float, first: int = 6, pivots_per_root: float = 4.0, max_pivots: int = 1 << 15, tile: int = 2048
) -> DataFrame:
    """Rows ``a``, ``b``, ``links`` from ``nodes`` (``node``, ``weight``, ``v``, all vectors of one length).

    ``links`` of all rows of one ``a`` add up to the weight of the vectors it links to; ``a``-``b`` span the groups.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    wanted = min(max_pivots, max(first, math.ceil(pivots_per_root * math.sqrt(total))))
    sample = nodes.orderBy(F.xxhash64("v"), "node").limit(wanted).select("v").toArrow()
    if not total:
        return spark.createDataFrame([], "a long, b long, links long")
    sample = sample.combine_chunks()
    candidates = _matrix(sample.column("v").chunk(0), sample.num_rows)
    kept, stands = _apart(candidates, APART)
    pivots = candidates[kept]
    # A vector that links to one within the angle of APART of a pivot is itself within that angle and the link's of it.
    angle = math.acos(APART) + math.acos(max(-1.0, min(1.0, threshold)))
    reach = math.cos(angle) - 1e-9 if angle < math.pi else -2.0
    dense = _dense(pivots, candidates, stands, reach, MOST_MET)
    kind = nodes.schema["v"].dataType.simpleString()
    described = nodes.select("node", "weight", "v").mapInArrow(
        _describe(pivots, dense, first, APART, reach), f"node long, weight long, v {kind}, pivots array<long>, keys array<long>"
    )
    placed = described.withColumn("at", F.explode("keys")).drop("keys")
    placed = placed.withColumns({"key": F.shiftright("at", 1), "guest": F.col("at") % 2}).drop("at")
    sizes = placed.groupBy("key").agg(F.sum(1 - F.col("guest")).alias("own_rows"), F.sum("guest").alias("guests"))
    sizes = cut_lineage(sizes.filter("own_rows > 0 and own_rows + guests > 1"))
    met = placed.join(sizes, "key").withColumns(
        {"m": F.ceil(F.col("own_rows") / tile).cast("int"), "g": F.ceil(F.col("guests") / tile).cast("int")}
    )
    # Guests have tiles of their own, after the others, that do not meet each other.
    own = F.when(F.col("guest") == 0, F.pmod(F.xxhash64("node"), F.col("m"))).otherwise(F.col("m") + F.pmod(F.xxhash64("node"), F.col("g")))
    met = met.withColumn("own", own.cast("int")).withColumn("last", F.expr("if(guest = 0, m + g, m) - 1"))
    tiles = F.expr("transform(sequence(0, last), t -> struct(least(t, own) as i, greatest(t, own) as j))")
    dealt = met.withColumn("t", F.explode(tiles)).select("key", "t.i", "t.j", "own", "node", "weight", "pivots", "v")
    return dealt.groupBy("key", "i", "j").applyInArrow(_verify(threshold, len(pivots)), "a long, b long, links long")


def near_groups(vectors: DataFrame, threshold: float = 0.95, **settings) -> DataFrame:
    """Per row of ``vectors`` (``vec_id``, ``embedding``): ``n_links``, ``component_id`` and ``kept``.

    Null, empty and zero vectors and those with null or non-finite components link with nothing.  Vectors of different
    lengths have no cosine and do not link.  Rows with equal vectors link to each other; an id may repeat.
    An empty table gives no rows; other columns are not read.
    """
    rows = cut_lineage(vectors.select("vec_id", F.when(usable(F.col("embedding")), F.col("embedding")).alias("v")))
    equal = rows.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    nodes = cut_lineage(equal.withColumns({"node": F.monotonically_increasing_id(), "length": F.size("v")}))
    lengths = [r[0] for r in nodes.select("length").distinct().orderBy("length").collect()]
    found = None
    for length in lengths or [0]:
        part = link_counts(nodes.filter(F.col("length") == length), threshold, **settings)
        found = part if found is None else found.unionByName(part)
    found = cut_lineage(found)
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    tied = components(found.select("a", "b"))
    known = (
        nodes.join(counts, nodes.node == counts.a, "left")
        .join(tied.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        .select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.join(known.join(smallest, "root").select("v", "n_links", "component_id"), "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
