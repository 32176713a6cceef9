"""Gradient boosting with absolute loss for many boosters at once, as grouped aggregates over binned rows.

Rows are binned once into a written table of chunks, and every booster - a tier, a fold, a parameter set - reads the same
chunks.  A level of all trees that grow at a time is one job: map tasks add up signs of the residuals and rows per node,
feature and bin, the sums are grouped by booster and node, and one best split per node comes back to the driver.  A last
job per round renews the leaf values by the medians of their residuals.

Where one task can hold all chunks, every booster is a task instead, and carries itself through all its rounds in one job.
It adds up the same sums, draws the same rows and takes the same medians, so its trees are the same.

What a booster knows is its list of trees, so boosting goes on from any round: the margins of a block of rounds are a column
made from the written chunks and the trees so far.  A booster stops when its validation error was not bettered for
``patience`` rounds; the error decides, not the number of rounds.

The driver holds trees (rounds x leaves) and splits (boosters x nodes of a level), whatever the number of rows, and the
chunks that it sends out to be held.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.session import cut_lineage

#: Bins per feature besides the one of missing values, rows of a chunk, points that stand for the residuals of a leaf.
BINS, CHUNK_ROWS, POINTS, BLOCK = 63, 16384, 256, 10
_WIDTH = BINS + 1

#: Bytes of bins, labels and names, and chunks, up to which one task holds them all; they bound memory and decide nothing.
HELD_BYTES, HELD_CHUNKS = 32 << 20, 512


@dataclass
class Tree:
    """Nodes as arrays; a feature of -1 marks a leaf.  Rows with ``bin <= cut`` go left, missing ones where ``missing_left`` says."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def leaf(cls) -> Tree:
        return cls(np.array([-1]), np.array([0]), np.array([False]), np.array([0]), np.array([0]), np.array([0.0]))

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> tuple[int, int]:
        size = len(self.feature)
        self.feature[node], self.cut[node], self.missing_left[node] = feature, cut, missing_left
        self.left[node], self.right[node] = size, size + 1
        new = Tree.leaf()
        for name in ("feature", "cut", "missing_left", "left", "right", "value"):
            own = getattr(new, name)
            setattr(self, name, np.concatenate([getattr(self, name), own, own]))
        return size, size + 1

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every column of ``bins`` (features x rows)."""
        node, rows = np.zeros(bins.shape[1], np.int32), np.arange(bins.shape[1])
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            own = bins[np.maximum(feature, 0), rows]
            right = np.where(own == 0, ~self.missing_left[node], own > self.cut[node])
            node = np.where(inner, np.where(right, self.right[node], self.left[node]), node)

    def plain(self) -> dict:
        return {k: getattr(self, k).tolist() for k in ("feature", "cut", "missing_left", "left", "right", "value")}

    @classmethod
    def of(cls, plain: dict) -> Tree:
        return cls(**{k: np.array(v, bool if k == "missing_left" else None) for k, v in plain.items()})


@dataclass
class Booster:
    """A booster's task and all it has learned.

    Rows of its ``part`` with a stamp up to ``train_to`` are trained on, those from ``val_from`` to ``val_to`` validate.
    """

    part: str
    train_to: int
    val_from: int
    val_to: int
    step: float = 0.03
    leaves: int = 31
    depth: int = 6
    min_rows: int = 20
    rows_share: float = 0.85
    features_share: float = 0.85
    alpha: float = 0.0
    lam: float = 0.0
    seed: int = 42
    patience: int = 40
    start: float | None = None
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    stopped: bool = False

    @property
    def best(self) -> int:
        """Trees up to the best validation error, one at least."""
        return 1 + int(np.argmin(self.errors[1:])) if len(self.errors) > 1 else len(self.trees)

    def waited(self) -> int:
        return len(self.errors) - 1 - self.best if len(self.errors) > 1 else 0

    def features_of(self, number: int) -> np.ndarray:
        """The features of the next tree."""
        draw = np.random.default_rng([self.seed, len(self.trees)])
        return np.sort(draw.choice(number, max(1, round(number * self.features_share)), replace=False))


# ------------------------------------------------------------------ binned rows


def quantile_cuts(rows: DataFrame, features: list[str], part: str) -> dict[str, list[np.ndarray]]:
    """Cut points per part and feature from mergeable sketches; at most ``BINS - 1`` each."""
    at = [i / BINS for i in range(1, BINS)]
    found = rows.groupBy(part).agg(*[F.percentile_approx(F.col(c).cast("double"), at, 2000).alias(f"c{i}") for i, c in enumerate(features)])
    return {
        row[0]: [np.unique(np.array([x for x in (cuts or []) if np.isfinite(x)])) for cuts in row[1:]] for row in found.collect()
    }


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins (features x rows): 0 for missing, ``x <= cuts[k - 1]`` for bins up to ``k``."""
    out = np.empty(values.shape, np.uint8)
    for i, own in enumerate(cuts):
        out[i] = np.where(np.isnan(values[i]), 0, 1 + np.searchsorted(own, values[i], side="left"))
    return out


CHUNKS = "part string, stamp binary, label binary, naive binary, entity array<string>, bins binary"


def _chunk(cuts: dict[str, list[np.ndarray]], features: int):
    def row(part: str, table: pa.Table) -> pa.RecordBatch:
        def numbers(name: str) -> np.ndarray:
            return table.column(name).to_numpy().astype(float)

        bins = binned(np.stack([numbers(f"x{i}") for i in range(features)]), cuts[part])
        columns = [
            [part],
            [table.column("stamp").to_numpy().astype(np.int32).tobytes()],
            [numbers("label").tobytes()],
            [numbers("naive").tobytes()],
            [table.column("entity").to_pylist()],
            [bins.tobytes()],
        ]
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in CHUNKS.split(", ")])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            parts = whole.column("part").to_numpy()
            for part in set(parts.tolist()) & set(cuts):
                held.setdefault(part, []).append(whole.filter(pa.array(parts == part)))
                if sum(t.num_rows for t in held[part]) >= CHUNK_ROWS:
                    yield row(part, pa.concat_tables(held.pop(part)))
        for part, tables in held.items():
            yield row(part, pa.concat_tables(tables))

    return chunk


def chunked_rows(
    rows: DataFrame, features: list[str], cuts: dict[str, list[np.ndarray]], part: str, stamp: Column, label: str, naive: str, entity: str
) -> DataFrame:
    """The rows as written chunks: bins, labels, stamps, naive values and entities of some thousand rows in one row."""
    read = rows.select(
        F.col(part).alias("part"),
        stamp.cast("int").alias("stamp"),
        F.col(label).cast("double").alias("label"),
        F.coalesce(F.col(naive).cast("double"), F.lit(float("nan"))).alias("naive"),
        F.col(entity).cast("string").alias("entity"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(features)],
    )
    return cut_lineage(read.mapInArrow(_chunk(cuts, len(features)), CHUNKS))


# ------------------------------------------------------------------ jobs over chunks


@dataclass
class _Task:
    """What a map task needs to know of one booster in one job."""

    number: int
    place: int
    booster: Booster
    recent: list[Tree]
    tree: Tree
    frontier: list[int]
    used: np.ndarray
    start: float


def _margins(starts: dict[str, list[tuple[float, float, list[Tree]]]]):
    """Adds ``margin``, the sums of all trees of each booster of the chunk's part, one after the other."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                label = np.frombuffer(one.column("label")[0].as_py())
                bins = np.frombuffer(one.column("bins")[0].as_py(), np.uint8).reshape(-1, len(label))
                sums = []
                for start, step, trees in starts.get(one.column("part")[0].as_py(), []):
                    total = np.full(len(label), start)
                    for tree in trees:
                        total += step * tree.value[tree.nodes_of(bins)]
                    sums.append(total)
                margin = np.concatenate(sums).tobytes() if sums else b""
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([margin], pa.binary())], [*one.schema.names, "margin"])

    return add


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            label = np.frombuffer(batch.column("label")[i].as_py())
            yield {
                "part": batch.column("part")[i].as_py(),
                "label": label,
                "stamp": np.frombuffer(batch.column("stamp")[i].as_py(), np.int32),
                "bins": np.frombuffer(batch.column("bins")[i].as_py(), np.uint8).reshape(-1, len(label)),
                "margin": np.frombuffer(batch.column("margin")[i].as_py()).reshape(-1, len(label)),
                "batch": batch,
                "i": i,
            }


def _now(task: _Task, chunk: dict, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and residuals of some rows of a chunk."""
    bins = chunk["bins"][:, rows]
    margin = chunk["margin"][task.place][rows]
    for tree in task.recent:
        margin = margin + task.booster.step * tree.value[tree.nodes_of(bins)]
    return bins, chunk["label"][rows] - margin


def _trained(task: _Task, chunk: dict, bagged: bool) -> np.ndarray:
    train = chunk["stamp"] <= task.booster.train_to
    if bagged and task.booster.rows_share < 1:
        train = train & (_draw(task.booster, _mark(chunk["label"]), len(train)) < task.booster.rows_share)
    return np.flatnonzero(train)


def _mark(label: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(label.view(np.uint64))) & 0xFFFFFFFF if len(label) else 0


def _draw(b: Booster, mark: int, rows: int) -> np.ndarray:
    """The same numbers at every level of a tree: they depend on the chunk's rows and the round only."""
    return np.random.default_rng([b.seed, len(b.trees), mark]).random(rows)


_SUMS = "booster int, node int, sums binary, error double, n long"
_ERROR_NODE = -1


def _sum_level(tasks: dict[str, list[_Task]], first: bool):
    """Signs of residuals and rows per node, feature and bin; in the first level also the validation error."""

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        errors: dict[int, list] = {}
        nodes: dict[int, _Task] = {}
        for chunk in _chunks(batches):
            for task in tasks.get(chunk["part"], []):
                if first:
                    b = task.booster
                    val = np.flatnonzero((chunk["stamp"] >= b.val_from) & (chunk["stamp"] <= b.val_to))
                    error = errors.setdefault(task.number, [0.0, 0])
                    error[0] += float(np.abs(_now(task, chunk, val)[1]).sum())
                    error[1] += len(val)
                if not task.frontier:
                    continue
                rows = _trained(task, chunk, True)
                bins, residual = _now(task, chunk, rows)
                place = np.full(len(task.tree.feature), -1)
                place[task.frontier] = np.arange(len(task.frontier))
                at = place[task.tree.nodes_of(bins)]
                here = at >= 0
                used = bins[task.used][:, here]
                sign = np.sign(residual[here])
                cells = (at[here] * len(task.used) + np.arange(len(task.used))[:, None]) * _WIDTH + used
                size = len(task.frontier) * len(task.used) * _WIDTH
                flat = cells.ravel()
                own = np.stack(
                    [np.bincount(flat, np.broadcast_to(sign, cells.shape).ravel(), size), np.bincount(flat, minlength=size)]
                ).astype(np.int64)
                nodes[task.number] = task
                sums[task.number] = sums[task.number] + own if task.number in sums else own
        out = [(number, _ERROR_NODE, b"", e, n) for number, (e, n) in errors.items()]
        for number, own in sums.items():
            parts = own.reshape(2, len(nodes[number].frontier), -1).transpose(1, 0, 2)
            out += [(number, node, np.ascontiguousarray(p).tobytes(), 0.0, 0) for node, p in zip(nodes[number].frontier, parts)]
        if out:
            yield _record(out, [pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int64()], _SUMS)

    return level


def _record(rows: list[tuple], kinds: list[pa.DataType], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in names.split(", ")])


_SPLITS = "booster int, node int, feature int, cut int, missing_left boolean, gain double, error double, n long"


def best_split(signs: np.ndarray, counts: np.ndarray, min_rows: int, alpha: float, lam: float) -> tuple[int, int, bool, float]:
    """Feature, cut, side of missing values and gain of the best split of a node; feature -1 where there is none.

    ``signs`` and ``counts`` are features x bins, bin 0 for missing values.
    """
    feature, cut, missing_left, gain = (x[0] for x in best_splits(signs[None], counts[None], min_rows, alpha, lam))
    return int(feature), int(cut), bool(missing_left), float(gain)


def best_splits(signs: np.ndarray, counts: np.ndarray, min_rows: int, alpha: float, lam: float) -> tuple[np.ndarray, ...]:
    """:func:`best_split` of many nodes at once: arrays over the nodes, from sums of nodes x features x bins."""

    def score(g: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(g) - alpha, 0) ** 2 / np.maximum(n + lam, 1e-12)

    many, cuts = len(signs), signs.shape[2] - 1
    feature, cut, left, best = np.full(many, -1), np.zeros(many, int), np.ones(many, bool), np.zeros(many)
    missing = counts[:, :, 0] != 0
    for missing_left in (True, False):
        # Without missing values both sides are one; the first was tried.
        nodes = np.arange(many) if missing_left else np.flatnonzero(missing.any(axis=1))
        if not len(nodes):
            break
        fields = np.arange(signs.shape[1]) if missing_left else np.flatnonzero(missing.any(axis=0))
        own_signs, own_counts = (signs, counts) if missing_left else (x[np.ix_(nodes, fields)] for x in (signs, counts))
        g, n = own_signs.sum(axis=2, keepdims=True, dtype=float), own_counts.sum(axis=2, keepdims=True, dtype=float)
        low_g, low_n = np.cumsum(own_signs[:, :, 1:], axis=2, dtype=float), np.cumsum(own_counts[:, :, 1:], axis=2, dtype=float)
        if missing_left:
            low_g, low_n = low_g + own_signs[:, :, :1], low_n + own_counts[:, :, :1]
        high_n = n - low_n
        gain = score(low_g, low_n) + score(g - low_g, high_n) - score(g, n)
        gain = np.where((low_n >= min_rows) & (high_n >= min_rows), gain, 0.0).reshape(len(nodes), -1)
        at = gain.argmax(axis=1)
        most = gain[np.arange(len(nodes)), at]
        better = most > best[nodes] + 1e-9
        at, chosen = at[better], nodes[better]
        feature[chosen], cut[chosen] = fields[at // cuts], at % cuts + 1
        left[chosen], best[chosen] = missing_left, most[better]
    return feature, cut, left, best


def _best_splits(settings: dict[int, tuple[np.ndarray, int, float, float]]):
    """Adds up what the tasks found; rows of one booster and node meet in one partition, which holds one sum for each."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        errors: dict[tuple[int, int], tuple[float, int]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["booster"], row["node"])
                error, n = errors.get(key, (0.0, 0))
                errors[key] = (error + row["error"], n + row["n"])
                if row["sums"]:
                    own = np.frombuffer(row["sums"], np.int64)
                    totals[key] = totals[key] + own if key in totals else own
        nodes: dict[int, list[int]] = {}
        for booster, node in totals:
            nodes.setdefault(booster, []).append(node)
        found: dict[tuple[int, int], tuple] = {}
        for booster, own in nodes.items():
            used, *limits = settings[booster]
            sums = np.stack([totals[booster, node] for node in own]).reshape(len(own), 2, len(used), _WIDTH)
            splits = best_splits(sums[:, 0], sums[:, 1], *limits)
            for node, at, *rest in zip(own, *(x.tolist() for x in splits)):
                found[booster, node] = (int(used[at]) if at >= 0 else -1, *rest)
        out = [(*key, *found.get(key, (-1, 0, True, 0.0)), error, n) for key, (error, n) in errors.items()]
        if out:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.int64()]
            yield _record(out, kinds, _SPLITS)

    return best


def _by_key(rows: DataFrame, keys: int) -> DataFrame:
    """All rows of a booster and node in one partition; as many partitions as the cluster works on at a time."""
    return rows.repartition(max(1, min(keys, rows.sparkSession.sparkContext.defaultParallelism)), "booster", "node")


_POINTS = "booster int, node int, points array<double>, weight double"


def summary(values: np.ndarray) -> tuple[np.ndarray, float]:
    """At most ``POINTS`` of the values at even ranks, and how many values each stands for."""
    if len(values) <= POINTS:
        return values, 1.0
    at = ((np.arange(POINTS) + 0.5) / POINTS * len(values)).astype(int)
    return np.sort(values)[at], len(values) / POINTS


def weighted_median(points: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(points, kind="stable")
    points, upto = points[order], np.cumsum(weights[order])
    half = upto[-1] / 2
    low = int(np.searchsorted(upto, half * (1 - 1e-12)))
    high = int(np.searchsorted(upto, half * (1 + 1e-12), side="right"))
    return float((points[low] + points[min(high, len(points) - 1)]) / 2)


def _leaf_points(tasks: dict[str, list[_Task]]):
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            out = []
            for task in tasks.get(chunk["part"], []):
                bins, residual = _now(task, chunk, _trained(task, chunk, False))
                at = task.tree.nodes_of(bins)
                order = np.argsort(at, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0, True]) if len(at) else []
                for a, b in zip(edges[:-1], edges[1:]):
                    points, weight = summary(residual[order[a:b]])
                    out.append((task.number, int(at[order[a]]), points.tolist(), weight))
            if out:
                yield _record(out, [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64()], _POINTS)

    return leaves


def _median(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted median of the points of each booster and node."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            own = held.setdefault((row["booster"], row["node"]), [])
            own.append((np.array(row["points"]), np.full(len(row["points"]), row["weight"])))
            if len(own) > 1024:
                points, weights = (np.concatenate(x) for x in zip(*own))
                # Even ranks of what is held stand for it, so a leaf with many chunks stays small.
                order = np.argsort(points, kind="stable")
                upto = np.cumsum(weights[order])
                keep = 64 * POINTS
                at = np.searchsorted(upto, (np.arange(keep) + 0.5) / keep * upto[-1])
                own[:] = [(points[order][at], np.full(keep, upto[-1] / keep))]
    out = [(*key, weighted_median(*(np.concatenate(x) for x in zip(*own)))) for key, own in held.items()]
    if out:
        yield _record(out, [pa.int32(), pa.int32(), pa.float64()], "booster, node, value")


# ------------------------------------------------------------------ all rows in one task


def _held(chunks: DataFrame) -> pa.Table | None:
    """All chunks, if one task can hold them."""
    size = F.length("bins") + F.length("label") + F.length("naive") + F.length("stamp") + F.length(F.array_join("entity", ""))
    found = chunks.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("chunks")).first()
    return chunks.toArrow() if found["bytes"] <= HELD_BYTES and found["chunks"] <= HELD_CHUNKS else None


def _each_booster(chunks: DataFrame, held: pa.Table, boosters: list[Booster], work: Callable[[_HeldRows, Booster], object]) -> list:
    """``work`` on every booster and the rows of its part, a task each."""
    if not boosters:
        return []
    context = chunks.sparkSession.sparkContext
    sent = context.broadcast(held)

    def one(packed: tuple) -> object:
        booster = _unpacked(packed)
        return work(_HeldRows(sent.value, booster), booster)

    try:
        return context.parallelize([_packed(b) for b in boosters], len(boosters)).map(one).collect()
    finally:
        sent.destroy()


_NODES = {"feature": np.int32, "cut": np.int32, "missing_left": bool, "left": np.int32, "right": np.int32, "value": float}


def _packed(b: Booster, since: int = 0) -> tuple[dict, list[int], list[bytes]]:
    """A booster as few bytes: its fields, and its trees from ``since`` on as one array per field of their nodes."""
    plain = {**vars(b), "trees": []}
    trees = b.trees[since:]
    fields = [np.concatenate([getattr(t, k) for t in trees] or [np.empty(0)]).astype(kind).tobytes() for k, kind in _NODES.items()]
    return plain, [len(t.feature) for t in trees], fields


def _unpacked(packed: tuple[dict, list[int], list[bytes]]) -> Booster:
    plain, sizes, fields = packed
    edges = np.cumsum(sizes)[:-1] if sizes else []
    parts = [np.split(np.frombuffer(f, kind).astype(int if kind is np.int32 else kind), edges) for f, kind in zip(fields, _NODES.values())]
    return Booster(**{**plain, "trees": [Tree(*t) for t in zip(*parts)] if sizes else []})


class _HeldRows:
    """The rows of a booster's part that it trains on or validates with; ``bins`` and ``cells`` are rows x features."""

    def __init__(self, held: pa.Table, b: Booster):
        own = held.filter(pc.equal(held.column("part"), b.part))

        def column(name: str, kind: type) -> list[np.ndarray]:
            return [np.frombuffer(x.as_py(), kind) for x in own.column(name)] or [np.empty(0, kind)]

        labels, stamp = column("label", float), np.concatenate(column("stamp", np.int32))
        self.sizes = [len(x) for x in labels]
        self.marks = [_mark(x) for x in labels]
        train, val = stamp <= b.train_to, (stamp >= b.val_from) & (stamp <= b.val_to)
        self.kept = np.flatnonzero(train | val)
        self.label = np.concatenate(labels)[self.kept]
        self.naive = np.concatenate(column("naive", float))[self.kept]
        self.chunk = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.kept]
        self.train, self.val = np.flatnonzero(train[self.kept]), np.flatnonzero(val[self.kept])
        bins = [x.reshape(-1, n) for x, n in zip(column("bins", np.uint8), self.sizes) if n]
        self.bins = np.ascontiguousarray(np.concatenate(bins, axis=1).T[self.kept]) if bins else np.empty((0, 0), np.uint8)
        self.entity = own.column("entity")

    def margin(self, b: Booster, rows: np.ndarray) -> np.ndarray:
        """Start and all trees of the booster, added in their order."""
        bins, total = np.ascontiguousarray(self.bins[rows].T), np.full(len(rows), b.start or 0.0)
        for tree in b.trees if len(rows) else []:
            total += b.step * tree.value[tree.nodes_of(bins)]
        return total

    def bagged(self, b: Booster) -> np.ndarray:
        """The training rows of the next tree, as :func:`_trained` draws them."""
        if b.rows_share >= 1:
            return self.train
        draws = [_draw(b, mark, n) for mark, n in zip(self.marks, self.sizes)]
        return self.train[(np.concatenate(draws) < b.rows_share)[self.kept[self.train]]]

    def medians(self, at: np.ndarray, residual: np.ndarray, nodes: int) -> np.ndarray:
        """What :func:`summary` and :func:`weighted_median` give for each node; ``at`` are nodes of the training rows.

        Weights are multiples of 1 / ``POINTS``, so their sums are exact in any order.
        """
        chunks = len(self.sizes)
        group = at * chunks + self.chunk[self.train]
        order = np.argsort(residual)
        # Sorting by 16 bits takes one pass.
        narrow = group[order].astype(np.uint16 if nodes * chunks <= 1 << 16 else np.int64)
        order = order[np.argsort(narrow, kind="stable")]
        n = np.bincount(group, minlength=nodes * chunks)
        large = np.flatnonzero(n > POINTS)
        firsts = np.cumsum(n) - n
        ranks = ((np.arange(POINTS) + 0.5) / POINTS * n[large][:, None]).astype(int) + firsts[large][:, None]
        place = np.concatenate([np.flatnonzero(np.repeat(n <= POINTS, n)), ranks.ravel()])
        weight = np.concatenate([np.ones(len(place) - ranks.size), np.repeat(n[large] / POINTS, POINTS)])
        points, node = residual[order[place]], at[order[place]]
        sort = np.lexsort((points, node)) if chunks > 1 else np.argsort(place)
        points, node, upto = points[sort], node[sort], np.cumsum(weight[sort])
        value = np.zeros(nodes)
        ends = np.flatnonzero(np.r_[node[1:] != node[:-1], True]) if len(node) else np.empty(0, int)
        before = np.r_[0.0, upto[ends][:-1]] if len(ends) else np.empty(0)
        half = before + (upto[ends] - before) / 2
        low, high = np.searchsorted(upto, half), np.minimum(np.searchsorted(upto, half, side="right"), ends)
        value[node[ends]] = (points[low] + points[high]) / 2
        return value


def _carry_on(rows: _HeldRows, b: Booster, features: int, rounds: int) -> None:
    """What :func:`boost` does to one booster, by the task that holds its rows."""
    if b.start is None:
        b.start = float(rows.medians(np.zeros(len(rows.train), int), rows.label[rows.train], 1)[0])
    margin = rows.margin(b, np.arange(len(rows.label)))
    fields = rows.bins.shape[1]
    cells = rows.bins + (np.arange(fields) * _WIDTH).astype(np.uint16 if fields * _WIDTH <= 1 << 16 else np.uint32)
    while not b.stopped and len(b.errors) <= rounds:
        residual = rows.label - margin
        if len(b.errors) == len(b.trees):
            b.errors.append(float(np.abs(residual[rows.val]).sum()) / max(1, len(rows.val)))
        b.stopped = b.waited() >= b.patience
        if b.stopped or len(b.trees) >= rounds:
            continue
        tree, node = _grown(rows, cells, b, residual, b.features_of(features))
        tree.value = rows.medians(node[rows.train], residual[rows.train], len(tree.feature))
        margin = margin + b.step * tree.value[node]
        b.trees.append(tree)


def _grown(rows: _HeldRows, cells: np.ndarray, b: Booster, residual: np.ndarray, used: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The next tree, level by level as :func:`_grow_round` grows it, and the leaf of every row.

    Of two children the one with fewer rows is added up; the other has the rest of their parent.
    """
    most = max(1, 2 * b.leaves - 1)
    feature, cut, missing_left, left = np.full(most, -1), np.zeros(most, int), np.zeros(most, bool), np.zeros(most, int)
    size, leaves, depth = 1, 1, 0
    node, live, bag = np.zeros(len(residual), int), np.arange(len(residual)), rows.bagged(b)
    sign = np.sign(residual).astype(int)
    kinds = 3 if (sign[bag] == 0).any() else 2
    kind = np.where(sign > 0, 1, np.where(sign < 0, 0, 2))
    fields, flat, child = rows.bins.shape[1], rows.bins.ravel(), np.zeros((most, _WIDTH), int)

    def sums(own: np.ndarray, place: np.ndarray, many: int) -> np.ndarray:
        """Signs and rows per place, feature and bin."""
        first = (place * kinds + kind[own]) * (fields * _WIDTH)
        found = np.bincount((cells[own] + first[:, None]).ravel(), minlength=many * kinds * fields * _WIDTH)
        found = found.reshape(many, kinds, fields, _WIDTH)
        return np.stack([found[:, 1] - found[:, 0], found.sum(axis=1)], axis=1)

    frontier = np.zeros(1, int)
    table = sums(bag, np.zeros(len(bag), int), 1) if fields else np.zeros((1, 2, 0, _WIDTH), int)
    while len(frontier) and fields:
        field, at, side, gain = best_splits(table[:, 0, used], table[:, 1, used], b.min_rows, b.alpha, b.lam)
        depth += 1
        chosen = []
        for i in np.lexsort((frontier, -gain)).tolist():
            if field[i] >= 0 and gain[i] > 0 and leaves < b.leaves:
                parent = frontier[i]
                feature[parent], cut[parent], missing_left[parent], left[parent] = used[field[i]], at[i], side[i], size
                chosen.append(i)
                size, leaves = size + 2, leaves + 1
        if not chosen:
            break
        # Rows of split nodes move to the child of their bin; the others are where they stay.
        parents = frontier[chosen]
        child[parents] = left[parents][:, None] + (np.arange(_WIDTH) > cut[parents][:, None])
        child[parents, 0] = left[parents] + ~missing_left[parents]
        if len(chosen) < len(frontier):
            live = live[feature[node[live]] >= 0]
        parent = node[live]
        node[live] = child.ravel()[parent * _WIDTH + flat[live * fields + feature[parent]]]
        if depth >= b.depth or leaves >= b.leaves:
            break
        table = table[chosen]
        frontier = (left[parents][:, None] + np.arange(2)).ravel()
        bag = bag[node[bag] >= frontier[0]]
        place = node[bag] - frontier[0]
        count = np.bincount(place, minlength=len(frontier)).reshape(-1, 2)
        fewer = (count[:, 1] < count[:, 0]).astype(int)
        small = fewer[place >> 1] == (place & 1)
        low = sums(bag[small], place[small] >> 1, len(parents))
        pairs = np.empty((len(parents), 2, *table.shape[1:]), table.dtype)
        pairs[np.arange(len(parents)), fewer] = low
        pairs[np.arange(len(parents)), 1 - fewer] = table - low
        table = pairs.reshape(-1, *table.shape[1:])
    inner = feature[:size] >= 0
    right = np.where(inner, left[:size] + 1, 0)
    return Tree(feature[:size], cut[:size], missing_left[:size], left[:size], right, np.zeros(size)), node


def _judged(rows: _HeldRows, b: Booster) -> tuple[float, float] | None:
    """What :func:`judged_wmape` gives for one booster, by the task that holds its rows."""
    if not len(rows.val):
        return None
    label = rows.label[rows.val]
    error, off = np.abs(label - rows.margin(b, rows.val)), np.abs(label - rows.naive[rows.val])
    known = ~np.isnan(off)
    names = np.concatenate([np.array(x.as_py(), object) for x in rows.entity])[rows.kept[rows.val]]
    entity, _ = pd.factorize(names, use_na_sentinel=False)

    def per_entity(values: np.ndarray) -> np.ndarray:
        return np.bincount(entity, np.where(known, values, 0.0))

    lost = (per_entity(error) > per_entity(off))[entity]
    judged, plain = np.where(lost, np.where(known, off, 0.0), error).sum(), error.sum()
    truth = np.abs(label)
    return 100.0 * float(judged) / (float(truth[~lost | known].sum()) + 1e-8), 100.0 * float(plain) / (float(truth.sum()) + 1e-8)


# ------------------------------------------------------------------ the loop


def _by_part(tasks: list[_Task]) -> dict[str, list[_Task]]:
    out: dict[str, list[_Task]] = {}
    for task in tasks:
        out.setdefault(task.booster.part, []).append(task)
    return out


def _slim(task: _Task) -> _Task:
    """The task without what a map task has no use for."""
    b = task.booster
    marker = [None] * len(b.trees)
    light = Booster(b.part, b.train_to, b.val_from, b.val_to, b.step, rows_share=b.rows_share, seed=b.seed, trees=marker)
    return _Task(task.number, task.place, light, task.recent, task.tree, task.frontier, task.used, task.start)


def _renew_leaves(state: DataFrame, tasks: list[_Task]) -> None:
    """Leaf values by the medians of their residuals, to 1/256 of the ranks of a chunk."""
    points = state.mapInArrow(_leaf_points(_by_part([_slim(t) for t in tasks])), _POINTS)
    medians = _by_key(points, sum(int((t.tree.feature < 0).sum()) for t in tasks)).mapInArrow(_median, "booster int, node int, value double")
    by_number = {t.number: t for t in tasks}
    for row in medians.collect():
        by_number[row["booster"]].tree.value[row["node"]] = row["value"]


def boost(chunks: DataFrame, boosters: list[Booster], features: int, rounds: int) -> list[Booster]:
    """Carry all boosters to ``rounds`` trees, or to where their validation error no longer falls.

    Boosters that have trees go on from them.  Where a task can hold all chunks there is one job with a task per booster;
    otherwise all boosters that are still growing share every job.
    """
    held = _held(chunks)
    if held is not None:
        active = [b for b in boosters if not b.stopped and len(b.errors) <= rounds]
        # The longest tasks first.
        active.sort(key=lambda b: (len(b.errors) - rounds) * b.leaves)

        def grow(rows: _HeldRows, b: Booster) -> tuple:
            since = len(b.trees)
            _carry_on(rows, b, features, rounds)
            return _packed(b, since)

        for b, packed in zip(active, _each_booster(chunks, held, active, grow)):
            done = _unpacked(packed)
            b.start, b.errors, b.stopped = done.start, done.errors, done.stopped
            b.trees += done.trees
        return boosters
    state, recent_from, places = None, 0, {}
    try:
        while True:
            active = [i for i, b in enumerate(boosters) if not b.stopped and len(b.errors) <= rounds]
            if not active:
                return boosters
            oldest = max(len(boosters[i].trees) - places.get(i, (0, 0))[1] for i in active) if state is not None else BLOCK
            if state is None or oldest >= BLOCK or any(i not in places for i in active):
                if state is not None:
                    state.unpersist()
                starts: dict[str, list] = {}
                places = {}
                for i in active:
                    b = boosters[i]
                    own = starts.setdefault(b.part, [])
                    places[i] = (len(own), len(b.trees))
                    own.append((b.start or 0.0, b.step, list(b.trees)))
                state = chunks.filter(F.col("part").isin(list(starts))).mapInArrow(_margins(starts), CHUNKS + ", margin binary").persist()

            def task(i: int, tree: Tree, frontier: list[int], used: np.ndarray) -> _Task:
                b = boosters[i]
                return _Task(i, places[i][0], b, b.trees[places[i][1] :], tree, frontier, used, b.start or 0.0)

            fresh = [i for i in active if boosters[i].start is None]
            if fresh:
                tasks = [task(i, Tree.leaf(), [0], np.arange(0)) for i in fresh]
                _renew_leaves(state, tasks)
                for t in tasks:
                    boosters[t.number].start = float(t.tree.value[0])
                places = {}
                continue
            _grow_round(state, [task(i, Tree.leaf(), [0], boosters[i].features_of(features)) for i in active], boosters, rounds)
    finally:
        if state is not None:
            state.unpersist()


def _grow_round(state: DataFrame, tasks: list[_Task], boosters: list[Booster], rounds: int) -> None:
    """One tree for every booster, after the validation error of the trees before it."""
    for t in tasks:
        if len(t.booster.trees) >= rounds:
            t.frontier = []
    leaves = {t.number: 1 for t in tasks}
    growing, first, depth = tasks, True, 0
    while growing:
        sums = state.mapInArrow(_sum_level(_by_part([_slim(t) for t in growing]), first), _SUMS)
        settings = {t.number: (t.used, t.booster.min_rows, t.booster.alpha, t.booster.lam) for t in growing}
        found: dict[int, list] = {}
        keys = sum(len(t.frontier) for t in growing) + len(growing) * first
        for row in _by_key(sums, keys).mapInArrow(_best_splits(settings), _SPLITS).collect():
            if row["node"] == _ERROR_NODE:
                b = boosters[row["booster"]]
                if len(b.errors) == len(b.trees):
                    b.errors.append(row["error"] / max(1, row["n"]))
                b.stopped = b.waited() >= b.patience
            else:
                found.setdefault(row["booster"], []).append(row)
        if first:
            growing = tasks = [t for t in tasks if not t.booster.stopped and t.frontier]
            first = False
        depth += 1
        for t in growing:
            t.frontier = []
            for row in sorted(found.get(t.number, []), key=lambda r: (-r["gain"], r["node"])):
                if row["feature"] >= 0 and row["gain"] > 0 and leaves[t.number] < t.booster.leaves:
                    t.frontier += t.tree.split(row["node"], row["feature"], row["cut"], row["missing_left"])
                    leaves[t.number] += 1
        growing = [t for t in growing if t.frontier and depth < t.booster.depth and leaves[t.number] < t.booster.leaves]
    if tasks:
        _renew_leaves(state, tasks)
    for t in tasks:
        t.booster.trees.append(t.tree)


# ------------------------------------------------------------------ fitted models


@dataclass(frozen=True)
class BoostedTrees:
    """What scoring needs: cut points of the features, start value, step and trees up to the best error."""

    cuts: list[np.ndarray]
    start: float
    step: float
    trees: list[Tree]

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @classmethod
    def of(cls, booster: Booster, cuts: dict[str, list[np.ndarray]]) -> BoostedTrees:
        return cls(cuts[booster.part], booster.start, booster.step, booster.trees[: booster.best])

    def score(self, values: np.ndarray) -> np.ndarray:
        """Predictions for raw values (features x rows)."""
        bins = binned(values, self.cuts)
        total = np.full(bins.shape[1], self.start)
        for tree in self.trees:
            total += self.step * tree.value[tree.nodes_of(bins)]
        return total

    def to_json(self) -> str:
        return json.dumps(
            {"cuts": [c.tolist() for c in self.cuts], "start": self.start, "step": self.step, "trees": [t.plain() for t in self.trees]}
        )

    @classmethod
    def from_json(cls, text: str) -> BoostedTrees:
        plain = json.loads(text)
        return cls([np.array(c, float) for c in plain["cuts"]], plain["start"], plain["step"], [Tree.of(t) for t in plain["trees"]])


def score_column(models: dict[str, BoostedTrees], tier: Column, inputs: list[Column]) -> Column:
    """The prediction of each row by the model of its tier; null for a tier without one."""

    @F.pandas_udf("double")
    def score(tiers: pd.Series, values: pd.DataFrame) -> pd.Series:
        out = np.full(len(tiers), np.nan)
        matrix = values.to_numpy(dtype=float, na_value=np.nan).T
        for name, model in models.items():
            rows = (tiers == name).to_numpy(dtype=bool)
            if rows.any():
                out[rows] = model.score(matrix[:, rows])
        return pd.Series(out).where(~np.isnan(out), None)

    return score(tier, F.struct(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(inputs)]))


# ------------------------------------------------------------------ validation with fallback


_JUDGED = "booster int, entity string, n long, model_error double, naive_error double, both long, truth double, model_all double, truth_naive double"


def _judge(tasks: dict[str, list[_Task]]):
    """Per booster and entity the sums that its guardrail and its WMAPE need, over the validation rows."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            batch, i = chunk["batch"], chunk["i"]
            naive = np.frombuffer(batch.column("naive")[i].as_py())
            entity = pd.Series(batch.column("entity")[i].as_py())
            out = []
            for task in tasks.get(chunk["part"], []):
                b = task.booster
                rows = np.flatnonzero((chunk["stamp"] >= b.val_from) & (chunk["stamp"] <= b.val_to))
                if not len(rows):
                    continue
                label, error = chunk["label"][rows], np.abs(_now(task, chunk, rows)[1])
                off = np.abs(label - naive[rows])
                known = ~np.isnan(off)
                sums = pd.DataFrame(
                    {
                        "entity": entity.iloc[rows].to_numpy(),
                        "n": 1,
                        "model_error": np.where(known, error, 0.0),
                        "naive_error": np.where(known, off, 0.0),
                        "both": known.astype(np.int64),
                        "truth": np.abs(label),
                        "model_all": error,
                        "truth_naive": np.where(known, np.abs(label), 0.0),
                    }
                )
                grouped = sums.groupby("entity", dropna=False).sum()
                out += [(task.number, *row) for row in grouped.itertuples(name=None)]
            if out:
                f, n = pa.float64(), pa.int64()
                yield _record([(k, None if e != e else e, *r) for k, e, *r in out], [pa.int32(), pa.string(), n, f, f, n, f, f, f], _JUDGED)

    return judge


def judged_wmape(chunks: DataFrame, boosters: list[Booster]) -> dict[int, tuple[float, float]]:
    """Validation WMAPE of every booster at its best round: entities that lose to the naive value falling back to it, and without.

    Boosters without a valid row are left out.
    """
    held = _held(chunks)
    if held is not None:
        best = [replace(b, trees=b.trees[: b.best]) for b in boosters]
        found = _each_booster(chunks, held, best, _judged)
        return {i: judged for i, judged in enumerate(found) if judged is not None}
    starts: dict[str, list] = {}
    tasks = []
    for i, b in enumerate(boosters):
        own = starts.setdefault(b.part, [])
        task = _Task(i, len(own), b, [], Tree.leaf(), [], np.arange(0), 0.0)
        tasks.append(_slim(task))
        own.append((b.start or 0.0, b.step, b.trees[: b.best]))
    state = chunks.filter(F.col("part").isin(list(starts))).mapInArrow(_margins(starts), CHUNKS + ", margin binary")
    names = ["n", "model_error", "naive_error", "both", "truth", "model_all", "truth_naive"]
    sums = state.mapInArrow(_judge(_by_part(tasks)), _JUDGED).groupBy("booster", "entity").agg(*[F.sum(c).alias(c) for c in names])
    # Means over the same rows compare like their sums.
    lost = (F.col("both") > 0) & (F.col("model_error") > F.col("naive_error"))
    total = sums.groupBy("booster").agg(
        F.sum(F.when(lost, F.col("naive_error")).otherwise(F.col("model_all"))).alias("error"),
        F.sum(F.when(lost, F.col("truth_naive")).otherwise(F.col("truth"))).alias("known"),
        F.sum("model_all").alias("plain_error"),
        F.sum("truth").alias("truth"),
    )
    return {
        r["booster"]: (100.0 * r["error"] / (r["known"] + 1e-8), 100.0 * r["plain_error"] / (r["truth"] + 1e-8))
        for r in total.collect()
    }
