"""Substring dedup by seed and extend on winnowed anchors.

A document is the sequence of its words.  Winnowing gives each window of ``length`` words an anchor, the smallest hash among its
word ``k``-grams, so windows with the same words have the same anchor.  Seeds are anchors that occur in more than one place:
documents meet on them.  Around every seed lie the windows that have it as anchor, to both sides; those that occur elsewhere are found
by digests of all their words, 96 bits from 128 bits a word, and neighbouring ones join into maximal repeats, none shorter than ``length``
words.  The earliest occurrence of a window stays, words under any later one go.

Documents with the same words as an earlier one are settled whole beforehand.  A window's occurrences are reduced to the
earliest of a task before they are shuffled, so a passage in a third of all documents is a few rows per task and word, and
no pairs of documents are formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.text import filled, slices
from panelforge.session import cut_lineage

_STEP, _OTHER = 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits per word (XXH3), as two columns of 64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def _rolled(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hash of every ``width`` consecutive items."""
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(factor) + hashes[j : j + n]
    return _mixed(out)


def anchors(grams: np.ndarray, length: int, k: int) -> np.ndarray:
    """The anchor of every window: the smallest hash among its ``k``-grams."""
    left, have = length - k + 1, 1
    low = grams
    while have < left:  # minima over runs of doubling length
        step = min(have, left - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def seed_runs(hashes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the runs of windows that share one, where runs start (and the last ends), and how often to count each.

    A run whose words repeat a ``k``-gram nearby counts twice: its anchor may occur at two places in it.
    """
    grams = _rolled(hashes, k, _STEP)
    marks = anchors(grams, length, k)
    turns = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
    again = np.zeros(len(grams) + 1, np.int64)
    for gap in range(1, min(length - k + 2, len(grams))):
        again[1:-gap] += grams[:-gap] == grams[gap:]
    total = np.cumsum(again)
    ends = np.r_[turns[1:], len(marks)]
    twice = total[ends + length - k] > total[turns]
    return marks[turns].view(np.int64), np.r_[turns, len(marks)].astype(np.int32), 1 + twice.astype(np.int32)


def window_keys(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of digest per window; each part comes from a half of the words' hashes of its own."""
    one, two = _rolled(hashes[:, 0], length, _STEP), _rolled(hashes[:, 1], length, _OTHER)
    return one.view(np.int64), (two >> np.uint64(32)).astype(np.int32)


def split_words(text: str) -> list[bytes]:
    return text.encode().split()  # on bytes: ASCII white space only


def _seed(length: int, k: int):
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts, digests, found, starts, times = [], [], [], [], []
            for text in part.column("text").to_pylist():
                words = split_words(text)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) >= length:
                    runs = seed_runs(word_hashes(words)[:, 0], length, k)
                else:
                    runs = np.zeros(0, np.int64), np.zeros(1, np.int32), np.zeros(0, np.int32)
                for column, values in zip((found, starts, times), runs):
                    column.append(values)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("h"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests),
                    pa.array(found, pa.list_(pa.int64())),
                    pa.array(starts, pa.list_(pa.int32())),
                    pa.array(times, pa.list_(pa.int32())),
                ],
                ["doc_id", "h", "n_words", "words_sha256", "anchors", "starts", "times"],
            )

    return seed


class Earliest:
    """The earliest place of window digests that a task has sent on, for the parts that follow.

    At most ``limit`` digests are remembered, first of all those that have come again.  What is forgotten is sent on again
    and settled after the shuffle, so the limit bounds memory and decides nothing.
    """

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.one, self.two = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.starts, self.again = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def later(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which of these windows (sorted by digest) lie behind a remembered place; the others are remembered.

        Windows of one digest have one place.  Of digests that share their first half one is remembered.
        """
        if not len(one):
            return np.zeros(0, bool)
        at = np.searchsorted(self.one, one)
        near = np.minimum(at, max(0, len(self.one) - 1))
        taken = self.one[near] == one if len(self.one) else np.zeros(len(one), bool)
        known = np.flatnonzero(taken & (self.two[near] == two)) if len(self.one) else np.zeros(0, np.int64)
        here = near[known]
        later = (ids[known] > self.ids[here]) | (ids[known] == self.ids[here]) & (start[known] > self.starts[here])
        self.again[here] = True
        self.ids[here[~later]], self.starts[here[~later]] = ids[known[~later]], start[known[~later]]
        behind = np.zeros(len(one), bool)
        behind[known[later]] = True
        fresh = np.flatnonzero(~taken & np.r_[True, one[1:] != one[:-1]])
        self.one, self.two = np.insert(self.one, at[fresh], one[fresh]), np.insert(self.two, at[fresh], two[fresh])
        self.ids, self.starts = np.insert(self.ids, at[fresh], ids[fresh]), np.insert(self.starts, at[fresh], start[fresh])
        self.again = np.insert(self.again, at[fresh], False)
        if len(self.one) > self.limit:
            held = np.flatnonzero(self.again)[: self.limit // 2]
            self.one, self.two, self.ids, self.starts = self.one[held], self.two[held], self.ids[held], self.starts[held]
            self.again = np.zeros(len(held), bool)
        return behind


def _extend(length: int, limit: int = 1 << 20):
    """Rows of windows with a seed: the earliest of each digest in a task; the others as one list per document, ``lost``."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Earliest(limit)
        for part in slices(batches, "text", 4 << 20, 2048):
            one, two, where, start = [], [], [], []
            for i, (text, runs) in enumerate(zip(part.column("text").to_pylist(), part.column("runs").to_pylist())):
                hashes = word_hashes(split_words(text))
                at = np.concatenate([np.arange(r["s0"], r["s1"]) for r in runs])
                a, b = window_keys(hashes, length)
                one.append(a[at])
                two.append(b[at])
                start.append(at)
                where.append(np.full(len(at), i))
            if not one:
                continue
            one, two, where, start = map(np.concatenate, (one, two, where, start))
            ids = part.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()[where]
            order = np.lexsort((start, ids, two, one))
            one, two, where, start, ids = one[order], two[order], where[order], start[order], ids[order]
            first = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
            head = np.maximum.accumulate(np.where(first, np.arange(len(one)), 0))
            # The same place of a repeated row is not an earlier place.
            first |= (ids == ids[head]) & (start == start[head])
            heads = np.flatnonzero(first)
            first[heads[sent.later(one[heads], two[heads], ids[heads], start[heads])]] = False
            later = np.flatnonzero(~first)
            later = later[np.lexsort((start[later], where[later]))]
            losers, begins = np.unique(where[later], return_index=True)
            lost = [x.astype(np.int32) for x in np.split(start[later], begins[1:])] if len(losers) else []
            one, two, where, start = one[first], two[first], where[first], start[first]
            n, m = len(one), len(losers)
            rows = pa.array(np.r_[where, losers].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[one, np.arange(m)]),
                    pa.array(np.r_[two, np.zeros(m, np.int32)], pa.int32(), mask=np.r_[np.zeros(n, bool), np.ones(m, bool)]),
                    part.column("doc_id").take(rows),
                    part.column("variant").take(rows),
                    pa.array(np.r_[start, np.zeros(m, np.int64)].astype(np.int32)),
                    pa.array([*[None] * n, *lost], pa.list_(pa.int32())),
                ],
                ["k1", "k2", "doc_id", "variant", "start", "lost"],
            )

    return extend


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            removed, digests, texts = [], [], []
            for text, marks in zip(part.column("text").to_pylist(), part.column("marks").to_pylist()):
                words = split_words(text)
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(marks, np.int64))
                edge[at] += 1
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, out in zip(words, gone.tolist()) if not out)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("h"), pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts)],
                ["doc_id", "h", "n_removed", "kept_sha256", "kept_text"],
            )

    return cut


def repeats(docs: DataFrame, length: int = 20, k: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(documents, cut)``.

    ``documents``: per row ``doc_id``, ``h`` (hash of the text), ``n_words``, ``words_sha256`` and ``copy`` (whether an earlier
    document has the same words).  ``cut``: for documents that lose a part of their words ``doc_id``, ``h``, ``n_removed``,
    ``kept_sha256``, ``kept_text``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    seeded = rows.select("doc_id", "h", "text").mapInArrow(
        _seed(length, k),
        "doc_id long, h long, n_words long, words_sha256 string, anchors array<long>, starts array<int>, times array<int>",
    )
    seeded = cut_lineage(seeded.withColumn("row", F.monotonically_increasing_id()))
    groups = seeded.groupBy("words_sha256").agg(F.min(F.struct("doc_id")).alias("least"), F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(groups.filter("n > 1").select("words_sha256", "least"))
    told = seeded.join(groups, "words_sha256", "left")
    is_copy = F.col("least").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    documents = told.select("doc_id", "h", "n_words", "words_sha256", is_copy.alias("copy"))
    first = told.filter(~is_copy)

    runs = first.select("row", F.posexplode("anchors").alias("i", "anchor"), "starts", "times").select(
        "anchor",
        "row",
        F.get("starts", "i").alias("s0"),
        F.get("starts", F.col("i") + 1).alias("s1"),
        F.get("times", "i").alias("times"),
    )
    seeds = runs.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor")
    at_seeds = runs.drop("times").join(seeds, "anchor", "left_semi")
    by_row = at_seeds.groupBy("row").agg(F.collect_list(F.struct("s0", "s1")).alias("runs"))
    named = by_row.join(seeded.select("row", "doc_id", "h"), "row").dropDuplicates(["doc_id", "h"])
    named = named.withColumn("variant", F.row_number().over(Window.partitionBy("doc_id").orderBy("h")).cast("int"))
    # Rows that repeat id and text are one document here.
    asked = named.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "variant", "runs")
    asked = cut_lineage(asked)

    def with_text(keyed: DataFrame) -> DataFrame:
        # Both uses shuffle the texts by the same keys, so Spark does it once.
        return rows.join(keyed, rows.doc_id.eqNullSafe(F.col("d")) & (rows.h == F.col("g")))

    windows = with_text(asked).select("doc_id", "variant", "text", "runs").mapInArrow(
        _extend(length), "k1 long, k2 int, doc_id long, variant int, start int, lost array<int>"
    )
    place = Window.partitionBy("k1", "k2").orderBy(F.col("doc_id").asc_nulls_first(), "start")
    placed = windows.withColumn("rank", F.when(F.col("k2").isNotNull(), F.rank().over(place)))
    later = placed.filter("rank > 1 or lost is not null").select(
        "doc_id", "variant", F.when(F.col("lost").isNull(), F.array("start")).otherwise(F.col("lost")).alias("lost")
    )
    marks = later.groupBy("doc_id", "variant").agg(F.flatten(F.collect_list("lost")).alias("marks"))
    marks = marks.select(F.col("doc_id").alias("m"), F.col("variant").alias("v"), "marks")
    keyed = asked.select("d", "g", "variant").join(marks, F.col("d").eqNullSafe(F.col("m")) & (F.col("variant") == F.col("v")))
    hit = with_text(keyed.select("d", "g", "marks"))
    cut = hit.select("doc_id", "h", "text", "marks").mapInArrow(
        _cut(length), "doc_id long, h long, n_removed long, kept_sha256 string, kept_text string"
    )
    return documents, cut


def repeat_report(docs: DataFrame, length: int = 20, k: int = 6) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``.

    Null texts have no words.  Rows that repeat id and text are one document and agree; texts that share an id are ordered by start
    alone.  A null id comes before all others.  An empty table gives no rows; only doc_id and text are read.
    """
    documents, cut = repeats(docs, length, k)
    lost = cut.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "n_removed", "kept_sha256").distinct()
    out = documents.join(lost, documents.doc_id.eqNullSafe(F.col("d")) & (documents.h == F.col("g")), "left")
    whole = F.col("copy") & (F.col("n_words") >= length)
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
    )
