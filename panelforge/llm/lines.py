"""Line dedup with two Bloom filters: lines that look repeated are confirmed by their text, all others stay where they are.

A line's key is the line without the six ASCII white-space characters at both ends, A-Z lower-cased.  One filter holds the
hashes of keys seen at least once, the other of keys seen at least twice.  Every map task folds its keys into partial pairs;
pairs merge bit by bit: ``once`` is the union, ``twice`` the union of both ``twice`` and of what both ``once`` have in common.  So no
repeat is ever missed, whatever the order of merging.  The filters are cut into shards by the leading bits of the hash, and
their number grows with the number of different keys, so the share of false suspects is the same at every size.

Only the merged second filter goes back to the lines, folded to half its size as often as it stays sparse.  Lines found in it are
suspects: they alone are shuffled, grouped by the key itself, and the first document of every key that two documents hold is
chosen.  A line that a third of all documents hold is one row per task there.

The folded filter is broadcast while its size, known from its shape, is at most ``broadcast_bytes``; beyond that, lines
meet the shards of the filter in a shuffle join.  Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import filled, slices
from panelforge.session import cut_lineage

_WHITE = b" \t\n\x0b\x0c\r"
#: Bits set per key, bits of a shard (as a power of two), filter bits per different key, keys folded at a time.
PROBES, SHARD_BITS, BITS_PER_KEY, FOLD = 4, 22, 16, 1 << 20
#: Folding stops before more than this share of the second filter's bits is set: 2.6 % false suspects at most.
FULLEST = 0.4


def line_key(line: bytes) -> bytes:
    """The key of a line in UTF-8; ``bytes.lower`` changes A-Z only."""
    return line.strip(_WHITE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least


def text_keys(text: bytes, least: int) -> set[bytes]:
    """The different keys of a text that have at least ``least`` code points."""
    return {key for key in map(line_key, text.split(b"\n")) if _long_enough(key, least)}


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _prints(least: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [_hash(k) for t in part.column("text").to_pylist() for k in text_keys(t.encode(), least)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], ["h"])

    return prints


def bit_places(hashes: np.ndarray, bits: int = SHARD_BITS) -> np.ndarray:
    """Places of the ``PROBES`` bits of each hash within its shard, all in one array."""
    mask = np.uint64((1 << bits) - 1)
    step = (hashes >> np.uint64(bits)) & mask | np.uint64(1)
    return np.concatenate([(hashes + np.uint64(i) * step) & mask for i in range(PROBES)])


def _encoded(hashes: np.ndarray) -> bytes:
    """The set bits as compressed gaps, or as a compressed bitmap where they are dense."""
    at = np.unique(bit_places(hashes)).astype(np.uint32)
    if len(at) < 1 << (SHARD_BITS - 5):
        return b"g" + zstandard.compress(np.diff(at, prepend=np.uint32(0)).tobytes(), 1)
    bitmap = np.zeros(1 << SHARD_BITS, bool)
    bitmap[at] = True
    return b"b" + zstandard.compress(np.packbits(bitmap).tobytes(), 1)


def _decoded(part: bytes) -> np.ndarray:
    body = zstandard.decompress(part[1:])
    if part[:1] == b"g":
        return np.cumsum(np.frombuffer(body, np.uint32), dtype=np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8)))


PAIR = pa.schema([("shard", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def partial_pairs(hashes: np.ndarray, shard_bits: int) -> pa.RecordBatch:
    """The filter pairs, one row per shard, of hashes that stand for one document's key each."""
    keys, counts = np.unique(hashes, return_counts=True)
    shard = keys >> np.uint64(64 - shard_bits)
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
    rows = [
        (int(shard[a]), _encoded(keys[a:b]), _encoded(keys[a:b][counts[a:b] > 1])) for a, b in zip(edges[:-1], edges[1:])
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PAIR)], schema=PAIR)


def _build(shard_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= FOLD:
                yield partial_pairs(np.concatenate(held), shard_bits)
                held, n = [], 0
        if n:
            yield partial_pairs(np.concatenate(held), shard_bits)

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: its partial pairs come in batches, and two bitmaps are all that is held."""
    once, twice = np.zeros(1 << SHARD_BITS, bool), np.zeros(1 << SHARD_BITS, bool)
    shard = None
    for batch in batches:
        for row in batch.to_pylist():
            shard, at = row["shard"], _decoded(row["once"])
            twice[_decoded(row["twice"])] = True
            twice[at[once[at]]] = True
            once[at] = True
    if shard is not None:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard]),
                pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary()),
                pa.array([int(np.count_nonzero(twice))]),
            ],
            ["shard", "bits", "filled"],
        )


def _folded(bits: int):
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = np.frombuffer(row["bits"], np.uint8).reshape(-1, 1 << (bits - 3))
                words = np.bitwise_or.reduce(parts, axis=0).view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]]), pa.array([words.tolist()], pa.list_(pa.int64()))], ["shard", "words"]
                )

    return folded


def twice_filter(prints: DataFrame) -> tuple[DataFrame, int, int]:
    """``(shards, shard_bits, bits)``: the second filter as rows of ``shard`` and ``words``, and its shape.

    ``prints`` has one long column with the hash of each different key of each document.
    """
    keys = prints.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    shard_bits = max(1, math.ceil(math.log2(max(1, keys) * BITS_PER_KEY)) - SHARD_BITS)
    pairs = prints.mapInArrow(_build(shard_bits), "shard long, once binary, twice binary")
    merged = cut_lineage(pairs.groupBy("shard").applyInArrow(_merge, "shard long, bits binary, filled long"))
    filled_bits = merged.agg(F.sum("filled")).first()[0] or 0
    share = max(filled_bits, 1) / (1 << (shard_bits + SHARD_BITS))
    bits = max(6, SHARD_BITS - max(0, math.floor(math.log2(FULLEST / share))))
    return merged.mapInArrow(_folded(bits), "shard long, words array<long>"), shard_bits, bits


def _in_filter(bits: int) -> Column:
    mask = (1 << SHARD_BITS) - 1
    step = F.shiftrightunsigned("h", SHARD_BITS).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(1))
    found = F.lit(True)
    for i in range(PROBES):
        at = (F.col("h").bitwiseAND(F.lit(mask)) + step * i).bitwiseAND(F.lit((1 << bits) - 1))
        word = F.get("words", F.shiftright(at, 6).cast("int"))
        found &= F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1
    return found


def _keyed(least: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, hashes, keys = [], [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                own = text_keys(text.encode(), least)
                ids += [doc] * len(own)
                hashes += map(_hash, own)
                keys += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(keys, pa.binary())],
                ["doc_id", "h", "key"],
            )

    return keyed


def suspected_lines(rows: DataFrame, least: int, broadcast_bytes: int) -> DataFrame:
    """``doc_id``, ``h``, ``key`` (UTF-8) of the lines that the second filter holds, each key once a document."""
    prints = cut_lineage(rows.select("text").mapInArrow(_prints(least), "h long"))
    shards, shard_bits, bits = twice_filter(prints)
    small = (1 << (shard_bits + bits)) // 8 <= broadcast_bytes
    lines = rows.mapInArrow(_keyed(least), "doc_id long, h long, key binary")
    lines = lines.withColumn("shard", F.shiftrightunsigned("h", 64 - shard_bits))
    met = lines.join(F.broadcast(shards) if small else shards, "shard")
    return cut_lineage(met.filter(_in_filter(bits)).select("doc_id", "h", "key"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts, counts, dropped = [], [], []
        for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist()):
            lines = text.split("\n") if gone else None
            counts.append(len(lines) if gone else text.count("\n") + 1)
            if gone:
                keys = set(gone)
                lines = [line for line in lines if line_key(line.encode()) not in keys]
                text = "\n".join(lines)
            texts.append(text)
            dropped.append(counts[-1] - len(lines) if gone else 0)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(texts), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
            ["doc_id", "text", "n_lines", "n_dropped"],
        )


def drop_repeated_lines(docs: DataFrame, least: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``text`` without its repeated lines, ``n_lines`` (before), ``n_dropped``.

    Keys of at least ``least`` code points that at least two documents hold lose all their lines but in the document of the
    smallest id.  Null texts are empty, one empty line.  Rows that share a doc_id are one document here: a line that only they
    hold stays in all of them.  A null id is a document of its own, before all others.  A text with all lines dropped is
    empty.  An empty table gives no rows; only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text"))
    suspects = suspected_lines(rows, least, broadcast_bytes)
    keys = suspects.groupBy("h", "key").agg(
        F.max(F.col("doc_id").isNull()).alias("nameless"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    )
    # A table of its own, so that the join below can be split where one line is in a third of all documents.
    repeats = cut_lineage(
        keys.filter((F.col("first") < F.col("last")) | F.col("nameless") & F.col("first").isNotNull()).drop("last")
    )
    later = suspects.join(repeats, ["h", "key"]).filter(F.col("nameless") | (F.col("doc_id") > F.col("first")))
    gone = later.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    return rows.join(gone, "doc_id", "left").mapInArrow(_without, "doc_id long, text string, n_lines long, n_dropped long")
