"""Best-fit packing: bounded-space online best fit of token pieces into sequences of a fixed length.

A task keeps at most ``open_bins`` sequences open.  A bitset has bit ``f`` set while some open sequence has ``f`` free
places, so the best fit for a piece of length ``n`` is the lowest set bit from ``n`` on.  When one more sequence would be
open than allowed, the fullest closes.  Tasks pack what they tokenise: nothing is shuffled, memory is the open
sequences' numbers, and a lost task is packed again alike.
"""

from __future__ import annotations

import re
import string
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import filled, slices

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


class BestFit:
    """Places pieces one after the other; ``place`` returns the number of the sequence and the offset in it."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.free = 0  # the bitset
        self.bins: dict[int, list[int]] = {}
        self.open = 0

    def _put(self, free: int, number: int) -> None:
        if free:
            self.bins.setdefault(free, []).append(number)
            self.free |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        held = self.bins[free]
        number = held.pop()
        if not held:
            self.free &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
            free, number = self.capacity, self.next
            self.next += 1
        self._put(free - length, number)
        return number, self.capacity - free


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Aging(dict):
    """A cache of two generations: when the young one is full it becomes the old one, and what is asked for again returns."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of the word-level vocabulary, as little-endian 32-bit bytes, with the same result as the library's own ``encode``.

    The vocabulary never joins across white space, so texts are cut at spaces and line ends and words are remembered.
    Words of Latin letters and signs are split by the tokenizer's own pattern and handed to its merge model piece by piece;
    any other word goes to the library whole.  ``limit`` bounds the entries of a generation of either cache, not the words: at
    150,000 a worker holds some 70 MB of them, whatever it has read.
    """

    PLAIN = re.compile("[!-~¡-ɏ]+")
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the vocabulary's own pattern

    def __init__(self, path: str, limit: int = 150_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(self.SPLIT)
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        self.pieces = _Aging(self._piece, limit)
        self.words = _Aging(self._word, limit)

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if not self.PLAIN.fullmatch(word) or "<|" in word:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        if low.isalpha():
            return self.pieces[low]
        letters = low.rstrip(string.punctuation)
        if letters.isalpha():
            return self.pieces[letters] + self.pieces[low[len(letters) :]]
        return b"".join(map(self.pieces.__getitem__, self.split.findall(low)))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; it is kept for the tasks that follow in the same worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def _pack(tokenizer: str, capacity: int, open_bins: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path(tokenizer))
        context = TaskContext.get()
        bins = BestFit(capacity, open_bins, (context.partitionId() if context else 0) << 33)
        end = struct.pack("<I", END_ID)
        for part in slices(batches, "text"):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = words.encode(text) + end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    number, offset = bins.place(length)
                    rows.append((doc, piece, start, length, ids[4 * start : 4 * (start + length)], number, offset))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return pack


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = 4096, open_bins: int = 512) -> DataFrame:
    """One row per piece: its ids (little-endian 32-bit), its sequence and its offset there.

    A document is its ids and a closing id 1; only longer ones are cut, every piece but the last at full length.
    Null and empty texts are the closing id alone.  Rows that repeat a doc_id are packed each for itself.
    An empty table gives no rows; columns beside doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, capacity, open_bins), PIECES)
