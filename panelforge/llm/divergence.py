"""Source divergence audit: how far the sources of a language differ in the words they use, and by which words.

Which terms count is found by iceberg prefix refinement.  Terms are taken as UTF-8 bytes.  Level by level their prefixes of 4, 8, 16, ...
bytes are counted by documents; a prefix in too few documents is discarded with all terms below it, and only what is left
is extended to the next level, until all that is left are whole terms.  The number of documents of a prefix is never less
than that of any longer one, so nothing is lost, and the long tail of rare terms is gone after a few short prefixes.

A document counts once for a prefix though several of its terms share it.  To count without document ids, the terms of
a document are sorted, and each carries the first level at which its prefix differs from the term before: it stands for its document
at this level and all deeper ones.  Discarding takes whole prefixes, so the term before is either still there or had another prefix
anyway, and the mark stays right.  Documents can therefore be added up per task by (language, term, mark), without sources; occurrences
by (language, source, term) are added up beside them in the same pass and joined with the kept terms once.  Both are counted in bulk: the
terms of a block of documents are numbered, sorted once, and sorted numbers are counted.

All counts are whole numbers and all arithmetic is exact; rates use decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.text import filled, slices
from panelforge.session import cut_lineage

#: On UTF-8: A-Z lower-cased, every other ASCII byte but letters a space.
_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
FIRST_LEVEL = 4
#: Bytes of text that are read at once; terms, repeats included, that a task adds up at once, as far as whole documents go; rows of a batch.
_PIECE, _HELD, _ROWS = 1 << 20, 1 << 23, 1 << 16
#: Bytes of a term that are compared in bulk, and the level whose prefix they are.
_HEAD, _FULL = FIRST_LEVEL << 2, 2
#: The level at which surviving terms are added up over all tasks: prefixes of 4 bytes have been cut, 8 are next.
_JOINED_AT = 1
#: Sources per tile of the pair sums, terms per task of them.
TILE, TERMS = 256, 1 << 14

#: Rows with ``marked`` count documents by language, term and mark; the others occurrences by language, source and term.
OCCURRENCES = pa.schema(
    [
        ("marked", pa.bool_()),
        ("lang", pa.string()),
        ("source", pa.string()),
        ("term", pa.binary()),
        ("mark", pa.int32()),
        ("n", pa.int64()),
    ]
)


def read_terms(text: bytes, plain: Counter) -> list[bytes]:
    """The different terms of a text in order; ``plain`` counts them all.  Texts are read in pieces, so only different terms are held."""
    lowered, found, at = text.translate(_LETTERS), set(), 0
    while at < len(lowered):
        gap = lowered.find(b" ", min(len(lowered), at + _PIECE))
        end = gap if gap >= 0 else len(lowered)
        terms = lowered[at:end].split()
        plain.update(terms)
        found.update(terms)
        at = max(end, at + 1)
    return sorted(found)


def term_marks(terms: list[bytes], starts: list[int]) -> np.ndarray:
    """The mark of each term: the first level whose prefix differs from the term before; 0 where a document starts."""
    if not terms:
        return np.zeros(0, np.int64)
    # No term holds the byte 0, so filling up with it keeps them apart.
    heads = np.array(terms, dtype=f"S{_HEAD}").view(np.uint8).reshape(-1, _HEAD)
    differs = heads[1:] != heads[:-1]
    shared = np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), _HEAD)]
    marks = np.searchsorted([FIRST_LEVEL << i for i in range(_FULL + 1)], shared, side="right")
    marks[starts] = 0
    shared[starts] = 0
    for i in np.flatnonzero(shared == _HEAD).tolist():
        size, mark = _HEAD, _FULL
        while terms[i - 1][:size] == terms[i][:size]:
            size, mark = 2 * size, mark + 1
        marks[i] = mark
    return marks


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and how often each occurs."""
    keys.sort()
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.r_[at, len(keys)])


class _Block:
    """Documents of a task whose terms are added up at once, as numbers: a term is its place among the terms of the block."""

    def __init__(self) -> None:
        self.places: defaultdict[bytes, int] = defaultdict()
        self.places.default_factory = self.places.__len__
        self.ids: list[np.ndarray] = []
        self.groups: list[tuple[str, str]] = []
        self.held = 0

    def add(self, lang: str, source: str, terms: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.places.__getitem__, terms), np.int32, len(terms)))
        self.groups.append((lang, source))
        self.held += len(terms) + 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        terms = sorted(self.places)
        if not terms:
            return
        n = len(terms)
        rank = np.empty(n, np.int64)
        rank[np.fromiter(map(self.places.__getitem__, terms), np.int64, n)] = np.arange(n)
        names, sizes = pa.array(terms, pa.binary()), [len(ids) for ids in self.ids]
        ranks = rank[np.concatenate(self.ids)]
        groups, langs = sorted(set(self.groups)), sorted({lang for lang, _ in self.groups})
        group_of = np.array(list(map({g: i for i, g in enumerate(groups)}.__getitem__, self.groups)))
        lang_of = np.array([langs.index(lang) for lang, _ in groups])

        keys, counts = _counted(np.repeat(group_of, sizes) * n + ranks)
        yield from _rows(False, pa.array([g[0] for g in groups]).take(pa.array(keys // n)), pa.array([g[1] for g in groups]).take(pa.array(keys // n)), names.take(pa.array(keys % n)), None, counts)
        inside, _ = _counted(np.repeat(np.arange(len(sizes)), sizes) * n + ranks)
        doc, ranks = inside // n, inside % n
        # Prefixes of a level are numbered along the sorted terms; a term's mark is the number of levels at which it has that of the one before.
        marks, first = np.zeros(len(ranks), np.int64), np.r_[True, doc[1:] != doc[:-1]]
        steps = term_marks(terms, [0])
        for level in range(int(steps.max())):
            prefix = np.cumsum(steps <= level)[ranks]
            marks[1:] += prefix[1:] == prefix[:-1]
        marks[first] = 0
        deepest = int(marks.max()) + 1
        keys, counts = _counted((lang_of[group_of[doc]] * n + ranks) * deepest + marks)
        found, marks = keys // deepest, keys % deepest
        yield from _rows(True, pa.array(langs).take(pa.array(found // n)), None, names.take(pa.array(found % n)), marks, counts)


def _rows(marked: bool, lang: pa.Array, source: pa.Array | None, term: pa.Array, mark: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    columns = zip([pa.repeat(marked, len(n)), lang, source, term, mark, n], OCCURRENCES)
    arrays = [pa.nulls(len(n), f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in columns]
    whole = pa.RecordBatch.from_arrays(arrays, schema=OCCURRENCES)
    for at in range(0, len(n), _ROWS):
        yield whole.slice(at, _ROWS)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for part in slices(batches, "text"):
        for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
            raw = text.encode()
            if len(raw) <= _PIECE:
                block.add(lang, source, raw.translate(_LETTERS).split())
            else:  # by itself: only its different terms are held
                plain: Counter = Counter()
                terms = read_terms(raw, plain)
                n = len(terms)
                names = pa.array(terms, pa.binary())
                yield from _rows(False, pa.repeat(lang, n), pa.repeat(source, n), names, None, np.array([plain[t] for t in terms], np.int64))
                yield from _rows(True, pa.repeat(lang, n), None, names, term_marks(terms, [0][:n]), np.ones(n, np.int64))
            if block.held >= _HELD:
                yield from block.rows()
                block = _Block()
    yield from block.rows()


def kept_terms(occurrences: DataFrame, least: int) -> DataFrame:
    """``lang`` and ``term`` of the terms in at least ``least`` documents of their language, by prefix refinement.

    ``occurrences`` holds documents by ``lang``, ``term`` and ``mark``.  The first levels read them as the tasks left them; what has survived
    by then is added up once for the levels that follow.
    """
    kept, size, level, alive = None, FIRST_LEVEL, 0, occurrences
    while True:
        rows = alive
        if kept is not None:
            parents = kept.select(F.col("lang").alias("_lang"), "prefix")
            if level > _JOINED_AT:  # distinct prefixes, looked up without sorting the terms
                parents = parents.hint("shuffle_hash")
            under = (F.col("lang") == F.col("_lang")) & (F.substring("term", 1, size // 2) == F.col("prefix"))
            rows = alive.join(parents, under, "left_semi")
        if level == _JOINED_AT:
            rows = alive = cut_lineage(rows.groupBy("lang", "term", "mark").agg(F.sum("docs").alias("docs")))
        counted = rows.groupBy("lang", F.substring("term", 1, size).alias("prefix")).agg(
            F.sum(F.when(F.col("mark") <= level, F.col("docs")).otherwise(0)).alias("docs"),
            F.max(F.length("term")).alias("longest"),
        )
        kept = cut_lineage(counted.filter(F.col("docs") >= least))
        longest = kept.agg(F.max("longest")).first()[0] or 0
        if longest < size:
            return kept.select("lang", F.col("prefix").alias("term"))
        size, level = 2 * size, level + 1


def rate(count: str, total: str = "total", terms: str = "terms") -> str:
    """SQL of ``1 + floor(10**9 * (count + 2) / (total + 2 * terms))`` as long; null without terms.

    Longs hold the product for counts below nine thousand million, decimals beyond; both are exact.
    """
    small = f"(({count} + 2L) * 1000000000L) div ({total} + 2 * {terms})"
    large = f"((cast({count} as decimal(20,0)) + 2) * 1000000000) div (cast({total} as decimal(20,0)) + 2 * {terms})"
    return f"case when {terms} = 0 then null when {count} < 9000000000L then 1 + {small} else 1 + {large} end"


def difference(p: str, q: str) -> Column:
    """``floor((p - q)**2 / (p + q))`` of rates, which are at most 10**9 + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def term_tables(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(terms, groups)``, both written.

    ``terms``: one row per kept term with ``lang``, ``term``, ``n`` (occurrences) and ``x``, those by source.  ``groups``: every ``lang`` and
    ``source`` with ``at`` (its number within the language), ``total`` and ``lang_total`` (occurrences of kept terms), ``terms`` (kept in the
    language), ``sources``.
    """
    read = docs.select(filled("lang").alias("lang"), filled("source").alias("source"), filled("text").alias("text"))
    schema = "marked boolean, lang string, source string, term binary, mark int, n long"
    stored = cut_lineage(read.mapInArrow(_occurrences, schema))
    kept = kept_terms(stored.filter("marked").select("lang", "term", "mark", F.col("n").alias("docs")), least)
    # Dealt out once, by term: the kept terms are looked up there, and sums by source and lists by term need no other exchange.
    found = stored.filter("not marked").select("lang", "term", "source", "n").join(kept.hint("shuffle_hash"), ["lang", "term"], "left_semi")
    listed = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n")).groupBy("lang", "term")
    terms = cut_lineage(listed.agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("x")))
    totals = terms.select("lang", F.inline("x")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"])
    numbered = groups.withColumns(
        {
            "at": (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"),
            "sources": F.count(F.lit(1)).over(Window.partitionBy("lang")),
        }
    )
    return terms, cut_lineage(numbered)


def term_vectors(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Per kept term, written: ``lang``, ``term``, ``q`` (the language's rate), ``x`` (place and rate of its sources), ``lots``, ``tiles``."""
    by_lang = groups.groupBy("lang", "lang_total", "terms", "sources").agg(
        F.map_from_entries(F.collect_list(F.struct("source", "at"))).alias("places"),
        F.transform(F.sort_array(F.collect_list(F.struct("at", "total"))), lambda e: e["total"]).alias("totals"),
    )
    placed = "transform(x, e -> named_struct('at', places[e.source], 'n', e.n))"
    rated = f"transform({placed}, e -> named_struct('at', e.at, 'p', {rate('e.n', 'get(totals, cast(e.at as int))')}))"
    return cut_lineage(
        terms.join(by_lang, "lang").select(
            "lang", "term", F.expr(rate("n", "lang_total")).alias("q"), F.expr(rated).alias("x"), *map(F.expr, (_LOTS, _TILES))
        )
    )


_LOTS, _TILES = f"terms div {TERMS} + 1 as lots", f"(sources - 1) div {TILE} + 1 as tiles"


def telling_terms(vectors: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """The ``most`` terms of each group that it uses more often than its language does, by ``difference``."""
    above = vectors.select("lang", "term", "q", F.inline("x")).filter("p > q")
    named = above.join(groups.select("lang", "at", "source"), ["lang", "at"])
    valued = named.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), difference("p", "q").alias("value")
    )
    return ranked(valued).filter(F.col("rank") <= most)


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


_PAIRS = "lang string, a long, b long, value long, seen long"


def _pair_sums(terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of ``difference`` over the given terms for all sources of tile ``i`` against those of tile ``j``.

    ``terms`` holds, per term, places and rates of the sources that have it; ``sources`` the rate of an absent term
    for every source.  Terms that no source of both tiles has are not here; ``seen`` tells how many were.
    """
    if not sources.num_rows:
        return pa.table({n: [] for n in ("lang", "a", "b", "value", "seen")}).cast(_PAIRS_ARROW)
    i, j = sources.column("i")[0].as_py(), sources.column("j")[0].as_py()
    at = sources.column("at").to_numpy()
    lacking = dict(zip(at.tolist(), sources.column("lacking").to_numpy().tolist()))
    rows, cols = sorted(x for x in lacking if x // TILE == i), sorted(x for x in lacking if x // TILE == j)
    sums = np.zeros((len(rows), len(cols)), np.int64)
    for batch in terms.select(["at", "p"]).to_batches(max_chunksize=2048):
        places, rates = batch.column("at"), batch.column("p")
        term = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
        where, value = places.flatten().to_numpy(), rates.flatten().to_numpy()

        def dense(tile: int, members: list[int]) -> np.ndarray:
            out = np.tile(np.array([lacking[m] for m in members], np.int64), (batch.num_rows, 1))
            own = where // TILE == tile
            out[term[own], where[own] % TILE] = value[own]
            return out

        left, right = dense(i, rows), dense(j, cols)
        for k in range(len(rows)):
            p = left[:, k : k + 1]
            sums[k] += ((p - right) ** 2 // (p + right)).sum(axis=0)
    a, b = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
    value = sums.ravel()
    if i != j:
        a, b, value = np.r_[a, b], np.r_[b, a], np.r_[value, value]
    n = len(a)
    return pa.table([pa.array([sources.column("lang")[0].as_py()] * n, pa.string()), *map(pa.array, (a, b, value)), pa.array([terms.num_rows] * n, pa.int64())], schema=_PAIRS_ARROW)


_PAIRS_ARROW = pa.schema(
    [("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64()), ("seen", pa.int64())]
)


def source_pairs(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Every group against every other source of its language: the sum of ``difference`` over all kept terms.

    Sources are dealt into tiles and terms into lots, so a task holds one lot of terms for two tiles.  A term that no source of
    both tiles has adds the same amount each time; such terms are counted, not sent.
    """
    known = groups.selectExpr("lang", "source", "at", "terms", f"{rate('0L')} as lacking", _LOTS, _TILES)
    pairs = F.expr("explode(flatten(transform(sequence(0, tiles - 1), i -> transform(sequence(i, tiles - 1), j -> named_struct('i', i, 'j', j)))))")
    sent = vectors.select("lang", F.expr("pmod(xxhash64(term), lots)").alias("lot"), "x", pairs.alias("t"))
    sent = sent.withColumn("x", F.expr(f"filter(x, e -> e.at div {TILE} in (t.i, t.j))")).filter("size(x) > 0")
    sent = sent.select("lang", "lot", "t.i", "t.j", F.col("x.at").alias("at"), F.col("x.p").alias("p"))
    members = known.select("lang", "at", "lacking", "lots", pairs.alias("t")).filter(f"at div {TILE} in (t.i, t.j)")
    members = members.select("lang", "at", F.coalesce("lacking", F.lit(1)).alias("lacking"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "t.i", "t.j")
    keys = ["lang", "i", "j", "lot"]
    sums = sent.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(_pair_sums, _PAIRS)
    sums = sums.filter("a != b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = known.select("lang", F.col("at").alias("a"), "source", F.col("lacking").alias("p"), "terms")
    other = known.select("lang", F.col("at").alias("b"), F.col("source").alias("item"), F.col("lacking").alias("q"))
    named = sums.join(one, ["lang", "a"]).join(other, ["lang", "b"])
    rest = (F.col("terms") - F.col("seen")) * difference("p", "q")
    value = F.when(F.col("terms") > 0, F.col("value") + rest).otherwise(0).cast("long")
    return ranked(named.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))


def audit_sources(docs: DataFrame, least: int = 10, most: int = 10) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: part ``pair`` for other sources, ``term`` for telling terms.

    Every row of ``docs`` is a document, repeated ones too.  Null text, language and source are empty strings; an empty
    one is a language or source like any other.  A language without kept terms gives its pairs the value 0.  Equal values
    are ranked by item in order of code point.  An empty table gives no rows; other columns are not read.
    """
    terms, groups = term_tables(docs, least)
    vectors = term_vectors(terms, groups)
    return source_pairs(vectors, groups).unionByName(telling_terms(vectors, groups, most))
