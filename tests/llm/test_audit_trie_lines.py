"""Divergence audit, prefix trie and line dedup against brute-force versions on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelforge.llm import divergence, lines, prefix_trie
from tools.check_sql import compare, connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, shard long, term string"
WHITE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 1, "k", 2, "t") for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_prefix_trie", "op13_line_dedup"])
def test_query_equals_its_sql(spark, name):
    ok, message = compare(spark, connect(SF), SF, name)
    assert ok, message


# ------------------------------------------------------------------ lines


def plain_lines(rows):
    def key(line):
        return line.strip(WHITE).translate(LOWER)

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add((doc is not None, doc or 0))
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [
            line for line in all_lines
            if len(holders[key(line)]) < 2 or min(holders[key(line)]) == (doc is not None, doc or 0)
        ]
        out.append((doc, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


LINE = ["A repeated line", "a repeated line ", "\ta REPEATED line\r", "ÄÖÜ are ten here", "äöü are ten here", "ninechars", "日本語日本語日本語日", "", " ", "x" * 200]


@pytest.fixture(scope="module")
def line_rows():
    draw = random.Random(5)
    texts = ["\n".join(draw.choices([*LINE, *(f"line number {i}" for i in range(60))], k=draw.randint(1, 12))) for _ in range(40)]
    odd = [(None, "A repeated line\nnobody else has this"), (None, "a repeated line"), (7, texts[3]), (7, texts[3]), (8, None), (9, "")]
    long = (500, "\n".join(f"line number {i % 70}" for i in range(40_000)))
    return [*((i * 3, t) for i, t in enumerate(texts)), *odd, long, (501, "y" * 3_000_000), (502, "y" * 3_000_000)]


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_lines_equal_brute_force(spark, line_rows, broadcast_bytes):
    docs = table(spark, [(d, t, "en", "s") for d, t in line_rows]).repartition(5)
    got = lines.drop_repeated_lines(docs, broadcast_bytes=broadcast_bytes)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lines(line_rows)


def test_lines_of_an_empty_table(spark):
    assert lines.drop_repeated_lines(table(spark, [])).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), min_size=1, max_size=6), st.integers(0, 5))
def test_filters_merge_without_losing_a_repeat(parts, copied):
    parts = [np.array(p + parts[0][:copied], np.uint64) for p in parts]
    by_shard = defaultdict(list)
    for batch in (lines.partial_pairs(p, 1) for p in parts):
        for i in range(batch.num_rows):
            by_shard[batch.column(0)[i].as_py()].append(batch.slice(i, 1))
    twice = {s: next(iter(lines._merge(iter(b)))) for s, b in by_shard.items()}
    counts = Counter(int(h) for p in parts for h in p)
    for h in (h for h, n in counts.items() if n > 1):
        bits = np.unpackbits(np.frombuffer(twice[h >> 63].column(1)[0].as_py(), np.uint8), bitorder="little")
        assert bits[lines.bit_places(np.array([h], np.uint64))].all()


def test_few_lines_are_suspected_wrongly(spark):
    prints = spark.range(300_000).selectExpr("xxhash64(id) as h")
    shards, shard_bits, bits = lines.twice_filter(prints.unionByName(spark.range(500).selectExpr("xxhash64(id) as h")))
    met = prints.withColumn("shard", F.shiftrightunsigned("h", 64 - shard_bits)).join(shards, "shard")
    found = met.filter(lines._in_filter(bits)).count()
    assert 500 <= found <= 500 + 0.04 * 300_000
    assert bits < lines.SHARD_BITS  # folded, since few keys are repeated


# ------------------------------------------------------------------ divergence


def plain_audit(rows, least, most):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        found = term.findall((text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(found))
        n[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in docs[lang].items() if c >= least]

        def rates(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        q = rates(sum((n[lang, s] for s in sources), Counter()))
        p = {s: rates(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            words = [(-f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", words, most)):
                ordered = sorted(found, key=lambda x: (x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(ordered)]
    return sorted(out)


def audit_rows():
    draw = random.Random(9)
    stems = ["a", "ab", "abc", "abcd", "abcde", "über", "übers", "日本", "日本語", "Ünder", "the", "THE", "then", "x" * 40, "x" * 41]
    rows = []
    for i in range(160):
        words = draw.choices(stems + [f"w{chr(97 + j)}{chr(97 + i % 26)}" for j in range(20)], k=draw.randint(0, 30))
        rows.append((i, draw.choice([" ", "-", "1", "\n"]).join(words), draw.choice(["en", "de", None]), draw.choice(["a", "b", "é", None, "Z"])))
    odd = [(None, None, None, None), (3, "", "fr", "only"), (3, "", "fr", "other"), (4, "solo", "xx", "one"), (4, "solo", "xx", "one")]
    return rows + odd + [(900, "the abc " * 400_000, "en", "a"), (901, "z" * 2_500_000, "en", "b")]


@pytest.mark.parametrize("least", [10, 2, 500])
def test_audit_equals_brute_force(spark, least):
    rows = audit_rows()
    got = divergence.audit_sources(table(spark, rows).repartition(4), least=least)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, least, 10)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit_sources(table(spark, [])).collect() == []


def test_audit_with_more_sources_than_a_tile(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choices("abcdefgh", k=6)), "en", f"s{i % 300}") for i in range(900)]
    got = divergence.audit_sources(table(spark, rows), least=10)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, 10, 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("aü", min_size=1, max_size=60), max_size=12), max_size=8))
def test_marks_count_documents_of_every_prefix(docs):
    sums, plain, terms, starts = Counter(), Counter(), [], []
    for words in docs:
        starts.append(len(terms))
        terms += divergence.read_terms(" ".join(words).encode(), plain)
    marks = divergence.term_marks(terms, [s for s in starts if s < len(terms)])
    sums.update(t + bytes([m]) for t, m in zip(terms, marks.tolist()))
    assert plain == Counter(w.encode() for words in docs for w in words)
    for level in range(5):
        size, want, got = divergence.FIRST_LEVEL << level, Counter(), Counter()
        for words in docs:
            want.update({w.encode()[:size] for w in words})
        for key, both in sums.items():
            got[key[:-1][:size]] += both * (key[-1] <= level)
        assert +got == want


def test_terms_are_the_same_in_pieces():
    text = ("Ab ü1" * 300_000 + "q" * 1_500_000 + " end").encode()
    plain, want = Counter(), Counter(re.findall(rb"[a-z\x80-\xff]+", text.lower()))
    assert divergence.read_terms(text, plain) == sorted(want) and plain == want


# ------------------------------------------------------------------ prefix trie


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def signed(h):
    n = int(h, 16)
    return n - (1 << 64) if n >> 63 else n


def plain_trie(rows):
    stored = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            d = digest(role, text)
            stored[conv].append(((turn is not None, turn or 0), role, signed(d[:16]), signed(d[16:32]), text))
    stored = {c: [(r[1], r[4]) for r in sorted(t)] for c, t in stored.items()}
    built = {}
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(stored.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node],
            sum(not children[m] for m in below),
            sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m),
            sha(",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))),
        ))
    return sorted(out, key=str)


def chat_rows(convs=260, hot=0):
    draw = random.Random(11)
    say = ["hi", "hi", "yes", "", None, "no 😀", "a\nb"]
    rows = []
    for c in [*range(0, convs), 1000, 1001, 2005, -3, -100]:
        rows += [(c, t, draw.choice(["user", "assistant"]) if draw.random() < 0.2 else "user", draw.choice(say)) for t in range(draw.randint(1, 8))]
    odd = [(None, 0, "user", "lost"), (12, None, "system", "first"), (12, None, None, "second"), (13, 0, "user", "again"), (13, 0, "user", "again")]
    deep = [(c, t, "user", f"turn {t % 7}") for c in (3000, 3050, 3077) for t in range(hot)]
    return rows + odd + deep


CHATS = "conv_id long, turn long, role string, text string, depth long, f1 long, pos long"


@pytest.mark.parametrize("hot", [0, 300])
def test_trie_equals_brute_force(spark, hot):
    rows = chat_rows(60 if hot else 260, hot)
    turns = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], CHATS).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not hot).lower())
    try:
        got = prefix_trie.prefix_trie(turns).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CHATS)).collect() == []


def test_fingerprints_that_clash_end_the_job(spark):
    paths = spark.createDataFrame(
        [(1, 1, 5, 5, 0, 0, 7, 7, 3, True), (2, 1, 5, 5, 0, 0, 8, 7, 3, True)], prefix_trie._PATHS
    )
    with pytest.raises(Exception, match="share a fingerprint"):
        prefix_trie.verified_nodes(paths).collect()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1)), max_size=20), st.integers(0, 20))
def test_fingerprints_compose(turns, cut):
    def run(part):
        value = 0
        for t in part:
            value = (value * prefix_trie.BASE + prefix_trie.turn_value(*t)) % prefix_trie.PRIME
        return value

    whole = run(turns)
    tail = turns[cut:]
    assert (run(turns[:cut]) * pow(prefix_trie.BASE, len(tail), prefix_trie.PRIME) + run(tail)) % prefix_trie.PRIME == whole
    assert prefix_trie.joined(*prefix_trie.halves(whole)) == whole


def test_entry_registers_the_queries():
    assert {"op11_source_divergence", "op12_prefix_trie", "op13_line_dedup"} <= set(entry.queries()) & set(entry.oracle_sql())
