"""The training-data operators against brute-force versions on small tables with odd rows."""

import hashlib
import html
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from panelforge.llm import (
    chat,
    embedding_dedup,
    exact_dedup,
    html_main,
    mixing,
    packing,
    quality,
    simhash,
    substring_dedup,
    url_filter,
)
from tools.check_sql import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "a", "A b", "a b", "é ü 日本 😀", "the " * 3000, "x\x00y \x1c z"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, texts, sources=("s1", "s2", None)):
    rows = [(i, t, "en", sources[i % len(sources)], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd_texts():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [" ".join(draw.choices(vocabulary, k=draw.randint(0, 120))) for _ in range(30)]
    near = [t.replace("w7", "w8", 1) for t in base[:10]]
    return ODD + base + base[:6] + near + [base[0][:150] + " " + base[1][:200], *ODD]


@pytest.fixture(scope="module")
def odd(spark, odd_texts):
    """Odd texts, a row without an id, and a row twice; columns whose names the operators use themselves."""
    docs = documents(spark, odd_texts)
    docs = docs.unionByName(spark.createDataFrame([(None, "w1 w2", "en", "s1", 0), (3, "a", "en", "s1", 0)], DOCS))
    return docs.withColumns({c: F.lit(1) for c in ("_all", "_key", "_row", "_size", "size", "copies", "fp", "_gone", "row", "h")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op1_source_mix", "op4_exact_dedup"])
def test_query_agrees_with_sql(spark, name):
    ok, note = compare(spark, connect(SF), SF, name)
    assert ok, note


def test_registered_once_each():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in entry.queries() if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in entry.queries()


# ---------------------------------------------------------------- exact dedup


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=60), st.integers(3, 9))
def test_filters_keep_keys_and_counts(values, bits):
    keys, counts = np.unique(np.array(values, np.uint64), return_counts=True)
    shard = (keys >> np.uint64(64 - bits)).astype(int)
    for s in set(shard.tolist()):
        mine = shard == s
        got = exact_dedup.decode(exact_dedup.encode(keys[mine], counts[mine], s, bits), bits)
        assert (got[0] == keys[mine]).all() and (got[1] == counts[mine]).all()


def test_exact_groups(odd):
    rows = odd.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(-1 if r.doc_id is None else r.doc_id)
    want = Counter()
    for text, ids in groups.items():
        for n, i in enumerate(sorted(ids, reverse=True)):
            want[(None if i < 0 else i, None if max(ids) < 0 else max(ids), len(ids), n == 0, sha(text))] += 1
    got = exact_dedup.exact_groups(odd)
    assert Counter(map(tuple, got.select("_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter(
        (None if max(i) < 0 else max(i), t) for t, i in groups.items()
    )


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


# ---------------------------------------------------------------- mixing


def shared(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing again and again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 900, "c": 90, None: 5}, {"a": 1, "b": 1, "c": 1000, "d": 0}, {None: 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(shared(sizes))


def test_mix(spark, odd):
    first = mixing.mix_report(odd).collect()
    again = mixing.mix_report(odd.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)
    texts = {r.doc_id: r.text for r in odd.collect()}
    by_source = defaultdict(list)
    for r in first:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.copies <= 3, key(r)
        by_source[r.source].append(r)
    for rows in by_source.values():
        rate = rows[0].target / rows[0].source_size if rows[0].source_size else 0
        assert abs(sum(r.copies for r in rows) - rate * len(rows)) <= 1
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in first)
    assert mixing.mix_report(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


# ---------------------------------------------------------------- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=80), st.integers(1, 4))
def test_best_fit_places_like_a_plain_search(lengths, limit):
    bins = packing.BestFit(16, limit)
    plain: dict[int, int] = {}
    for n in lengths:
        fits = [f for f in plain.values() if f >= n]
        number, offset = bins.place(n)
        if fits:
            assert plain[number] == min(fits)
        else:
            if len(plain) >= limit:
                del plain[min(plain, key=plain.get)]
            plain[number] = 16
        assert offset == 16 - plain[number]
        plain[number] -= n
        if not plain[number]:
            del plain[number]
        assert bins.open == len(plain)
        # Which of equally full sequences closes is free.
        plain = {k: f for f, held in bins.bins.items() for k in held}


def test_packing_round_trip(spark, odd, odd_texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    extra = ["don't I'LL <|endoftext|>x ΑΣ ſ ½²a1", "tab\tb\r\nc d\x85e", "e\u0301 \u0301x", "word " * 9000]
    docs = odd.unionByName(documents(spark, extra).withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    pieces = packing.pack(docs).collect()
    want = Counter(
        (r.doc_id, struct.pack(f"<{len(i) + 1}I", *i, 1))
        for r in docs.select("doc_id", "text").collect()
        for i in [whole.encode(r.text or "", add_special_tokens=False).ids]
    )
    placed = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length <= 4 * 4096 and p.start == 4096 * p.piece
        placed[p.sequence_id].append(p)
    for held in placed.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    short = Counter((p.doc_id, p.ids) for p in pieces if p.doc_id not in (1003,))
    assert all(short[k] == n for k, n in want.items() if len(k[1]) <= 4 * 4096)
    long = b"".join(p.ids for p in sorted((p for p in pieces if p.doc_id == 1003), key=lambda p: p.piece))
    assert want[1003, long] == 1
    assert packing.pack(empty(spark)).count() == 0


# ---------------------------------------------------------------- SimHash


def plain_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    from xxhash import xxh64_intdigest

    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(n, linked):
    label = list(range(n))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(a) for a in range(n)]


def test_near_groups(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    prints = [plain_print(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    label = grouped(len(rows), links)
    order = lambda i: -1 if i is None else i
    smallest = {g: min((i for (i, _), h in zip(rows, label) if h == g), key=order) for g in set(label)}
    want = Counter((i, p, smallest[g]) for (i, _), p, g in zip(rows, prints, label))
    got = Counter((r["_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(odd).collect())
    assert got == want
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == set(smallest.values())
    assert simhash.near_groups(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("tile", [4, 8192])
def test_tiles_lose_no_link(spark, tile):
    draw = random.Random(1)
    centre = draw.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))) for _ in range(60)}
    prints = sorted(prints | {draw.getrandbits(64) for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile=tile).collect()
    at = {p: i for i, p in enumerate(signed)}
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert grouped(len(prints), [(at[r.a], at[r.b]) for r in found]) == grouped(len(prints), links)


# ---------------------------------------------------------------- quality


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_report(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got.score[got.quality == 1].min() > 0.5 and got.score.between(0, 1).all()


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_report(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    none = quality.quality_report(odd, labels.filter("false")).collect()
    assert {r.score for r in none} == {0.5}
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert quality.quality_report(empty(spark), labels).count() == 0


def test_rules_come_from_printed_trees():
    text = "Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     If (feature 1 > 2.0)\n      Predict: 1\n    Else (feature 0 > 0.5)\n     Predict: 0\n"
    assert quality.tree_rules(text, ["a", "b"]) == [
        (("a", "<=", 0.5),),
        (("a", "<=", 0.5), ("b", ">", 2.0)),
        (("a", ">", 0.5),),
    ]


# ---------------------------------------------------------------- urls


def plain_scores(accepted, rejected, texts, order=5, k=2.0):
    counts = [defaultdict(Counter), defaultdict(Counter)]
    for side, urls in zip(counts, (accepted, rejected)):
        for u in urls:
            padded = "\n" * (order - 1) + u
            for i in range(order - 1, len(padded)):
                for n in range(order):
                    side[padded[i - n : i]][padded[i]] += 1

    def p(side, context, char):
        below = p(side, context[1:], char) if context else 1 / 256
        return (side[context][char] + k * below) / (sum(side[context].values()) + k)

    out = []
    for u in texts:
        padded, total = "\n" * (order - 1) + u, 0.0
        for i in range(order - 1, len(padded)):
            for n in range(order - 1, -1, -1):
                context = padded[i - n : i]
                if counts[0][context][padded[i]] or counts[1][context][padded[i]]:
                    total += math.log(p(counts[0], context, padded[i])) - math.log(p(counts[1], context, padded[i]))
                    break
        out.append(total / len(u) if u else None)
    return out


def test_language_models(spark):
    accepted, rejected, asked = ["good.org/a", "good.org/b", "goodé"], ["bad.net/x", "bad.net/yy"], ["good.net", "bad", "", "zzz"]
    training = spark.createDataFrame([(True, u) for u in accepted] + [(False, u) for u in rejected], "accepted boolean, u string")
    tables = url_filter.slot_tables(training.select("accepted", F.explode(url_filter.grams(F.col("u"))).alias("gram")), slot_bits=30)
    got = url_filter.scores(spark.createDataFrame(list(enumerate(asked)), "_key long, _text string"), tables, 30)
    got = {r["_key"]: r["score"] for r in got.collect()}
    assert [got.get(i) for i in range(4)] == pytest.approx(plain_scores(accepted, rejected, asked), nan_ok=True)


def test_unseen_grams_fall_back_at_any_size(spark):
    """Production settings, many known grams: scores stay those of the plain models."""
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(9000)]
    accepted, rejected = [w + ".org" for w in words[:4500]], [w + ".net" for w in words[4500:]]
    asked = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9)) + draw.choice((".org", ".net")) for _ in range(60)] + accepted[:5]
    training = spark.createDataFrame([(True, u) for u in accepted] + [(False, u) for u in rejected], "accepted boolean, u string")
    tables = url_filter.slot_tables(training.select("accepted", F.explode(url_filter.grams(F.col("u"))).alias("gram")))
    urls = spark.createDataFrame(list(enumerate(asked)), "_key long, _text string")
    for hot in (4096, 20):
        got = {r["_key"]: r["score"] for r in url_filter.scores(urls, tables, hot=hot).collect()}
        assert [got[i] for i in range(len(asked))] == pytest.approx(plain_scores(accepted, rejected, asked))


def test_url_rules(spark):
    cases = {
        None: ("", "", None),
        "": ("", "", None),
        "no scheme": ("", "", None),
        "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/"),
        "http://example.net/fr/": ("example.net", "/fr/", "net/"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None),
        "http://x.example.com/de/a": ("x.example.com", "/de/a", "example.com/de/"),
        "https://q.org/fr/": ("q.org", "/fr/", "org/fr/"),
        "http://net": ("net", "", None),
        "a://b://c/d": ("b:", "//c/d", None),
        "http://é.net/" + "y" * 30000: ("é.net", "/" + "y" * 30000, "net/"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] * 2, "page_id long, url string").withColumn("rule", F.lit(1))
    got = url_filter.judge(pages).collect()
    assert len(got) == 2 * len(cases)
    verdicts = {f"{h}{p}": v for h, p, v in url_filter.RULES}
    for r in got:
        assert (r.host, r.path, r.rule) == list(cases.values())[r.page_id]
        assert r.verdict == verdicts.get(r.rule, r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.judge(pages.filter("false")).count() == 0


def test_url_query_is_native(spark):
    out = entry.queries()["op3_url_language_models"](spark, SF)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- html


def test_main_text():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class=has-sidebar>"
        "<header>Site</header><nav><ul><li>Menu</ul></nav><div class='cookie-notice'>We use cookies</div><!-- c -->"
        "<article class=post><header><h1>Head &amp; more</h1><p>By</header><p><b>One<br>two<p>three&nbsp;four &lt;x&gt;</p>"
        "<div class='ad'>Buy</div><form>Mail</form><ul><li>a<li>b</ul><div id=comments><p>Nice!</div><p>last</article>"
        "<aside>Side</aside><footer>&copy;</footer></body>"
    )
    assert html_main.main_text(page) == "\n\n".join(["Head & more", "One two", "three four <x>", "a", "b", "last"])
    assert html_main.main_text("") == "" and html_main.main_text("<p>a<p>b") == "a\n\nb"
    # A quote that never closes ends with its tag.
    assert html_main.main_text("a < b <i>c</i> <a title='x>y") == "a < b c y"


def test_templates_of_a_site_go(spark):
    def page(i):
        return f"<body><div><span>Same on all</span></div><article><p>Text {i}</p><p>shared</p><div>Follow us</div></article></body>"

    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(8)] + [(9, "http://b.org/", page(9)), (10, None, None), (11, "x", "")]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").withColumn("host", F.lit("h"))
    got = {r.page_id: r.text for r in html_main.extract(pages).collect()}
    assert got[3] == "Text 3\n\nshared" and got[9] == "Text 9\n\nshared\n\nFollow us" and got[10] == got[11] == ""
    assert html_main.extract(pages).count() == len(rows) + 1 and html_main.extract(pages.filter("false")).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    """One page under five query strings keeps its text; a block of five different pages still goes."""
    copied = "<body><article><div><p>Only text</p></div></article></body>"
    rows = [(i, f"http://c.org/a?{i}", copied) for i in range(5)]
    rows += [(5 + i, f"http://d.org/{i}", f"<article><p>Text {i}</p><div>Follow us</div></article>") for i in range(5)]
    rows += [(10 + i, f"http://d.org/9?{i}", copied) for i in range(9)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in [*range(5), *range(10, 19)]} == {"Only text"}
    assert [got[5 + i] for i in range(5)] == [f"Text {i}" for i in range(5)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab <>&;\"'é\n", max_size=20), max_size=6))
def test_escaped_paragraphs_come_back(texts):
    page = "<article>" + "".join(f"<p>{html.escape(t)}</p>" for t in texts) + "</article>"
    assert html_main.main_text(page) == "\n\n".join(b for b in (" ".join(t.split()) for t in texts) if b)


# ---------------------------------------------------------------- embeddings


@pytest.mark.parametrize("tile", [8, 2048])
def test_embedding_links(spark, tile):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 16))
    vectors = [centres[i % 40] + draw.normal(scale=0.05, size=16) for i in range(160)] + [centres[0]] * 3
    vectors += [centres[1] * 7]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None, *[1.0] * 15], [1.0, 0.0], [2.0, 0.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("weight", F.lit(1))
    unit = np.array([np.float64(np.float32(v)) for v in vectors])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = grouped(len(vectors), list(zip(*np.nonzero(near))))
    got = {r.vec_id: r for r in embedding_dedup.near_groups(table, tile=tile, first=16).collect()}
    assert len(got) == len(rows)
    for i in range(len(vectors)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i)
    for i in range(1000, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[1007].n_links, got[1007].component_id) == (1, 1006)
    assert embedding_dedup.near_groups(table.filter("false")).count() == 0


def test_embedding_recall(spark):
    table = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    got = embedding_dedup.near_groups(table).toPandas().sort_values("vec_id")
    unit = np.array(table.toPandas().sort_values("vec_id").embedding.to_list(), float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert (got.n_links.values <= want).all() and got.n_links.sum() >= 0.98 * want.sum()


@pytest.mark.parametrize("n", [2000, 6000, 15000])
def test_dense_group_recall(spark, n):
    """A third of all rows around one point, pairwise cosines about 0.96 to 0.99, at production settings."""
    draw = np.random.default_rng(n)
    rest = draw.normal(size=(n - n // 3, 64))
    rest[:300] = rest[300:600] + draw.normal(scale=0.15, size=(300, 64))
    vectors = np.float32(np.vstack([draw.normal(size=64) + draw.normal(scale=0.15, size=(n // 3, 64)), rest]))
    table = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<float>").repartition(8)
    got = embedding_dedup.near_groups(table).toPandas().sort_values("vec_id").n_links.values
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = np.concatenate([(unit[i : i + 1000] @ unit.T >= 0.95).sum(1) - 1 for i in range(0, n, 1000)])
    group, others = slice(0, n // 3), slice(n // 3, n)
    print(n, got[group].sum() / want[group].sum(), got[others].sum() / want[others].sum())
    assert (got <= want).all() and (got[group] == want[group]).all()
    assert got[others].sum() >= 0.97 * want[others].sum()


# ---------------------------------------------------------------- chat


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="\\</s>[INST] a\n", max_size=30))
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    turns = [{"role": text, "text": text, "new": True}] * 2
    assert chat.read_turns(chat.format_window(turns)[0]) == [(text, text)] * 2


def test_chat_windows(spark):
    draw = random.Random(2)
    rows = []
    for conv in range(12):
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * draw.randint(0, 40)
        rows += [(conv, t, r, draw.choice([None, "", "</s>[INST] ok [/INST]", "é😀 " * 3, "word " * draw.randint(1, 150)])) for t, r in enumerate(roles)]
    rows += [(None, 0, "user", "no conversation"), (50, None, None, "no turn"), (50, 1, "assistant", "x"), (50, 1, "assistant", "x")]
    rows += [(51, t, "assistant", f"t{t}") for t in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("x"))
    windows = chat.format_chats(table, budget=256, history_tokens=64)
    said = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        said[r[0]].append((r[2] or "", r[3] or ""))
    read, loss = defaultdict(list), defaultdict(str)
    for w in sorted(windows.collect(), key=lambda w: (str(w.conv_id), w.window)):
        turns = chat.read_turns(w.formatted)
        if w.window and said[w.conv_id][0][0] == "system":
            assert turns[0] == said[w.conv_id][0]
        read[w.conv_id] += turns[w.repeated :]
        loss[w.conv_id] += "".join(chat.unescape(w.formatted[s.start : s.end]) for s in w.loss)
        assert len(turns) - w.repeated <= 1 or sum(len(t.split()) for _, t in turns) <= 256
    assert read == said
    assert loss == {c: "".join(t for r, t in turns if r == "assistant") for c, turns in said.items()}
    for d in chat.digests(windows).collect():
        assert d.n_turns == len(said[d.conv_id]) and d.loss_sha256 == sha(loss[d.conv_id]) and d.loss_chars == len(loss[d.conv_id])
        assert d.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in said[d.conv_id]))
    assert chat.digests(chat.format_chats(table.filter("false"))).count() == 0


# ---------------------------------------------------------------- substring


def plain_repeats(rows, length):
    first, out = {}, {}
    places = sorted({(-1 if i is None else i, n, t or "") for i, t in rows for n in range(len(WORD.findall(t or "")))})
    for i, n, t in places:
        window = tuple(WORD.findall(t)[n : n + length])
        if len(window) == length:
            first.setdefault(window, (i, n))
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = set()
        for n in range(len(words) - length + 1):
            if first[tuple(words[n : n + length])] < (-1 if i is None else i, n):
                gone |= set(range(n, n + length))
        out[i, t] = (len(words), len(gone), sha(" ".join(w for n, w in enumerate(words) if n not in gone)))
    return out


@pytest.mark.parametrize("length,k", [(20, 6), (5, 2)])
def test_repeated_windows(spark, length, k):
    draw = random.Random(length)
    texts = [" ".join(draw.choices("ab cd ef".split() if n % 3 else [f"v{i}" for i in range(60)], k=draw.randint(0, 90))) for n in range(40)]
    texts += [texts[3], texts[6] + " new " + texts[9], None, "", "same " * 400, "Ü same\tsame\n" * 30, texts[12] + "\n"]
    rows = list(enumerate(texts)) + [(None, texts[9]), (3, texts[3]), (6, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))
    want = plain_repeats(rows, length)
    got = Counter(map(tuple, substring_dedup.repeat_report(docs, length, k).collect()))
    assert got == Counter((i, *want[i, t]) for i, t in rows)
    assert substring_dedup.repeat_report(docs.filter("false")).count() == 0


@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1), st.integers(0, 9)), max_size=12), max_size=6), st.integers(2, 40))
def test_earliest_of_a_task(parts, limit):
    """Whatever the limit: a window is dropped only behind an earlier one that went on, so the earliest of each digest goes on."""
    sent, went = substring_dedup.Earliest(limit), {}
    for part in parts:
        least = {}
        for one, two, place in part:
            least[one, two] = min(place, least.get((one, two), place))
        keys = sorted(least)
        columns = [np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int32)]
        places = np.array([least[k] for k in keys], np.int64)
        behind = sent.later(*columns, places // 3, (places % 3).astype(np.int32))
        for key, gone in zip(keys, behind):
            if gone:
                assert min(went[key]) < least[key]
            else:
                went.setdefault(key, []).append(least[key])
        assert len(sent.one) <= limit
    for key in {(one, two) for part in parts for one, two, _ in part}:
        assert min(went[key]) == min(p for part in parts for one, two, p in part if (one, two) == key)


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.toPandas()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append(docs.toPandas())
        if n < 4:
            assert list(seen[-1].columns) == list(seen[0].columns), name
    good, one, variant, mixed, packed = seen[1:]
    report = quality.quality_report(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(good.doc_id) == {r.doc_id for r in report.filter("predicted = 1").collect()}
    assert sorted(one.doc_id) == sorted(good.groupby("text").doc_id.max())
    prints = [plain_print(t) for t in one.text]
    ids = one.doc_id.tolist()
    label = grouped(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert sorted(variant.doc_id) == sorted(min(i for i, h in zip(ids, label) if h == g) for g in set(label))
    taken = {r.doc_id: r.copies for r in mixing.mix_report(spark.createDataFrame(variant)).collect()}
    assert mixed.doc_id.value_counts().to_dict() == {i: n for i, n in taken.items() if n}
    assert packed[packed.piece == 0].doc_id.value_counts().to_dict() == mixed.doc_id.value_counts().to_dict()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
