"""Site templates against a plain count, pages that mark-up alone misjudges, and substring dedup on words made to collide."""

import random
import re
from collections import Counter, defaultdict

import pytest
from test_llm import WORD, plain_repeats

from panelforge.llm import html_main, substring_dedup


def canonical(node):
    """A subtree as plain text, without attributes."""
    out = [node.tag]
    for child in node.children:
        if isinstance(child, html_main.Node):
            out.append(canonical(child))
        elif child.split():
            out.append(" ".join(child.split()))
    return tuple(out)


def plain_templates(rows, min_pages, min_share, per_root):
    """Digest of each canonical subtree, and which of them recur on enough different pages of their host."""
    pages, digests = defaultdict(dict), {}
    for url, page in rows:
        root = html_main.parse(page)
        html_main.hash_subtrees(root)
        found = set()
        for node, inside in html_main.nodes(root):
            if html_main.may_be_template(node, inside):
                assert digests.setdefault(canonical(node), node.digest) == node.digest
                found.add(canonical(node))
        pages[url.split("/")[2]][" ".join(page.split())] = found
    assert len(set(digests.values())) == len(digests)
    out = {}
    for host, found in pages.items():
        counts, n = Counter(x for f in found.values() for x in f), len(found)
        often = {digests[x] for x, c in counts.items() if c >= min_pages and c >= min(min_share * n, per_root * n**0.5)}
        if often:
            out[host] = often
    return out


def site(draw, host, n):
    menus = [f"<div><a href='/{k}'>Menu {k}</a> <span>Go</span></div>" for k in range(3)]
    for i in range(n):
        menu = menus[draw.choice([0, 0, 1, 2])].replace("<a", f"<a class=c{i % 2}")
        yield f"http://{host}/{i}", f"<body>{menu}<article><h1>T {i}</h1><p>{draw.random()}</p><div>Share {i % 4}</div></article><i>end</i></body>"


@pytest.mark.parametrize("settings", [(5, 0.3, 10.0), (2, 0.3, 0.5), (1, 0.0, 0.0)])
def test_templates_equal_a_plain_count(spark, settings):
    draw = random.Random(4)
    rows = [r for k, n in enumerate((40, 9, 3, 1)) for r in site(draw, f"h{k}.org", n)]
    rows += [(f"{u}?again", p) for u, p in rows[:7]]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: set(r.hashes) for r in html_main.site_templates(pages, *settings).collect()}
    assert got == plain_templates(rows, *settings)


def test_templates_alone_remove_an_unclassed_menu(spark):
    rows = [(i, *r) for i, r in enumerate(site(random.Random(1), "a.org", 30))]
    bare = [(i, u, p.replace("<article>", "<div>").replace("</article>", "</div>")) for i, u, p in rows]
    menus = {i: re.search(r"Menu \d", p)[0] for i, _, p in bare}
    often = {m for m, n in Counter(menus.values()).items() if n >= 9}  # 30 % of 30 pages
    assert html_main.main_text(bare[3][2]).startswith("Menu") and often
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    for i, text in got.items():
        assert ("Menu" in text) == (menus[i] not in often) and "end" not in text and f"T {i}" in text


def test_a_block_of_a_part_of_a_large_host_goes(spark):
    """On 27 of 400 pages: far below a third of them, and more than the root allows."""
    rows = [(i, f"http://a.org/{i}", f"<body>{'<div>Part menu</div>' if i < 27 else ''}<p>Text {i}</p></body>") for i in range(400)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Part menu\n\nText 3"  # ten times the root of 400 is 200
    templates = html_main.site_templates(spark.createDataFrame(rows, "page_id long, url string, html string"), per_root=1.0)
    assert len(templates.first().hashes) == 1


@pytest.mark.parametrize(
    "page,text",
    [
        (
            '<main><article>Main.</article><div id="comments"><ol><li><article class="comment-body">Nice post!</article></li></ol></div></main>'
            "<aside><article>Teaser</article></aside><footer><article>Foot</article></footer>",
            "Main.",
        ),
        ('<article><p>A</p><article class="comment byuser">y</article></article>', "A"),
        ('<article><p>A</p><article class="comment">y</article></article>', "A"),
        ('<article class="post comments-open"><p>A</p></article>', "A"),
        ('<article>A<div class="social-science">B</div></article>', "A\n\nB"),
        ('<article>A<section class="related-work">B</section></article>', "A\n\nB"),
        ('<article>A<div class="share-price">B</div></article>', "A\n\nB"),
        ('<article>A<div class="share-buttons top">B</div><div id="comment-list">C</div></article>', "A"),
    ],
)
def test_pages_that_mark_up_alone_misjudges(page, text):
    assert html_main.main_text(page) == text


def test_deep_and_long_pages():
    assert html_main.main_text("<div>" * 30_000 + "deep", frozenset([1])) == "deep"
    assert html_main.main_text("<article>" + "<p>a b</p>" * 50_000, frozenset([1])).count("\n\n") == 49_999


# ------------------------------------------------------------------ substring dedup


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_of_a_structure_that_polynomials_confuse(spark, size):
    one = thue_morse(size)
    other = one.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{i}" for i in range(19))
    rows = [(0, f"{same} {one}"), (1, f"{same} {other}"), (2, f"{same} {one}"), (3, f"{one} {same} {other} x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_repeats(rows, 20)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeat_report(docs).collect()} == {i: want[i, t] for i, t in rows}
    assert want[1, rows[1][1]][1] == 0 and want[2, rows[2][1]][1] == 20


def test_a_text_of_megabytes(spark):
    draw = random.Random(8)
    long = " ".join(draw.choices([f"v{i}" for i in range(50_000)], k=300_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(0, f"a {passage} b"), (1, f"{long} {passage} {long[:1000]}")]
    got = {r.doc_id: r for r in substring_dedup.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    again = len(WORD.findall(long[:1000]))
    assert got[0].n_removed == 0 and 60 + again - 1 <= got[1].n_removed <= 60 + again


# ------------------------------------------------------------------ quality rules


def test_compiled_rules_score_like_rules_read_one_by_one(spark):
    from math import exp

    from conftest import SF

    from panelforge.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert model.rules
    stats = docs.select("doc_id", *(c.cast("double").alias(n) for n, c in quality.statistics(quality.filled("text")).items()))
    got = {r.doc_id: r.score for r in stats.withColumn("score", model.score()).select("doc_id", "score").collect()}
    for row in stats.collect():
        total = model.bias
        for rule, weight in model.rules.items():
            if all(row[name] <= bound if sign == "<=" else row[name] > bound for name, sign, bound in rule):
                total += weight
        assert got[row.doc_id] == pytest.approx(1 / (1 + exp(-total)), abs=1e-12)


# ------------------------------------------------------------------ chat windows


def test_windows_keep_the_budget_and_are_few(spark):
    from panelforge.llm import chat
    from panelforge.llm.packing import TOKENIZER, encoder, tokenizer_path

    draw, budget, reserve = random.Random(6), 512, 96
    rows = []
    for conv in range(30):
        longest = draw.choice([3, 40, 200])
        roles = (["system"] if conv % 2 else []) + ["user", "assistant"] * draw.choice([1, 20, 150])
        rows += [(conv, t, r, draw.choice(["word ", "</s>[INST] ", "é😀 "]) * draw.randint(0, longest)) for t, r in enumerate(roles)]
    rows += [(90, t, ["system", "user"][t > 0], "word " * (700 if t in (0, 5) else 30)) for t in range(12)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    words = encoder(tokenizer_path(TOKENIZER))

    def tokens(text):
        return len(words.encode(text)) // 4

    sizes = defaultdict(list)
    for conv, _, role, text in rows:
        sizes[conv].append((role, tokens("".join(chat.format_turn(role, text)))))
    least = 0
    for turns in sizes.values():
        system, held, room, first = (turns[0][1] if turns[0][0] == "system" else 0), 0, budget, True
        for _, size in turns:
            if first or held + size > room:
                least, room, held, first = least + 1, budget if first else budget - system - reserve, 0, False
            held += size
    windows = chat.format_chats(table, budget=budget, history_tokens=reserve).collect()
    for w in windows:
        turns = chat.read_turns(w.formatted)
        total = tokens(w.formatted)
        assert total == sum(tokens("".join(chat.format_turn(*t))) for t in turns)
        if total > budget:
            system = sizes[w.conv_id][0][1] if sizes[w.conv_id][0][0] == "system" and w.window else 0
            own = [tokens("".join(chat.format_turn(*t))) for t in turns[w.repeated :]]
            assert len(own) == 1 and system + own[0] > budget
    assert least <= len(windows) <= 1.05 * least + 4
