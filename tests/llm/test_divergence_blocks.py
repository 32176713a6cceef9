"""Terms of the divergence audit are added up a block at a time, over few exchanges."""

import contextlib
import io
import random
import re
from collections import Counter

import pyarrow as pa

from panelforge.llm import divergence


def test_blocks_count_occurrences_and_documents_of_every_prefix(monkeypatch):
    monkeypatch.setattr(divergence, "_HELD", 60)
    monkeypatch.setattr(divergence, "_PIECE", 400)
    monkeypatch.setattr(divergence, "_ROWS", 7)
    draw = random.Random(4)
    stems = ["a", "ab", "abcd", "abcde", "ABCDEF", "über", "übers", "x" * 40, "x" * 41, "x" * 70, "日本語"]
    docs = [(draw.choice(["en", ""]), draw.choice(["s", "t"]), draw.choice([" ", "1", "\n"]).join(draw.choices(stems, k=draw.choice([0, 1, 9, 30])))) for _ in range(60)]
    table = pa.table({c: pa.array(v) for c, v in zip(("lang", "source", "text"), zip(*docs))})
    out = [row for batch in divergence._occurrences(iter(table.to_batches(max_chunksize=11))) for row in batch.to_pylist()]
    terms = [(lang, source, re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())) for lang, source, text in docs]
    plain = Counter()
    for row in out:
        plain[row["lang"], row["source"], row["term"]] += 0 if row["marked"] else row["n"]
    assert +plain == Counter((lang, source, t) for lang, source, found in terms for t in found)
    for level in range(6):
        size, got = divergence.FIRST_LEVEL << level, Counter()
        for row in out:
            if row["marked"] and row["mark"] <= level:
                got[row["lang"], row["term"][:size]] += row["n"]
        assert got == Counter(key for lang, _, found in terms for key in {(lang, t[:size]) for t in found})


def test_occurrences_are_dealt_out_once(spark, monkeypatch):
    plans, write = [], divergence.cut_lineage

    def kept_plan(df):
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            df.explain()
        plans.append(said.getvalue())
        return write(df)

    monkeypatch.setattr(divergence, "cut_lineage", kept_plan)
    rows = [(i, f"the word w{i % 3}", "en", f"s{i % 4}") for i in range(60)]
    divergence.term_tables(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    listed = next(p for p in plans if "collect_list" in p)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", listed)
    assert len(dealt) == 2 and not any("source" in keys for keys in dealt)
