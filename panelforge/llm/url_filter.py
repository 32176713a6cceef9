"""Url filter: rules first, then the ratio of two character language models.

The models are smoothed variable-order Markov models of accepted and of rejected urls, learned from the urls that rules
decide.  The probability of a character is interpolated from order 0 up to the longest context: with ``n(c)`` the
characters seen after context ``c``, ``P(x|c) = (n(cx) + k P(x|c')) / (n(c) + k)``, where ``c'`` is one character
shorter.  A url's score is the mean over its characters of the difference of log-probabilities, each taken at the longest
context for which the training urls have the character.  The threshold is calibrated on training urls that the models
have not seen.

All of it is DataFrame operations.  N-grams are counted and smoothed exactly in Spark.  Scoring looks up each distinct gram of
the urls once in the tables of the models, then joins the characters of the urls with what was found, gram by gram; nothing is
folded, so a gram never seen in training falls back to a shorter context whatever the number of urls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.text import lower_ascii
from panelforge.llm.urls import host, path
from panelforge.session import cut_lineage

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 5


def rule_name(rules: tuple[tuple[str, str, str], ...], host_column: Column, path_column: Column) -> Column:
    """The longest fitting rule, like ``net/``; null where none fits."""
    out = F.lit(None).cast("string")
    for name, start, _ in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_column == name) | F.endswith(host_column, F.lit("." + name))) & F.startswith(path_column, F.lit(start))
        out = F.when(fits, F.lit(name + start)).otherwise(out)
    return out


def rule_verdict(rules: tuple[tuple[str, str, str], ...], rule: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, start, verdict in rules:
        out = F.when(rule == name + start, F.lit(verdict)).otherwise(out)
    return out


def characters(url: Column) -> Column:
    """What the models read: the url after its scheme, A-Z lower-cased, digits all alike; null as empty."""
    text = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_replace(lower_ascii(text), "[0-9]", "0")


def grams(text: Column, order: int = ORDER) -> Column:
    """For every character the string of it and its ``order - 1`` predecessors; line feeds stand before the first."""
    letters = F.concat(F.array_repeat(F.lit("\n"), order - 1), F.filter(F.split(text, ""), lambda c: c != ""))
    count = F.size(letters) - (order - 1)
    # The array index is by character, so long urls cost no more per character than short ones.
    made = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(letters, i, order), "")
    )
    return F.when(count > 0, made).otherwise(F.array().cast("array<string>"))


def _models(training: DataFrame, order: int, smoothing: float) -> list[DataFrame]:
    """Per order from 1 on: ``gram``, its ``count`` and ``gain``, the difference of its log-probabilities."""
    longest = training.groupBy("gram").agg(
        F.sum(F.col("accepted").cast("long")).alias("yes"), F.sum((~F.col("accepted")).cast("long")).alias("no")
    )
    counted = [cut_lineage(longest)]
    for _ in range(order - 1):
        shorter = counted[-1].groupBy(F.expr("substring(gram, 2)").alias("gram"))
        counted.append(shorter.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    counted.reverse()
    out: list[DataFrame] = []
    below = None
    for size, grams_of in enumerate(counted, 1):
        # One window row per character seen after the context.
        context = Window.partitionBy(F.substring("gram", 1, size - 1))
        rows = grams_of.withColumns({"all_yes": F.sum("yes").over(context), "all_no": F.sum("no").over(context)})
        if below is None:
            rows = rows.withColumns({"p": F.lit(1.0 / 256), "q": F.lit(1.0 / 256)})
        else:
            rows = rows.join(below, F.expr("substring(gram, 2)") == F.col("shorter"))
        rows = rows.select(
            "gram",
            (F.col("yes") + F.col("no")).alias("count"),
            ((F.col("yes") + smoothing * F.col("p")) / (F.col("all_yes") + smoothing)).alias("p"),
            ((F.col("no") + smoothing * F.col("q")) / (F.col("all_no") + smoothing)).alias("q"),
        )
        rows = cut_lineage(rows)
        below = rows.select(F.col("gram").alias("shorter"), "p", "q")
        out.append(rows.select("gram", "count", (F.log("p") - F.log("q")).alias("gain")))
    return out


def slot_tables(training: DataFrame, order: int = ORDER, smoothing: float = 2.0, slot_bits: int | None = None) -> list[DataFrame]:
    """Per order ``gram`` and ``gain``, every gram of the training urls by itself; ``slot_bits`` stays for callers and folds nothing."""
    return [m.select("gram", "gain") for m in _models(training, order, smoothing)]


def gains(asked: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``gram`` and ``gain`` of the distinct grams of ``asked``, each at the longest context the tables know; unknown ones are left out.

    An order is asked only for what no longer one knows, so the few short grams meet few rows.
    """
    order = len(tables)
    known, rest = [], asked.select("gram").distinct()
    for size in range(order, 0, -1):
        table = tables[size - 1].select(F.col("gram").alias("short"), "gain")
        met = cut_lineage(rest.join(table, F.expr(f"right(gram, {size})") == F.col("short"), "left").select("gram", "gain"))
        known.append(met.filter("gain is not null"))
        rest = met.filter("gain is null").select("gram")
    return reduce(DataFrame.unionByName, known)


def scores(urls: DataFrame, tables: list[DataFrame], slot_bits: int | None = None, hot: int = 4096) -> DataFrame:
    """``_key`` and ``score`` per row of ``urls`` (``_key``, ``_text``); texts without characters have no row.

    At most ``hot`` grams, each more than one in ``hot`` of all characters, are looked up in a broadcast table, so no task of the
    join that finds the others has much of one gram.  ``slot_bits`` stays for callers and folds nothing.
    """
    found = urls.select("_key", F.explode(grams(F.col("_text"), len(tables))).alias("gram"))
    counted = cut_lineage(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    known = gains(counted, tables).join(counted, "gram").select("gram", F.col("gain"), (F.col("n") * hot > total).alias("often"))
    known = cut_lineage(known)
    # A gram without a gain adds nothing but counts as a character.
    common = counted.filter(F.col("n") * hot > total).select("gram").join(known.select("gram", "gain"), "gram", "left")
    common = F.broadcast(common.select(F.col("gram").alias("hot_gram"), F.coalesce("gain", F.lit(0.0)).alias("hot_gain")))
    looked = found.join(common, F.col("gram") == F.col("hot_gram"), "left")
    rare = looked.filter("hot_gram is null").select("_key", "gram").join(known.filter("not often").select("gram", "gain"), "gram", "left")
    gain = looked.filter("hot_gram is not null").select("_key", F.col("hot_gain").alias("gain")).unionByName(
        rare.select("_key", F.coalesce("gain", F.lit(0.0)).alias("gain"))
    )
    return gain.groupBy("_key").agg(F.avg("gain").alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score that best separates accepted from rejected: the least sum of both error rates, on a grid of 0.01.

    Scores are counted per grid cell, 2,001 cells between -10 and 10.  Without both classes it is 0.
    """
    cell = F.greatest(F.least(F.floor(F.col("score") * 100), F.lit(1000)), F.lit(-1000)).cast("int")
    cells = scored.groupBy(cell.alias("cell")).agg(
        F.sum(F.col("accepted").cast("long")).alias("yes"), F.sum((~F.col("accepted")).cast("long")).alias("no")
    )
    rising = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    missed = F.coalesce(F.sum("yes").over(rising), F.lit(0)) / F.sum("yes").over(whole)
    passed = 1 - F.coalesce(F.sum("no").over(rising), F.lit(0)) / F.sum("no").over(whole)
    both = cells.withColumns({"a": F.sum("yes").over(whole), "r": F.sum("no").over(whole)}).filter("a > 0 and r > 0")
    best = both.select("cell", (missed + passed).alias("errors"))
    first = best.orderBy("errors", F.abs("cell"), "cell").limit(1).collect()
    return first[0]["cell"] / 100 if first else 0.0


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, slot_bits: int | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` of every row.

    The rule's verdict, else allow if the score reaches the threshold.  A url without characters, null included, has
    score 0; ``slot_bits`` folds nothing.  Rows that repeat a page_id or url are judged alike, each for itself; an empty table gives none.
    """
    named = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    named = named.withColumn("rule", rule_name(rules, F.col("host"), F.col("path")))
    known = named.withColumns(
        {"by_rule": rule_verdict(rules, F.col("rule")), "_text": characters(F.col("url")), "_key": F.monotonically_increasing_id()}
    ).drop("url")
    known = cut_lineage(known)
    training = known.filter("by_rule is not null").withColumn("accepted", F.col("by_rule") == "allow")
    seen = F.pmod(F.xxhash64("_text"), F.lit(4)) != 0
    tables = slot_tables(training.filter(seen).select("accepted", F.explode(grams(F.col("_text"))).alias("gram")))
    scored = cut_lineage(scores(known.select("_key", "_text"), tables))
    limit = threshold(training.filter(~seen).join(scored, "_key"))
    out = known.join(scored, "_key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_models = F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_models).alias("verdict"), "score")
