"""The queries of this folder: each applies its operator with production settings to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import (
    chat,
    divergence,
    embedding_dedup,
    exact_dedup,
    html_main,
    lines,
    mixing,
    packing,
    prefix_trie,
    quality,
    simhash,
    substring_dedup,
    url_filter,
)
from panelforge.llm.text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per_source AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM per_source),
capped AS (SELECT *, CAST(3 AS DOUBLE) * source_size AS top FROM weighed),
leveled AS (
  SELECT *, (SUM(source_size) OVER () - coalesce(SUM(top) OVER r, 0)) / CAST(SUM(w) OVER s AS DOUBLE) AS level FROM capped
  WINDOW r AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         s AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (SELECT source, source_size, least(top, MAX(level) OVER () * w) AS target FROM leveled),
rated AS (
  SELECT sized.*, source_size, target,
         CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END * 1099511627776) AS HUGEINT) AS e,
         CAST(('0x' || substr(md5('mix' || coalesce(sized.source, '')), 1, 8)) AS BIGINT) * CAST(256 AS HUGEINT) AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
summed AS (
  SELECT *, u + coalesce(SUM(e) OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM rated)
SELECT doc_id, size, source_size, target,
       CAST((low + e) // 1099511627776 - low // 1099511627776 AS BIGINT) * size AS taken FROM summed
"""


@query("op1_source_mix", MIX_SQL)
def _(spark, sf_dir):
    out = mixing.mix_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op4_exact_dedup",
    """
SELECT doc_id, MAX(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       COUNT(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = MAX(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
""",
)
def _(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


@query("op8_best_fit_packing")
def _(spark, sf_dir):
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


@query("op6_simhash_near_dedup")
def _(spark, sf_dir):
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op7_quality_rules")
def _(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality_report(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query("op9_embedding_near_dedup")
def _(spark, sf_dir):
    return embedding_dedup.near_groups(table(spark, sf_dir, "embeddings"))


@query("op10_html_main_text")
def _(spark, sf_dir):
    out = html_main.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_url_language_models")
def _(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


CONTROL_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op2_chat_windows")
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(CONTROL_CHAT, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(control)))


@query("op5_substring_dedup")
def _(spark, sf_dir):
    return substring_dedup.repeat_report(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT lang, source, row, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING COUNT(DISTINCT row) >= 10),
c AS (SELECT lang, source, term, CAST(COUNT(*) AS HUGEINT) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, CAST(COUNT(*) AS HUGEINT) AS terms FROM kept GROUP BY 1),
whole AS (SELECT lang, term, SUM(n) AS n FROM c GROUP BY 1, 2),
q AS (
  SELECT lang, term, 1 + 1000000000 * (n + 2) // (SUM(n) OVER (PARTITION BY lang) + 2 * terms) AS q FROM whole JOIN v USING (lang)),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0) + 2) // (SUM(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + 2 * terms) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
telling AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (FROM every_pair UNION ALL FROM telling))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def _(spark, sf_dir):
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


TRIE_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i AS x, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL
  SELECT byte, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(x ORDER BY byte) AS t FROM steps WHERE k = 8),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce([4294967295] || list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)),
                         lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS INTEGER) + 1])), 4294967295) % 6 AS h
  FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM (SELECT DISTINCT conv_id FROM turns)), crc),
built AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
said AS (
  SELECT conv_id, row_number() OVER w AS depth, len(text) AS chars,
         list(sha256(len(role) || ':' || role || text)) OVER w AS path
  FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
paths AS (
  SELECT conv_id, 0 AS depth, 0 AS chars, CAST([] AS VARCHAR[]) AS path FROM convs
  UNION ALL SELECT conv_id, depth, chars, path FROM said),
ended AS (SELECT *, depth = MAX(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (
  SELECT path, MIN(conv_id) AS conv_id, ANY_VALUE(depth) AS depth, COUNT(*) AS n_convs, ANY_VALUE(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM ended GROUP BY path),
children AS (SELECT path[1:depth - 1] AS path, COUNT(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
grown AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
below AS (
  SELECT x.path, COUNT(*) FILTER (y.n_children = 0) AS n_leaves, SUM((y.n_convs - 1) * y.chars) AS saved
  FROM (SELECT path, n_convs, chars, n_children, unnest(range(depth + 1)) AS d FROM grown) y
  JOIN grown x ON x.path = y.path[1:d] GROUP BY 1)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, g.n_convs, g.n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, g.ends_sha256
FROM grown g JOIN below USING (path) LEFT JOIN grown up ON g.depth > 0 AND up.path = g.path[1:g.depth - 1]
"""


@query("op12_prefix_trie", TRIE_SQL)
def _(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


LINES_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
split AS (SELECT doc_id, row, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
repeats AS (
  SELECT key, MIN(doc_id) AS first FROM keyed WHERE len(key) >= 10 GROUP BY key HAVING COUNT(DISTINCT doc_id) > 1),
judged AS (
  SELECT keyed.*, coalesce(keyed.doc_id > first, false) AS gone FROM keyed LEFT JOIN repeats USING (key))
SELECT ANY_VALUE(doc_id) AS doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row
"""


@query("op13_line_dedup", LINES_SQL)
def _(spark, sf_dir):
    out = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
