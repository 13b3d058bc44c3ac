"""Registered queries of the numbered operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm import decontam, html_text, langid, packing, pii, quality, robust_rules, simhash, spelling, sum_squares, token_bits, trie, warc
from demandlens.llm.common import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op9_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_bits.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op6_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0
), ns AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, ns WHERE len(w) >= n
), m AS (SELECT doc_id, s, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
p AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS pos FROM m),
h AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op7_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), d AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha1(h), CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS parts FROM p
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 15) & 31 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS INTEGER) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

#: CRC32 in DuckDB: the table of its 256 steps as a list, and the sum of a text's bytes by it.
CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(0, 256) t(i))
)"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC32 of a SQL text beside the table crc."""
    octets = f"list_transform(range(0, strlen({text})), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295)"


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = trie.rebuilt(written(trie.placed(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "placed"))
    return trie.trie(turns, conversations).drop("k1", "k2")


ORACLES["op11_prefix_trie"] = f"""
WITH {CRC_TABLE}, p AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT c, count(*) AS n FROM p GROUP BY c), s AS (
  SELECT c, CAST(c AS VARCHAR) AS name, c - c % 5 AS base FROM n
), h AS (SELECT c, base, {crc32_sql("name")} % 9 AS h FROM s, crc),
own AS (SELECT h.*, least(h.h, coalesce(b.n, 0)) AS taken FROM h LEFT JOIN n b ON b.c = h.base),
turns AS (
  SELECT own.c, place, r, t FROM own JOIN p ON p.c = base WHERE place <= h
  UNION ALL SELECT own.c, place - h + taken, r, t FROM own JOIN p ON p.c = own.c WHERE place > h
), seqs AS (SELECT n.c, coalesce(q.w, []) AS w FROM n LEFT JOIN (SELECT c, list([r, t] ORDER BY place) AS w FROM turns GROUP BY c) q USING (c)),
m AS (SELECT c, len(w) AS l, d, w, sha256(CAST(to_json(w[1:d]) AS VARCHAR)) AS k FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM seqs)),
node AS (
  SELECT k, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, max(CASE WHEN d > 0 THEN strlen(w[d][2]) ELSE 0 END) AS bytes,
         any_value(CASE WHEN d > 0 THEN sha256(CAST(to_json(w[1:d - 1]) AS VARCHAR)) END) AS up, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = l), '') AS ends
  FROM m GROUP BY k
), kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT node.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM node LEFT JOIN kids USING (k)),
above AS (SELECT DISTINCT k, sha256(CAST(to_json(w[1:j]) AS VARCHAR)) AS top FROM (SELECT k, w, unnest(range(0, d + 1)) AS j FROM m)),
sums AS (SELECT top AS k, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above JOIN v USING (k) GROUP BY top)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN sums USING (k) LEFT JOIN node o ON o.k = v.up
"""


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), drop_every=199)


ORACLES["op12_spelling"] = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT id, run, count(*) AS n, id || ':' || run AS name FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents
  ) GROUP BY id, run
), marked AS (SELECT run, n, {crc32_sql("name")} AS h FROM runs, crc), cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM marked
), w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS x FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.x = b.x AND a.i = b.i AND a.word <> b.word
  UNION SELECT gaps.word, w.word FROM gaps JOIN w ON gaps.x = w.word UNION SELECT w.word, gaps.word FROM gaps JOIN w ON gaps.x = w.word
), best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY o.n DESC, other) AS other, max(o.n) AS top FROM near JOIN w o ON o.word = near.other GROUP BY near.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN other END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS here FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.here WHERE f.form IS NOT NULL),
root AS (SELECT way.word, here AS root FROM way JOIN f ON f.word = way.here WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
"""


@query
def op13_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_squares.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
