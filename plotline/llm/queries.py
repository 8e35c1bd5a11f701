"""Registered queries of the training-data operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotline.llm import chat, collocations, decontaminate, fingerprints, jaccard, language, licenses, line_dedup, merkle, merkle_sql, packing, quality, redirects, toxicity
from plotline.llm.sampling import held_out
from plotline.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None, native: bool = False) -> Callable[[Query], Query]:
    """Registers a query; a ``native`` one runs no Python on the executors and needs no sources there."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if not native:
                ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line,
         translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)
), keys AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT doc_id, i, line, coalesce(first_doc <> doc_id, false) AS gone FROM lines LEFT JOIN keys USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

WORD_LIST = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORD_LIST} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
), docs AS (SELECT doc_id, {WORD_LIST} AS w FROM documents),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM docs, (SELECT DISTINCT n FROM windows) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)
), met AS (SELECT doc_id, i, spots.n, item_id FROM spots JOIN windows USING (n, phrase)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM met), unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""

OP6_SQL = """
WITH t AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
s AS (
  SELECT t.conv_id, perspective, turn, speaker, text, coalesce(speaker = perspective, false) AS loss,
         CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user:' || coalesce(speaker, 'unknown') || '|>' || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, length(head) + length(text) + 8 AS size, CAST(coalesce(sum(length(head) + length(text) + 8) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment_start
  FROM s
)
SELECT conv_id, perspective, turn, speaker, head || text || '<|end|>' || chr(10) AS segment, segment_start, loss,
       CASE WHEN loss THEN segment_start + length(head) END AS loss_start, CASE WHEN loss THEN segment_start + size END AS loss_end
FROM o
"""


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in redirects.RULES)
_ATTRIBUTE = lambda tag, name: f"""replace(regexp_replace(regexp_extract({tag}, '(?is)[\\s"''/]{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), '^["'']|["'']$', '', 'g'), '&amp;', '&')"""
_DOTS = lambda p: f"""CASE WHEN regexp_matches({p}, '(^|/)\\.\\.?(/|$)') THEN coalesce(nullif(array_to_string(list_reduce(
  list_prepend([''], list_transform(string_split({p}, '/')[2:], lambda x: [x])),
  lambda a, x: CASE WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN x[1] = '.' THEN a ELSE a || x END)
  || CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN [''] ELSE [] END, '/'), ''), '/') ELSE {p} END"""  # noqa: E731

OP12_SQL = f"""
WITH RECURSIVE parts AS (
  SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), p AS (SELECT *, host || path || regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS address FROM parts),
rules (verdict, r_host, r_path) AS (VALUES {_RULES}),
tags AS (
  SELECT host, path, address, unnest(regexp_extract_all(regexp_replace(html,
    '(?is)<!--.*?(?:-->|$)|<script[\\s/>].*?(?:</script[\\s/>]|$)|<style[\\s/>].*?(?:</style[\\s/>]|$)|<textarea[\\s/>].*?(?:</textarea[\\s/>]|$)|<title[\\s/>].*?(?:</title[\\s/>]|$)', ' ', 'g'),
    '(?is)<(?:link|meta)[\\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag
  FROM p WHERE regexp_matches(html, '(?i)canonical|http-equiv') AND host <> ''
), targets AS (
  SELECT *, trim(regexp_replace(CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches({_ATTRIBUTE("tag", "rel")}, '(?i)(^|\\s)canonical(\\s|$)') THEN {_ATTRIBUTE("tag", "href")}
    WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches({_ATTRIBUTE("tag", "http-equiv")}, '(?i)^\\s*refresh\\s*$')
      THEN regexp_extract({_ATTRIBUTE("tag", "content")}, '(?is)^\\s*[\\d.]+\\s*[;,]\\s*(?:url\\s*=\\s*)?[''"]?([^''"]*)', 1) END, '[\\t\\r\\n]', '', 'g')) AS t
  FROM tags
), full_urls AS (
  SELECT address, CASE
    WHEN regexp_matches(t, '(?i)^https?://') THEN substr(t, strpos(t, '://') + 3)
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR t[1] = '#' THEN NULL
    WHEN t[1:2] = '//' THEN t[3:] WHEN t[1] = '?' THEN host || path || t
    WHEN t[1] = '/' THEN host || {_DOTS("regexp_extract(t, '^[^?#]*')")} || regexp_extract(t, '^[^?#]*(.*)', 1)
    ELSE host || {_DOTS("(regexp_extract(path, '(?s)^(.*)/', 1) || '/' || regexp_extract(t, '^[^?#]*'))")} || regexp_extract(t, '^[^?#]*(.*)', 1) END AS u
  FROM targets WHERE t <> ''
), edges AS (
  SELECT address AS a, translate(regexp_extract(u, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') || regexp_extract(u, '^[^/?#]*([^#]*)', 1) AS b
  FROM full_urls WHERE regexp_extract(u, '^([^/?#]*)', 1) <> ''
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS v, a AS w FROM both_ways UNION SELECT v, b FROM reach JOIN both_ways ON w = a),
places AS (SELECT DISTINCT host, path FROM p UNION SELECT regexp_extract(w, '^([^/?#]*)', 1), regexp_extract(w, '^[^/?#]*([^?#]*)', 1) FROM reach),
fits AS (
  SELECT host, path, r_host || r_path AS rule, verdict FROM places JOIN rules
  ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC, verdict) = 1
), shut AS (
  SELECT v AS address FROM reach JOIN fits ON host = regexp_extract(w, '^([^/?#]*)', 1) AND path = regexp_extract(w, '^[^/?#]*([^?#]*)', 1)
  GROUP BY v HAVING bool_and(verdict = 'block')
)
SELECT page_id, p.host, p.path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN shut.address IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN fits ON fits.host = p.host AND fits.path = p.path LEFT JOIN shut ON shut.address = p.address
"""

_PIECES = f"string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')"

OP13_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest({_PIECES}) AS piece FROM documents)
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS a
  FROM pieces, unnest(range(1, 6)) AS s(size), unnest(range(1, len(w) - size + 2)) AS t(i) GROUP BY ALL HAVING count(*) >= 100
), p AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, array_to_string(w[:-2], ' ') AS phrase, a FROM p WHERE size > 2
    UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM p WHERE size > 2) GROUP BY ALL
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM p LEFT JOIN longer USING (lang, phrase), unnest(range(1, size)) AS t(k) WHERE size > 1 AND (most IS NULL OR 100 * most < 100 * a)
), scored AS (
  SELECT lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts c JOIN f l USING (lang) JOIN f r USING (lang) JOIN totals USING (lang) WHERE l.phrase = head AND r.phrase = rest
  QUALIFY row_number() OVER (PARTITION BY lang, c.phrase ORDER BY score, k) = 1
)
SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
FROM scored QUALIFY rank <= 2000
"""


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_line_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


@query("op10_decontamination", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_ngram_jaccard")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op3_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return language.predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(~held_out(F.col("doc_id"), 3, 1)), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs.where(~held_out(F.col("doc_id"), 4, 2)), table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op6_chat_rotation", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


@query("op11_merkle_manifest", merkle_sql.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 3, 0))


@query("op12_url_filters", OP12_SQL, native=True)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirects.judge(table(spark, sf_dir, "pages"), redirects.rule_table(spark))


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))
