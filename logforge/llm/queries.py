"""The ten queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, divergence, langid, mincut, pii, sentencepiece_bpe, url_lists
from .jaccard_join import jaccard_join
from .mixing import mix
from .toxicity import toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.judge(_documents(spark, sf_dir))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(_documents(spark, sf_dir)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_documents(spark, sf_dir))


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    judged = url_lists.judge(url_lists.example_captures(pages), url_lists.example_list(pages))
    return judged.withColumns({c: judged[c].cast("string") for c in ("fetched", "listed_since")})


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir))


def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = chroma.sonify(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return chroma.search(chroma.fingerprint(media)).withColumnRenamed("id", "vec_id")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(_pages(spark, sf_dir))


QUERIES = {
    "op1_divergence": op1_divergence,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_url_lists": op7_url_lists,
    "op8_source_mixing": op8_source_mixing,
    "op9_chroma": op9_chroma,
    "op10_main_text": op10_main_text,
}

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_FIXED = "(" + ", ".join(f"'{code}'" for code in divergence.COMMON_WORDS) + ")"
_LISTS = "CASE a.lang " + " ".join(f"WHEN '{code}' THEN {_LIST(words)}" for code, words in divergence.COMMON_WORDS.items()) + " ELSE list_resize(coalesce(learned, []), 16, '') END"
_TERM = "(CASE WHEN p > 0 THEN p * log2(p * 2.0 / (p + q)) ELSE 0.0 END + CASE WHEN q > 0 THEN q * log2(q * 2.0 / (p + q)) ELSE 0.0 END) / 2.0"

ORACLE_SQL = {
    "op1_divergence": rf"""
WITH a AS (
  SELECT doc_id, lang, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w FROM documents),
o AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS rank FROM (SELECT lang, unnest(w) AS w FROM a WHERE lang IS NULL OR lang NOT IN {_FIXED}) GROUP BY lang, w),
u AS (SELECT lang AS of, list(w ORDER BY rank) AS learned FROM o WHERE rank <= 16 GROUP BY lang),
s AS (
  SELECT *, regexp_replace(x, '\p{{Ll}}+', '', 'g') AS x1, regexp_replace(x, '[\p{{Ll}}\x20\x09-\x0D]+', '', 'g') AS x2, regexp_replace(x, '[\p{{Ll}}\p{{Lu}}\x20\x09-\x0D]+', '', 'g') AS x3,
    regexp_replace(x, '[\p{{Ll}}\p{{Lu}}\p{{Nd}}\x20\x09-\x0D]+', '', 'g') AS x4, regexp_replace(x, '[\p{{Ll}}\p{{Lu}}\p{{Nd}}\x20\x09-\x0D.,;:?''"()\-]+', '', 'g') AS x5,
    {_LISTS} AS words FROM a LEFT JOIN u ON a.lang IS NOT DISTINCT FROM u.of),
f AS (
  SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    [length(x) - length(x1), length(x1) - length(x2), length(x2) - length(x3), length(x3) - length(x4), length(x4) - length(x5), length(x5)] AS classes,
    list_transform(words, lambda c: len(list_filter(w, lambda y: y = c))) AS common FROM s),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a)),
d AS (SELECT doc_id, g FROM v GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM v JOIN d USING (doc_id, g), range(0, 5) r(k) GROUP BY 1),
h AS (
  SELECT doc_id, lang, 'c' AS kind, unnest(range(0, 6)) AS k, unnest(classes) AS n FROM f
  UNION ALL SELECT doc_id, lang, 'w', unnest(range(0, 17)), unnest(list_append(common, n_words - list_sum(common))) FROM f),
t AS (SELECT doc_id, kind, sum(n) AS total FROM h GROUP BY 1, 2),
r AS (SELECT lang, kind, k, sum(n) / nullif(sum(sum(n)) OVER (PARTITION BY lang, kind), 0) AS q FROM h GROUP BY 1, 2, 3),
j AS (
  SELECT doc_id, kind, sqrt(greatest(sum({_TERM}), 0.0)) AS dist
  FROM (SELECT h.doc_id, h.kind, h.n / nullif(t.total, 0) AS p, r.q FROM h JOIN t USING (doc_id, kind) JOIN r ON r.kind = h.kind AND r.k = h.k AND r.lang IS NOT DISTINCT FROM h.lang) GROUP BY 1, 2),
y AS (
  SELECT f.*, coalesce(c.n, 0) AS n_repeat_words, CASE WHEN list_sum(classes) >= {divergence.MIN_CHARS} THEN jc.dist END AS cd, CASE WHEN n_words >= {divergence.MIN_WORDS} THEN jw.dist END AS wd
  FROM f LEFT JOIN c USING (doc_id) LEFT JOIN j jc ON jc.doc_id = f.doc_id AND jc.kind = 'c' LEFT JOIN j jw ON jw.doc_id = f.doc_id AND jw.kind = 'w'),
z AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM y)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND coalesce(cd, 0.0) <= {divergence.MAX_CLASS_DISTANCE} AND coalesce(wd, 0.0) <= {divergence.MAX_WORD_DISTANCE} AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM z""",
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y, k = nx.n AND k = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 10 * k >= 8 * (nx.n + ny.n - k)),
r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x),
c AS (SELECT x AS doc_id, min(c) AS class_id FROM r GROUP BY 1),
t AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(l.y) FILTER (same), d.doc_id)) AS copy_id FROM documents d LEFT JOIN l ON l.x = d.doc_id GROUP BY 1),
m AS (
  SELECT l.x AS doc_id, count(*) AS n_links, count(DISTINCT t.copy_id) FILTER (NOT same) AS n_text_links
  FROM l JOIN t ON t.doc_id = l.y GROUP BY 1)
SELECT d.doc_id, c.class_id, t.copy_id, coalesce(m.n_links, 0)::BIGINT AS n_links, coalesce(m.n_text_links, 0)::BIGINT AS n_text_links
FROM documents d JOIN c USING (doc_id) JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op8_source_mixing": r"""
WITH z AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / coalesce(1.5 - length(regexp_replace(text, '[\p{L}\x20\n]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.5) AS key,
    md5(coalesce(text, '')) AS tie FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY 1),
b AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS most FROM a),
c AS (
  SELECT *, most / w AS ratio, sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w,
    sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS cm,
    sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS cw FROM b),
d AS (SELECT *, cm + ratio * (all_w - cw) <= total AS whole FROM c),
e AS (SELECT *, coalesce(sum(most) FILTER (whole) OVER (), 0.0) AS used, coalesce(sum(w) FILTER (whole) OVER (), 0.0) AS gone FROM d),
f AS (SELECT source, source_size, CASE WHEN whole THEN most ELSE (total - used) / nullif(all_w - gone, 0.0) * w END::DOUBLE AS target FROM e),
g AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM f),
h AS (
  SELECT z.doc_id, z.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
    sum(z.size) OVER (PARTITION BY z.source ORDER BY key, doc_id, tie ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source),
i AS (SELECT *, epochs + (upto <= rest OR (upto - size < rest AND upto - rest <= rest - (upto - size)))::BIGINT AS copies FROM h)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM i""",
    "op7_url_lists": r"""
WITH h0 AS (
  SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
    (DATE '2024-01-01' + ((page_id * 7) % 366)::INT)::DATE AS fetched FROM pages),
hosts AS (SELECT DISTINCT host FROM h0 WHERE host <> ''),
r0 AS (
  SELECT host AS domain, '' AS prefix, 3 AS every FROM hosts
  UNION ALL SELECT DISTINCT regexp_replace(host, '^[^.]+\.', '') AS domain, '', 5 FROM hosts WHERE host LIKE '%.%.%'
  UNION ALL SELECT host, '/en/', 4 FROM hosts),
r AS (SELECT *, ('0x' || substr(md5(domain || prefix), 1, 6))::BIGINT AS k FROM r0),
ch0 AS (
  SELECT domain, prefix, TRUE AS listed, k % 200 AS d FROM r WHERE k % every = 1
  UNION ALL SELECT domain, prefix, FALSE, k % 200 + 30 + k % 90 FROM r WHERE k % every = 1
  UNION ALL SELECT domain, prefix, TRUE, k % 200 + 150 FROM r WHERE k % every = 1),
ch1 AS (SELECT domain, prefix, d, min(listed) AS listed FROM ch0 GROUP BY ALL),
ch2 AS (SELECT *, coalesce(lag(listed) OVER (PARTITION BY domain, prefix ORDER BY d), FALSE) AS was FROM ch1),
ch3 AS (SELECT *, lead(d) OVER (PARTITION BY domain, prefix ORDER BY d) AS e FROM ch2 WHERE was <> listed),
iv AS (SELECT domain, prefix, (DATE '2024-01-01' + d::INT)::DATE AS since, (DATE '2024-01-01' + e::INT)::DATE AS until FROM ch3 WHERE listed),
m AS (
  SELECT h0.page_id, h0.url, iv.*, row_number() OVER (PARTITION BY h0.page_id ORDER BY length(domain) DESC, length(prefix) DESC, domain, prefix, since) AS n
  FROM h0 JOIN iv ON (h0.host = iv.domain OR ends_with(h0.host, '.' || iv.domain)) AND starts_with(h0.path, iv.prefix)
    AND iv.since <= h0.fetched AND (iv.until IS NULL OR h0.fetched < iv.until))
SELECT h0.page_id, h0.url, h0.host, h0.fetched::VARCHAR AS fetched, m.page_id IS NOT NULL AS blocked, m.domain || m.prefix AS rule, m.since::VARCHAR AS listed_since
FROM h0 LEFT JOIN (SELECT * FROM m WHERE n = 1) m ON m.page_id = h0.page_id""",
}
