"""The corpus operators bound to the given tables, with SQL twins where SQL can say the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from peakloom.llm.bpe import encode_documents
from peakloom.llm.common import table
from peakloom.llm.decontamination import contamination
from peakloom.llm.exact_dedup import exact_dedup
from peakloom.llm.line_dedup import line_dedup
from peakloom.llm.mixing import mix_documents
from peakloom.llm.pii import pseudonymise
from peakloom.llm.quality import fit, score_documents
from peakloom.llm.sharding import shard_rows
from peakloom.llm.simhash import simhash_groups
from peakloom.llm.spelling import spelling_forms
from peakloom.llm.suffix_dedup import suffix_dedup
from peakloom.llm.url_filter import rules_table, url_filter
from peakloom.llm.whitening import whiten

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES))


OP1_SQL = r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^((?s).*?)://([^/?#]*)([^?#]*)', ['a', 'host', 'path']) AS m FROM pages),
h AS (SELECT page_id, translate(coalesce(m.host, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(m.path, '') AS path FROM u),
r AS (SELECT *, '.' || host AS dotted FROM h),
w AS (SELECT page_id, host, path, CASE
  WHEN dotted LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN dotted LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN dotted LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN dotted LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN dotted LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM w
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("first", "last", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda n, x: n + x)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("first").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).drop("row", "keep_row")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), VOCABULARY, ["n_tokens", "ids_sha256", "decoded_sha256"])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, CASE WHEN length(key) >= 10 THEN min(doc_id) OVER (PARTITION BY key) < doc_id ELSE false END AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, greatest(len(ws) - 8, 2)), lambda i: array_to_string(ws[i:i + 9], ' '))) AS phrase FROM b WHERE len(ws) > 0),
dw AS (SELECT r, k, unnest(range(1, len(ws) - k + 2)) AS p, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
       FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k),
m AS (SELECT r, p, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.phrase = bw.phrase),
h AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS w FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = F.col("mixes")[0]
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", mix["target"].alias("target"), mix["taken"].alias("taken"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS r, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source),
c AS (SELECT *, sum(3 * n) OVER o AS cc, sum(w) OVER o AS cw, sum(n) OVER () AS total, sum(w) OVER () AS tw FROM s WINDOW o AS (ORDER BY 3 * n / w, source ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, cc * w + 3 * n * (tw - cw) <= total * w AS capped FROM c),
t AS (SELECT source, n, CASE WHEN capped THEN CAST(3 * n AS DOUBLE) ELSE CAST(w * (total - coalesce(sum(3 * n) FILTER (capped) OVER (), 0)) AS DOUBLE) / sum(w) FILTER (NOT capped) OVER () END AS target FROM f),
b AS (SELECT source, n, target, CASE WHEN n > 0 THEN CAST(round(target) AS BIGINT) // n ELSE 0 END AS whole, CASE WHEN n > 0 THEN CAST(round(target) AS BIGINT) % n ELSE 0 END AS rest FROM t),
o AS (SELECT d.doc_id, d.size, b.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.r ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(size * (whole + CASE WHEN upto <= rest OR (upto - size <= rest AND 2 * (rest - upto + size) > size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = whiten(table(spark, sf_dir, "embeddings"))
    share = F.element_at(F.array(*[F.lit(float(e)) for e in model["explained"]]).cast("array<double>"), F.col("component"))
    rows = out.select(F.col("id").alias("vec_id"), "n", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    # beyond the range of a long the exact value is in deviation_exact only
    long = F.col("deviation").try_cast("bigint")
    return rows.select("vec_id", "component", "n", long.alias("deviation"), "whitened", share.alias("explained"), F.lit(model["identity_error"]).alias("identity_error"), F.col("deviation").alias("deviation_exact"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_exact_dedup, op3_suffix_dedup, op4_simhash, op5_sharding, op6_quality, op7_bpe, op8_line_dedup, op9_decontamination, op10_pii,
        op11_mixing, op12_whitening, op13_spelling,
    )
}
ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op8_line_dedup": OP8_SQL, "op9_decontamination": OP9_SQL, "op11_mixing": OP11_SQL}
