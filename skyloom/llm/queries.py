"""The operators with their production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.llm import ann, bytebpe, counts, eliasfano, jaccard, packing, pq, quality, secrets, sharding, trie, urlfilter, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op2_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eliasfano.round_trip(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op3_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir)).drop("found")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts.token_counts(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op6_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched at a time that follows from the id; the list's entries (three dates for each
    host and each parent domain) follow from the names."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 731 * 86400 + F.col("page_id") * 37 % 24 * 3600)
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("key")).filter("key != ''").distinct()
    parents = hosts.select(F.regexp_extract("key", r"^[^.]+\.(.+\..+)$", 1).alias("key")).filter("key != ''")
    names = hosts.union(parents).distinct().withColumn("h", F.length("key") * 31 + F.ascii("key") * 17 + F.ascii(F.substring("key", 4, 1)) * 7)
    entries = names.select("key", "h", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("e")).select(
        "key", F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), F.col("h") % 3 + 1).alias("list"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("h") % 97 * 3 + F.col("e") * (20 + F.col("h") % 150)) * 86400).alias("at"), (F.col("e") % 2 == 0).alias("active"),
    )
    out = urlfilter.listed_at_fetch(pages.withColumn("fetched", fetched), entries)
    return out.select("page_id", F.unix_seconds("fetched").alias("fetched_s"), "blocked", "lists", "matched")


OP6_SQL = r"""
WITH captures AS (
  SELECT page_id, url, 1704067200 + page_id % 731 * 86400 + page_id * 37 % 24 * 3600 AS fetched_s,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
names AS (
  SELECT DISTINCT key, length(key) * 31 + ascii(key) * 17 + ascii(substr(key, 4, 1)) * 7 AS h
  FROM (SELECT host AS key FROM captures UNION ALL SELECT regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) FROM captures)
  WHERE key <> ''),
entries AS (
  SELECT key, ['adult', 'malware', 'spam'][h % 3 + 1] AS list, 1704067200 + (h % 97 * 3 + e * (20 + h % 150)) * 86400 AS since, e
  FROM names, range(3) r(e)),
spans AS (
  SELECT key, list, since, until FROM (SELECT *, lead(since) OVER (PARTITION BY key, list ORDER BY since) AS until FROM entries) WHERE e % 2 = 0),
met AS (
  SELECT DISTINCT c.page_id, s.list, s.key
  FROM captures c JOIN spans s ON (c.host = s.key OR ends_with(c.host, '.' || s.key) OR c.host || c.path = s.key)
   AND s.since <= c.fetched_s AND (s.until IS NULL OR c.fetched_s < s.until)),
told AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, arg_max(key, length(key) * 1000) AS matched FROM met GROUP BY page_id)
SELECT c.page_id, c.fetched_s, t.lists IS NOT NULL AS blocked, coalesce(t.lists, '') AS lists, t.matched
FROM captures c LEFT JOIN told t USING (page_id)
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_docs(spark, sf_dir))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.with_label_errors(pq.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, p, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d
  FROM (SELECT r, x.p, e, CAST(sum((v - c) * (v - c)) AS BIGINT) AS d FROM x JOIN book{k} b ON x.p = b.p AND x.i = b.i GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c) AS c FROM book{k} b
  LEFT JOIN (SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM near{k} JOIN x USING (r, p) GROUP BY 1, 2, 3) USING (p, e, i))""")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS r, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)),
x AS MATERIALIZED (SELECT r, k * {parts} // len(q) AS p, k % (len(q) // {parts}) AS i, q[k + 1] AS v FROM (SELECT r, q, unnest(range(len(q))) AS k FROM kept)),
book0 AS MATERIALIZED (SELECT p, r AS e, i, v AS c FROM x WHERE r < {entries}),
{", ".join(steps)},
told AS (SELECT r, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{rounds}) AS codebooks_sha256 FROM kept JOIN told USING (r)"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND (page_id IS NULL OR page_id > first) AS again FROM q)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_STEP = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"  # one bit of the checksum
OP13_SQL = f"""
WITH bits AS (SELECT c, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda u, z: {_STEP.format("u")})) AS state
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
heads AS (SELECT c, xor(state, 4294967295) % 4 AS h FROM bits),
turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
  ORDER BY turn NULLS FIRST, from_hex(sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')))) AS k FROM conversations),
built AS (SELECT h.c, t.k, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c - h.c % 20 AND t.k <= h.h UNION ALL
  SELECT h.c, h.h + t.k, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c AND t.k > h.h),
seqs AS (SELECT h.c, coalesce(list(sha256(strlen(b.role) || ':' || b.role || b.text) ORDER BY b.k) FILTER (b.k IS NOT NULL), []) AS s, coalesce(list(len(regexp_extract_all(b.text, '[^\x20\x09-\x0D]+')) ORDER BY b.k) FILTER (b.k IS NOT NULL), []) AS w
  FROM heads h LEFT JOIN built b USING (c) GROUP BY 1),
prefixes AS (SELECT c, d, s[1:d] AS pre, w[d] AS words, len(s) = d AS whole FROM (SELECT c, s, w, unnest(range(len(s) + 1)) AS d FROM seqs)),
node AS (SELECT d, pre, min(c) AS conv_id, count(*) AS n, coalesce(any_value(words), 0) AS words, coalesce(string_agg(CASE WHEN whole THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM prefixes GROUP BY 1, 2),
kids AS (SELECT pre[1:d - 1] AS pre, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (pre)),
below AS (SELECT pre, sum(saved) AS saved, sum(leaf) AS leaves FROM (SELECT pre[1:unnest(range(d + 1))] AS pre, (n - 1) * words AS saved, CASE WHEN kids = 0 THEN 1 ELSE 0 END AS leaf FROM full_) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN below b USING (pre) LEFT JOIN node up ON f.d > 0 AND up.pre = f.pre[1:f.d - 1]
"""


QUERIES = {f.__name__: f for f in (
    op1_mcd_quality, op2_elias_fano, op3_entropy_secrets, op4_token_counts, op5_best_fit_packing, op6_temporal_lists, op7_sharding, op8_ngram_jaccard, op9_byte_bpe, op10_posting_lists, op11_vector_codes, op12_warc,
    op13_prefix_trie,
)}
ORACLE: dict[str, str] = {"op6_temporal_lists": OP6_SQL, "op11_vector_codes": _op11_sql(), "op12_warc": OP12_SQL, "op13_prefix_trie": OP13_SQL}
