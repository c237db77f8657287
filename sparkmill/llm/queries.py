"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm import bpe, piece_bpe, warc
from sparkmill.llm.centroids import centroid_clusters
from sparkmill.llm.embeddings import near_embeddings
from sparkmill.llm.lattice import score_texts
from sparkmill.llm.mixing import mix
from sparkmill.llm.quality_rules import quality_rules
from sparkmill.llm.ranking import train_ranker
from sparkmill.llm.resampling import resample
from sparkmill.llm.simhash import simhash_classes
from sparkmill.llm.suffix import remove_repeats
from sparkmill.llm.url_filter import canonical, host_of, path_of, url_filter
from sparkmill.sources.parquet import read_table

URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


#: Share of the documents below the bar that op5 reports beside its prediction.
LOWEST = 0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_table(spark, path) if name in ("documents", "pages") else spark.read.parquet(path)  # the tables of long texts


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), min_len=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_embeddings(table(spark, sf_dir, "embeddings"), least=0.95)
    return out.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"), min_payload=0)
    return back.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"), "url", "segments", "status")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    ranker = train_ranker(docs, labels.where(~held_out))
    scored, bar = ranker.score_and_quantile(docs, quantile=LOWEST)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), (F.col("score") >= F.lit(bar)).alias("above_quantile"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs that two or more pages have (the same page captured again)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.coalesce(F.col("url"), F.lit(""))
    listed = pages.select(canonical(host_of(url), path_of(url)).alias("key")).groupBy("key").count().where("count > 1").select("key")
    return url_filter(pages, listed, URL_RULES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op8_mixing: sizes and targets; which documents are taken goes by a hash."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), held_out)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = piece_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64)


OP3_SQL = r"""
WITH RECURSIVE g AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS other FROM g UNION SELECT r.node, e.y FROM r JOIN e ON r.other = e.x),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY 1),
l AS (SELECT x, count(*) AS n_links FROM e GROUP BY 1)
SELECT node AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN l ON x = node
"""

# the common level of the targets is the largest of those that clamping the sources one by one in the order of their caps gives
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY 1),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, sum(s) OVER () AS total FROM s),
c AS (SELECT *, (total - coalesce(sum(3.0::DOUBLE * s) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r)
SELECT doc_id, size, s AS source_size, round(least((SELECT max(level) FROM c) * w, 3.0::DOUBLE * s), 3) AS target FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS mark FROM pages),
h AS (SELECT page_id, CASE WHEN mark > 0 THEN translate(regexp_extract(substr(url, mark + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM h),
l AS (SELECT canonical AS k FROM c WHERE canonical <> '' GROUP BY 1 HAVING count(*) > 1),
r(rule, verdict, rh, rp) AS (VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
m AS (SELECT c.page_id, c.canonical, c.host, c.path, r.rule, r.verdict, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM c LEFT JOIN r ON (c.host = r.rh OR ends_with(c.host, '.' || r.rh)) AND starts_with(c.path, r.rp))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN l.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, canonical, l.k IS NOT NULL AS listed
FROM m LEFT JOIN l ON m.canonical = l.k WHERE m.k = 1
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY 1),
n AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
c AS (SELECT doc_id, source, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words,
  n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive, 10 * n_symbols > word_chars AS symbols, 2 * (len(ls) - len(list_distinct(ls))) > len(ls) AS duplicate_lines FROM n),
s AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM (SELECT source, unnest(['short', 'repetitive', 'symbols', 'duplicate_lines']) AS rule, unnest([short, repetitive, symbols, duplicate_lines]) AS failed FROM c) GROUP BY ALL),
p AS (SELECT rule, m, least(greatest(m * (1 - m) / greatest(m2 - m * m, 1e-12) - 1, 1.0), 1e4) AS k FROM (SELECT rule, sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) AS m2 FROM s GROUP BY 1)),
h AS (SELECT source, max((f + m * k) / (n + k)) AS host_rate FROM s JOIN p USING (rule) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed, NOT (short OR repetitive) AND host_rate <= 0.5 AS kept, round(host_rate, 6) AS host_rate
FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source
"""

# crc32 goes byte by byte through the 256 rests of its polynomial, which are worked out first
OP11_SQL = r"""
WITH RECURSIVE rests AS (SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM rests WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS rest FROM rests WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT unnest(ws) AS w FROM (SELECT ws FROM d UNION ALL SELECT ws FROM b)),
h AS (SELECT w, xor(list_reduce(list_transform(range(1, length(hex(w)) // 2 + 1), lambda i: ('0x' || substr(hex(w), 2 * i - 1, 2))::UBIGINT), lambda c, x: xor(c >> 8, rest[(xor(c, x) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS bucket FROM w, crc),
f AS (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN h USING (w) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM f GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(ws) AS w FROM b) JOIN h USING (w) GROUP BY 1),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS big_s, coalesce((SELECT sum(t) FROM t), 0) AS big_t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (big_t + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
x AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM f JOIN g USING (bucket) GROUP BY 1),
y AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= (SELECT count(*) FROM z WHERE n_features >= 20) * 10 // 100 THEN r END AS rank FROM r
"""


def _op13_sql(rounds: int = 10) -> str:
    """Rounds of assignment and means, one pair of tables each."""
    kept = "list_count(embedding) = 64 AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: NOT isfinite(x)))"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {kept})",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INT AS j, v AS c FROM v QUALIFY j < 8)",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, j, d FROM (SELECT vec_id, v, j, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM v, c{r}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)")
        if r < rounds:
            parts.append(f"m{r} AS MATERIALIZED (SELECT j, list(m ORDER BY i) AS c FROM (SELECT j, i, (s - (s % n + n) % n) // n AS m FROM (SELECT j, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL)) GROUP BY j)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))")
    return f"WITH {', '.join(parts)} SELECT vec_id, j AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_suffix_array, op3_embeddings, op4_warc, op5_quality, op6_simhash, op7_url_filter, op8_mixing, op9_lm_scoring, op10_quality_rules, op11_resampling, op12_piece_bpe, op13_centroids, mixing_targets)}


def oracle_sql() -> dict[str, str]:
    return {"op3_embeddings": OP3_SQL, "mixing_targets": MIXING_SQL, "op7_url_filter": OP7_SQL, "op10_quality_rules": OP10_SQL, "op11_resampling": OP11_SQL, "op13_centroids": OP13_SQL}
