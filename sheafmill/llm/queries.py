"""The opN_ queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive, clusters, codec, embeddings, language, minhash, mixing, packing, quality, secrets, sharding, urls, variants
from .common import table

#: The rules of op7: host, path prefix and verdict.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return dealt.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = codec.write_token_files(table(spark, sf_dir, "documents"))
    read = codec.read_token_files(manifest)
    return read.select(
        F.col("key").alias("doc_id"), "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)
    return found.select("vec_id", "n_links", "component_id", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, urls.RULE_SCHEMA)
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_metrics(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.METRICS)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a candidate: its document and word, the crc32 of its text, the forest's score and verdict."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), [F.col("doc_id")])
    return found.select(F.col("__key0").alias("doc_id"), "word_ix", F.crc32(F.col("finding").cast("binary")).alias("finding_crc32"), "score", "is_secret")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster(table(spark, sf_dir, "embeddings"), k=8, dims=64, rounds=10, seed=3, scale=1024)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()} | {"pipeline": corpus_pipeline.run}


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rule, rhost, rpath, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
places AS (SELECT DISTINCT host, path FROM p),
best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM places JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""


#: Whole shingle sets and their Jaccard similarity; n^2 only where documents share a shingle.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id, r.doc_id = min(reached) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93),
r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
"""

FURNITURE_SQL = " OR ".join(f"contains(lower(line), '{x}')" for x in quality.FURNITURE)
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i : i + 2], ' ') AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid),
ln AS (SELECT rid, ix, ls[ix] AS line FROM w, unnest(range(1, len(ls) + 1)) AS u(ix)),
m AS (SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
  length(line) - length(replace(line, '|', '')) AS pipes, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols, (length(line) - length(replace(line, '!!', ''))) / 2.0 AS shouts,
  row_number() OVER (PARTITION BY rid, line ORDER BY ix) > 1 AS again FROM ln),
f AS (SELECT rid, sum(CASE WHEN again AND chars > 0 THEN 1 ELSE 0 END) AS dups, sum(CASE WHEN chars > 0 AND (again OR (pipes > 0 AND pipes >= 0.2 * words) OR symbols > 0.1 * chars OR (shouts > 0 AND shouts >= 0.5 * words) OR (words <= 12 AND ({FURNITURE_SQL}))) THEN chars ELSE 0 END) AS lost FROM m GROUP BY rid),
r AS (SELECT doc_id, len(ws)::bigint AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, dups::bigint AS n_dup_lines, coalesce(n, 0)::bigint AS n_repeat_words, lost::bigint AS lost_chars
  FROM w JOIN f USING (rid) LEFT JOIN cov USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.4 * word_chars AS kept FROM r
"""

#: crc32 by its table; near words by what a deletion leaves of them.
OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) AS r(i)),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::bigint] ELSE [192 + (unicode(x) >> 6)::bigint, 128 + (unicode(x) & 63)::bigint] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) ELSE run END AS word, sum(n)::bigint AS n FROM h GROUP BY 1),
v AS MATERIALIZED (SELECT word, n FROM w WHERE length(word) >= 6 AND n >= 5),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS u(i)),
l AS (SELECT DISTINCT * FROM (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.rest = b.word UNION ALL SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM l GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN (SELECT min(near) FROM l WHERE l.word = v.word AND l.n = best_n) END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN best USING (word)),
p AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, p.root FROM p JOIN f ON f.form = p.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN p USING (word)
"""

#: Assignment and means of a round, ten times over.
ROUND_SQL = """
a{i} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min(8 * list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint + cluster) AS m FROM v, c{i} GROUP BY vec_id),
c{j} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(new, c) AS c FROM c{i} LEFT JOIN (
  SELECT cluster, list(x ORDER BY k) AS new FROM (SELECT m % 8 AS cluster, k, floor(sum(q[k]) / count(*))::bigint AS x FROM a{i}, unnest(range(1, 65)) AS u(k) GROUP BY ALL) GROUP BY cluster) n ON n.cluster = c{i}.cluster)"""
OP13_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, q AS c FROM v ORDER BY cluster LIMIT 8),{",".join(ROUND_SQL.format(i=i, j=i + 1) for i in range(11))}
SELECT vec_id, cluster::int AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::bigint AS cluster_inertia, sum(distance) OVER ()::bigint AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM (SELECT vec_id, m % 8 AS cluster, m // 8 AS distance FROM a10) JOIN c10 USING (cluster)
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it expresses a query; the others are tested against brute force, round trips and held-out accuracy in tests/llm."""
    return {"op4_minhash": OP4_SQL, "op6_embedding_dedup": OP6_SQL, "op7_url_filter": OP7_SQL, "op9_quality_rules": OP9_SQL, "op12_spelling_variants": OP12_SQL, "op13_centroid_clusters": OP13_SQL}
