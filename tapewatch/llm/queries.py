"""The queries of the corpus operators, over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tapewatch.llm import mixing, packing, pii, quality, token_files, warc
from tapewatch.llm.centroids import cluster_vectors
from tapewatch.llm.graphs import near_vectors
from tapewatch.llm.html import extract_main_text
from tapewatch.llm.importance import importance_sample
from tapewatch.llm.jaccard import jaccard_join
from tapewatch.llm.substrings import remove_repeated
from tapewatch.llm.voting import quality_votes
from tapewatch.session import workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), words=3, threshold=(9, 10))


def op2_graph_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_main_text(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_table(spark, sf_dir, "documents"))
    return rows.withColumns({"base_failed": ~quality.passes("base"), "kept": quality.passes("v1")})


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    parts = packing.pieces(_table(spark, sf_dir, "documents"), path, drops_space=True, end_id=0, capacity=2048)
    return packing.pack(parts.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 2048)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{workspace(spark)}/tokens"
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), drops_space=False, end_id=2)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.replace_entities(_table(spark, sf_dir, "documents"))
    counts = [(F.size("replaced") - F.size(F.array_remove("replaced", t))).cast("long").alias(f"n_{t}") for t in pii.TYPES]
    return rows.select("doc_id", "text", F.size("replaced").cast("long").alias("n_replaced"), *counts)


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated(_table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x.stop - x.start)
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives the pages twice; in the second replica one page in 256, chosen by md5 of its id, loses its first
    character, and the audit has to find these records and no others."""
    pages, folder = _table(spark, sf_dir, "pages"), workspace(spark)
    hit = F.substring(F.md5(F.concat(F.lit("decay:"), F.col("page_id").cast("string"))), 1, 2) == "00"
    warc.write_warc(pages, f"{folder}/one")
    warc.write_warc(pages.withColumn("html", F.when(hit, F.substring("html", 2, 1 << 30)).otherwise(F.col("html"))), f"{folder}/two")
    rows = warc.audit_folders(spark, f"{folder}/one", f"{folder}/two")
    return rows.select("page_id", "url", F.col("payload_size").alias("n_bytes"), "payload_sha256", "status")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = quality_votes(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold != 1)
    return rows.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2)


def op13_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), most=1, buckets=10_000, seed=2024,
                             least_words=20, percent=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_graph_near_dedup": op2_graph_near_dedup,
    "op3_main_text": op3_main_text,
    "op4_quality_rules": op4_quality_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_files": op6_token_files,
    "op7_surrogates": op7_surrogates,
    "op8_repeated_substrings": op8_repeated_substrings,
    "op9_fixity_audit": op9_fixity_audit,
    "op10_mix_sources": op10_mix_sources,
    "op11_quality_votes": op11_quality_votes,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_importance_sample": op13_importance_sample,
}


def _clusters_sql(rounds: int = 5, k: int = 40) -> str:
    """The rounds one after the other, each as two tables."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, v, unnest(arg_min([c, d], [d, c], 1))[1] AS c, min(d) AS d FROM (
  SELECT vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - x[i]) * (v[i] - x[i])))::BIGINT AS d FROM e, c{n}) GROUP BY vec_id, v)""")
        steps.append(f"""s{n} AS (SELECT c, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM a{n}, range(1, 65) r(i) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(l, x) AS x FROM c{n} LEFT JOIN (SELECT c, list(m ORDER BY i) AS l FROM s{n} GROUP BY c) USING (c))""")
    return f"""WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS x FROM e ORDER BY sha256('2:' || vec_id) LIMIT {k}),
{", ".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


SQL: dict[str, str] = {"op1_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
    ELSE list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles,
  (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links, min(r.b) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
""", "op2_graph_near_dedup": r"""
WITH RECURSIVE e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = v.vec_id AS kept
FROM embeddings v JOIN r ON r.a = v.vec_id GROUP BY v.vec_id
""", "op4_quality_rules": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS i, unnest(list_transform(range(1, len(l) - 1), lambda i: [l[i], l[i + 1], l[i + 2]])) AS g FROM w),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(l)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS n_upper, length(regexp_replace(t, '\P{L}+', '', 'g')) AS n_letters
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
  + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (2 * n_upper > n_letters)::BIGINT + 32 * (10 * n_letters < 6 * word_chars)::BIGINT
  + 64 * (word_chars < 3 * n_words)::BIGINT + 128 * (word_chars > 12 * n_words)::BIGINT AS failures FROM m)
SELECT *, failures & 3 <> 0 AS base_failed, failures & 31 = 0 AS kept FROM f
""", "op9_fixity_audit": r"""
SELECT page_id, url, strlen(coalesce(html, '')) AS n_bytes, sha256(coalesce(html, '')) AS payload_sha256,
  CASE WHEN coalesce(html, '') <> '' AND md5('decay:' || page_id)[1:2] = '00' THEN 'changed' ELSE 'intact' END AS status FROM pages
""", "op10_mix_sources": r"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM z GROUP BY source),
c AS (SELECT *, [5.0, 2.0, 1.0][1 + s % 3]::DOUBLE AS w, (3 * source_size)::DOUBLE AS most FROM b),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER before, 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM c
  WINDOW before AS (ORDER BY most / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, (most / w, s)) AS level FROM l WHERE level <= most / w),
g AS (SELECT source, source_size, least(most, v.level * w) AS target FROM l, v),
t AS (SELECT *, least(round(target)::BIGINT, 3 * source_size) AS take FROM g),
n AS (SELECT greatest(1, ceil(count(*) / 10000.0)::BIGINT) AS chunks FROM z),
o AS (SELECT z.*, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM z),
p AS (SELECT o.*, ('0x' || digest[1:8])::BIGINT % n.chunks AS chunk FROM o, n),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY chunk, digest, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p)
SELECT q.doc_id, q.source, q.size, t.source_size, t.target,
  CASE WHEN q.size = 0 THEN 0 ELSE (take // source_size) * size
    + greatest(0, least(start + size, take % source_size) - least(start, take % source_size)) END::BIGINT AS taken
FROM q JOIN t ON t.source IS NOT DISTINCT FROM q.source
""", "op12_centroid_clusters": _clusters_sql(), "op13_importance_sample": r"""
WITH b AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
low AS (SELECT doc_id, coalesce(text, '') AS text, false AS aim FROM documents UNION ALL SELECT null, coalesce(text, ''), true FROM benchmark),
w AS (SELECT row_number() OVER () AS n, doc_id, aim, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM low),
d AS (SELECT DISTINCT unnest(l) AS word FROM w),
y AS (SELECT word, list_transform(range(0, strlen(word)), lambda i: ('0x' || hex(encode(word))[2 * i + 1:2 * i + 2])::BIGINT) AS l FROM d),
h AS (SELECT word, xor(list_reduce(l, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % 10000 AS bucket FROM y, b),
f AS (SELECT n, doc_id, aim, bucket FROM (SELECT n, doc_id, aim, unnest(l) AS word FROM w) JOIN h USING (word)),
c AS (SELECT bucket, count(*) FILTER (NOT aim) AS s, count(*) FILTER (aim) AS t FROM f GROUP BY bucket),
z AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM c),
g AS (SELECT bucket, floor(1000 * ln((c.t + 1.0::DOUBLE) * (z.s + 10000) / ((c.s + 1.0::DOUBLE) * (z.t + 10000))))::BIGINT AS gain FROM c, z),
m AS (SELECT n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN g USING (bucket) GROUP BY n),
v AS (SELECT w.doc_id, len(l)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || sha256('2024:' || w.doc_id)[1:8])::BIGINT AS h FROM w LEFT JOIN m USING (n) WHERE NOT aim),
p AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM v),
q AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
  floor(10 * count(*) OVER (PARTITION BY n_features >= 20) / 100) AS drawn FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM q
"""}
