"""Importance resampling, centroid clusters and neighbour votes against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapewatch.llm import centroids, importance, voting
from tapewatch.llm.base import byte_views

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_texts(n=40):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abÄcdZ1'é漢") for _ in range(r.randint(1, 12)))
    return ["", None, "Hello, World! hello", "ÄÖ x_y-z 1,2", "a" * 70_000, "..", "x", "x y " * 9000] + [" ".join(word() for _ in range(r.randint(0, 300))) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 3])
def test_run_crcs_equal_zlib(most):
    texts = odd_texts()
    crcs, runs, words = importance.run_crcs(*byte_views(pa.array(texts)), most)
    at = 0
    for text, n_runs, n_words in zip(texts, runs, words):
        own = WORDS.findall(lower(text))
        assert len(own) == n_words
        want = sorted(zlib.crc32(" ".join(own[i:i + n]).encode()) for n in range(1, most + 1) for i in range(len(own) - n + 1))
        assert sorted(crcs[at:at + n_runs].tolist()) == want
        at += n_runs
    assert at == len(crcs)


def plain_sample(docs, target, most, buckets, percent, least):
    def found(text):
        own = WORDS.findall(lower(text))
        return len(own), [zlib.crc32(" ".join(own[i:i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(own) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for table, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in found(text)[1]:
                table[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in docs:
        words, own = found(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, (r[:5] for r in out)), key=repr)


@pytest.mark.parametrize("most, buckets, percent", [(1, 10_000, 10), (2, 500, 60)])
def test_importance_sample_equals_plain_python(spark, most, buckets, percent):
    docs = list(enumerate(odd_texts())) + [(None, "a b " * 30), (7, "x"), (3, "ab " * 50), (3, "ab " * 50), (None, None)]
    target = ["hello world", None, "", "a b c d 1 2 é"]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, score int").repartition(5)
    rows = importance.importance_sample(frame, spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=buckets, percent=percent)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in rows.dtypes} == {"bigint"}
    assert sorted(map(tuple, rows.collect()), key=repr) == plain_sample(docs, target, most, buckets, percent, 20)


def test_importance_sample_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert importance.importance_sample(empty, some).count() == 0
    assert importance.importance_sample(some, empty, percent=100).first().rank == 1


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(256 * x) < 1 << 27 for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, n) in zip(kept, near) if n == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    inertia = [sum(d for d, n in near if n == j) for j in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, n, d, inertia[n], sum(inertia), digest[n]) for (i, _), (d, n) in zip(kept, near)), key=repr)


@pytest.mark.parametrize("shard, width", [(centroids.SHARD, centroids.WIDTH), (7, 3), (50, 64)])
def test_clusters_equal_plain_python(spark, shard, width):
    r = random.Random(5)
    centre = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + r.gauss(0, 0.1))) for x in r.choice(centre)]) for i in range(150)]
    rows += [(200 + i, rows[i % 4][1]) for i in range(30)] + [(3, rows[9][1]), (None, rows[5][1]), (None, rows[5][1]), (300, [0.0] * 8), (301, [1000.5] * 8)]
    rows += [(400, None), (401, []), (402, [1.0] * 7), (403, [float("nan")] * 8), (404, [float("inf")] + [0.0] * 7), (405, [None] + [0.0] * 7), (406, [1e9] * 8)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(4)
    got = centroids.cluster_vectors(frame, k=12, rounds=4, dims=8, shard=shard, width=width)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, 12, 4, 8)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.cluster_vectors(spark.createDataFrame([], schema), dims=2).count() == 0
    two = centroids.cluster_vectors(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, None)], schema), dims=2).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in two] == [(0, 0, 0)] * 2  # equal first centroids: the later one stays empty


def held_out_scores(spark, folder):
    rows = entry.queries()["op11_quality_votes"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("quality is not null")
    return rows, [(r.score, r.quality) for r in rows.filter("held_out").join(labels, "doc_id").collect()]


def test_votes_on_held_out_documents(spark):
    rows, known = held_out_scores(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows.collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    good, bad = [s for s, q in known if q == 1], [s for s, q in known if q == 0]
    assert len(bad) > 5 and np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.98
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in known]) > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    turned = labels.withColumn("quality", F.when(fold == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    one, two = (sorted(map(tuple, voting.quality_votes(d, x, fold != 1).collect())) for d, x in ((docs, labels), (other, turned)))
    assert one == two


def test_votes_equal_plain_python(spark):
    texts = ["good calm words here", "calm words are good", "BAD!! WORDS!!", "VERY!! BAD!!", "good words", "so BAD!! words", "", None, " \n", "x" * 100_000]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "calm", 0.0), (4, "good words", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0), (3, None), (None, 1), (99, 0)], "doc_id long, quality int")
    n, found = voting.document_frequencies(docs)
    assert n == 12 and found.max() <= 12
    space = voting.fit_space(voting.labelled_sample(docs, labels, F.lit(True), 10), n, found, 8)
    assert sorted(space.labels.tolist()) == [0, 0, 1, 1]
    got = sorted(map(tuple, voting.quality_votes(docs, labels, F.lit(True), neighbours=2, dims=8, per_class=10).collect()), key=repr)
    want = []
    for doc_id, text, _ in docs.collect():
        own = space.project(voting.term_counts(*byte_views(pa.array([text]))))[0]
        near = sorted(((round(float(own @ v), 5), q) for v, q in zip(space.vectors, space.labels)), reverse=True)
        best = [(max(s, 0), q) for s, q in near if s >= near[1][0]]
        total = sum(s for s, _ in best)
        want.append((doc_id, sum(s * q for s, q in best) / total if total else 0.5))
    assert [i for i, _ in got] == [i for i, _ in sorted(want, key=repr)]
    assert np.allclose([s for _, s in got], [s for _, s in sorted(want, key=repr)], atol=1e-4)
    score = {i: s for i, s in got}
    assert score[6] == score[7] == score[8] == 0.5 and score[4] > 0.5 > score[3]


def test_votes_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in voting.quality_votes(docs, labels, F.lit(True)).collect()] == [0.5, 0.5]
    assert voting.quality_votes(docs.limit(0), labels, F.lit(True)).count() == 0
    only = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.score for r in voting.quality_votes(docs, only, F.lit(True)).collect()] == [1.0, 1.0]
