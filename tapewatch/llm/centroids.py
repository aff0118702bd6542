"""Centroid clustering in whole numbers, over vectors that are kept as codes of their distinct subvectors.

Every shard of vectors has, for each block of dimensions, a dictionary of the distinct subvectors in it and a code per
vector: nothing is lost. A round computes the distance of every dictionary entry to that part of every centroid once and adds
them up by code. Only sums per cluster leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.session import cut

#: Vectors of a shard at most, and the dimensions of a block. A block of few dimensions has fewer subvectors than vectors.
SHARD, WIDTH = 16_384, 2
#: Vectors whose distances to all centroids are held at once.
STEP = 4096
#: Largest whole number of a component; squared distances of 64 of them stay below 2^63.
LIMIT = 1 << 27


def _usable(column: str, dims: int, scale: int) -> Column:
    value = F.col(column)
    wrong = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= LIMIT))
    return value.isNotNull() & (F.size(value) == dims) & ~wrong


def _shards(rows: DataFrame, dims: int, scale: int, shard: int, width: int) -> DataFrame:
    """A row per shard: ids, and for each block its codes and its dictionary of whole numbers."""

    def encoded(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(parts)
        codes, entries = [], []
        for a in range(0, dims, width):
            own = np.ascontiguousarray(values[:, a:a + width])
            keys, code = np.unique(own.view([("", np.int64)] * own.shape[1]).ravel(), return_inverse=True)
            entries.append(keys.view(np.int64).astype(np.int32).tobytes())
            codes.append(code.astype(np.uint16 if len(keys) <= 1 << 16 else np.uint32).tobytes())
        ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([codes], pa.list_(pa.binary())),
                                           pa.array([entries], pa.list_(pa.binary()))], ["ids", "codes", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            values = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, dims)
            at = 0
            while at < batch.num_rows:
                take = min(shard - held, batch.num_rows - at)
                ids.append(batch.column(0).slice(at, take))
                parts.append(values[at:at + take])
                held, at = held + take, at + take
                if held == shard:
                    yield encoded(ids, parts)
                    ids, parts, held = [], [], 0
        if held:
            yield encoded(ids, parts)

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"ids array<{kind}>, codes array<binary>, entries array<binary>")


class _Shard:
    """One shard in a task."""

    def __init__(self, batch: pa.RecordBatch, k: int, dims: int, width: int) -> None:
        self.ids = batch.column(0).slice(k, 1).flatten()
        self.widths = [min(width, dims - a) for a in range(0, dims, width)]
        entries = batch.column(2)[k].as_py()
        self.entries = [np.frombuffer(e, dtype=np.int32).reshape(-1, w).astype(np.int64) for e, w in zip(entries, self.widths)]
        self.codes = [np.frombuffer(c, dtype=np.uint16 if len(e) <= 1 << 16 else np.uint32) for c, e in zip(batch.column(1)[k].as_py(), self.entries)]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and the squared distance to it."""
        parts, at = [], 0
        for entry, w in zip(self.entries, self.widths):  # entries x centroids, exact
            own = centroids[:, at:at + w]
            parts.append(sum((entry[:, j, None] - own[None, :, j]) ** 2 for j in range(w)))
            at += w
        cluster, distance = np.empty(len(self.ids), np.int64), np.empty(len(self.ids), np.int64)
        for a in range(0, len(self.ids), STEP):
            total = np.zeros((len(self.codes[0][a:a + STEP]), len(centroids)), dtype=np.int64)
            for part, code in zip(parts, self.codes):
                total += part[code[a:a + STEP]]
            cluster[a:a + STEP] = total.argmin(axis=1)
            distance[a:a + STEP] = total.min(axis=1)
        return cluster, distance

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """For each cluster its number of vectors and the sums of their components, by counts of codes."""
        out = [np.bincount(cluster, minlength=k)[:, None]]
        for entry, code in zip(self.entries, self.codes):
            counts = np.bincount(cluster * len(entry) + code, minlength=k * len(entry)).reshape(k, len(entry))
            out.append(counts @ entry)
        return np.concatenate(out, axis=1)


def _first(rows: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The vectors with the smallest digests of their ids; equal digests go by the vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    found = rows.withColumn("digest", digest).orderBy("digest", "embedding").limit(k).collect()  # k vectors
    return np.array([[math.floor(scale * float(x)) for x in r["embedding"]] for r in found], dtype=np.int64)


def cluster_vectors(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, shard: int = SHARD,
                    width: int = WIDTH) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable row of (vec_id, embedding).

    Usable are vectors of exactly ``dims`` components that are neither null nor NaN or infinite and, times ``scale``, below 2^27;
    other rows are left out. Components become ``floor(scale * x)`` and all arithmetic is exact. Rows of null or repeated ids count each;
    a null id is hashed as ``null``. With fewer than ``k`` usable vectors there are as many centroids as vectors; without any there are
    no rows. Equal first centroids are allowed: the later one stays empty and where it is. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").filter(_usable("embedding", dims, scale))
    centroids = _first(rows, k, seed, scale)
    k = len(centroids)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not k:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    shards = cut(_shards(rows, dims, scale, shard, width), "shards")

    def totals(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=np.int64)
        for batch in batches:
            for j in range(batch.num_rows):
                own = _Shard(batch, j, dims, width)
                total += own.sums(own.nearest(centroids)[0], k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dims + 1)), pa.array(np.tile(np.arange(dims + 1), k)), pa.array(total.ravel())],
                                         ["cluster", "place", "total"])

    for _ in range(rounds):
        now = centroids
        found = shards.mapInArrow(lambda b, now=now: totals(b, now), "cluster long, place long, total long")
        found = found.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k * (dims + 1) rows
        table = {(r["cluster"], r["place"]): int(r["total"]) for r in found}
        centroids = np.array([[table[c, j + 1] // table[c, 0] for j in range(dims)] if table.get((c, 0)) else now[c].tolist() for c in range(k)], dtype=np.int64)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                own = _Shard(batch, j, dims, width)
                cluster, distance = own.nearest(centroids)
                yield pa.RecordBatch.from_arrays([own.ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = cut(shards.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long"), "assigned")
    wide = F.col("distance").cast("decimal(38,0)")
    inertia = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster").agg(F.sum(wide).alias("total")).collect()}  # k rows
    whole = sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(c, inertia[c] if inertia[c] < 1 << 63 else None, whole if whole < 1 << 63 else None, names[c]) for c in sorted(inertia)]
    final = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(final), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
