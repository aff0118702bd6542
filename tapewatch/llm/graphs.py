"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class first. The classes of a label are dealt to shards of a bounded number of rows; a task builds a
shard's graph. Then every vector queries every shard of its label: a unit of work is a pair of shards, each
querying the other's graph. A beam grows for each query until it holds a vector below the threshold, and for the unit until
an audit passes: a sample of its queries is compared with all vectors of the shard, and where a link is missing, the
beam doubles, in the end to the whole shard. Links count only after their cosine is verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.base import components, mix, smallest_reachable
from tapewatch.session import cut

#: Neighbours of a node, at most; on the lowest layer twice as many. Beams for building and, to begin with, searching.
NEIGHBOURS, BUILD_BEAM, BEAM = 16, 64, 48
#: Rows of a shard on average; queries that a unit audits, and the share of their links that a beam has to find.
SHARD_ROWS, AUDITED, RECALL = 8_192, 256, 0.998
_BATCH = 256


class Graph:
    """A navigable small-world graph over unit vectors, built in batches."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.x = vectors
        n = len(vectors)
        draw = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        self.level = np.minimum(-np.log(np.maximum(draw, 1e-300)) / np.log(NEIGHBOURS), 12).astype(int)
        self.order = np.argsort(-self.level, kind="stable")  # high layers first, so that the entry stays
        self.links = [np.full((n, NEIGHBOURS * (2 if k == 0 else 1)), -1, dtype=np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self._build()

    def _near(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.einsum("qd,qkd->qk", q, self.x[ids])

    def walk(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found from the entries, nearest first: (ids, similarities); -1 where there are none."""
        n, links = len(self.x), self.links[layer]
        width = max(4, beam // 16)
        seen = np.zeros((len(q), n), dtype=bool)
        rows = np.arange(len(q))[:, None]
        seen[rows, entry] = True
        ids = np.full((len(q), beam), -1, dtype=np.int64)
        sims = np.full((len(q), beam), -2.0, dtype=np.float32)
        open_ = np.zeros((len(q), beam), dtype=bool)
        k = min(beam, entry.shape[1])
        first = self._near(q, entry)
        best = np.argsort(-first, axis=1)[:, :k]
        ids[:, :k], sims[:, :k], open_[:, :k] = entry[rows, best], first[rows, best], True
        live = np.arange(len(q))
        while len(live):
            at = live[:, None]
            pick = np.argsort(~open_[live], axis=1, kind="stable")[:, :width]  # beams are sorted, so the nearest open ones
            chosen = open_[at, pick]
            open_[at, pick] = False
            near = links[np.where(chosen, ids[at, pick], 0)]
            near = np.where(chosen[:, :, None], near, -1).reshape(len(live), -1).astype(np.int64)
            near.sort(axis=1)
            fresh = (near >= 0) & ~seen[at, np.maximum(near, 0)]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            most = int(fresh.sum(axis=1).max(initial=0))
            if most:
                put = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
                near, fresh = np.take_along_axis(near, put, 1), np.take_along_axis(fresh, put, 1)
                r, c = np.nonzero(fresh)
                seen[live[r], near[r, c]] = True
                sim = np.full(near.shape, -2.0, dtype=np.float32)
                sim[r, c] = np.einsum("kd,kd->k", q[live[r]], self.x[near[r, c]])
                all_sims = np.concatenate([sims[live], sim], axis=1)
                all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
                all_open = np.concatenate([open_[live], fresh], axis=1)
                top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_sims, top, 1), axis=1, kind="stable"), 1)
                sims[live], ids[live] = np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_ids, top, 1)
                open_[live] = np.take_along_axis(all_open, top, 1)
            live = live[open_[live].any(axis=1)]
        return ids, sims

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, many: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those that are nearer to the row's node than to any chosen before."""
        x = self.x[np.maximum(ids, 0)]
        between = np.einsum("rad,rbd->rab", x, x)
        taken = np.zeros(ids.shape, dtype=bool)
        nearest = np.full(ids.shape, -2.0, dtype=np.float32)
        count = np.zeros(len(ids), dtype=int)
        for k in range(ids.shape[1]):
            good = (ids[:, k] >= 0) & (count < many) & (nearest[:, k] < sims[:, k])
            taken[:, k] = good
            count += good
            nearest[good] = np.maximum(nearest[good], between[good, k])
        rest = (ids >= 0) & ~taken  # places that are left go to the nearest others
        put = np.argsort(np.where(taken, 0, np.where(rest, 1, 2)), axis=1, kind="stable")[:, :many]
        out = np.take_along_axis(np.where(taken | rest, ids, -1), put, 1)
        return np.pad(out, ((0, 0), (0, many - out.shape[1])), constant_values=-1)

    def _tie(self, nodes: np.ndarray, near: np.ndarray, layer: int) -> None:
        """Links nodes with their chosen neighbours, both ways; full lists are chosen anew."""
        links = self.links[layer]
        links[nodes, :near.shape[1]] = near
        a, b = np.repeat(nodes, near.shape[1]), near.ravel()
        a, b = a[b >= 0], b[b >= 0]
        for at in range(0, len(b), 1 << 15):
            targets, place = np.unique(b[at:at + (1 << 15)], return_inverse=True)
            added = a[at:at + (1 << 15)]
            order = np.argsort(place, kind="stable")
            number = np.arange(len(order)) - np.repeat(np.flatnonzero(np.append(True, np.diff(place[order]) != 0)), np.bincount(place))
            wide = np.full((len(targets), int(number.max()) + 1), -1, dtype=np.int64)
            wide[place[order], number] = added[order]
            both = np.concatenate([links[targets].astype(np.int64), wide], axis=1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.where(both >= 0, self._near(self.x[targets], np.maximum(both, 0)), -2.0)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :4 * links.shape[1]]
            both, sims = np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1)
            full = (both >= 0).sum(axis=1) > links.shape[1]
            links[targets[~full]] = np.pad(both, ((0, 0), (0, max(0, links.shape[1] - both.shape[1]))), constant_values=-1)[~full, :links.shape[1]]
            if full.any():
                links[targets[full]] = self._diverse(both[full], sims[full], links.shape[1])

    def _build(self) -> None:
        n, done = len(self.x), 1
        self.entry = int(self.order[0]) if n else 0
        while done < n:
            nodes = self.order[done:done + min(_BATCH, done)]
            q = self.x[nodes]
            entry = np.full((len(nodes), 1), self.entry, dtype=np.int64)
            own = q @ q.T
            np.fill_diagonal(own, -2.0)
            for layer in range(len(self.links) - 1, -1, -1):
                here = self.level[nodes] >= layer
                ids, sims = self.walk(q, entry, BUILD_BEAM if here.any() else 1, layer)
                entry = np.where(ids[:, :4] >= 0, ids[:, :4], ids[:, :1])
                if here.any():
                    mates = np.where(here[None, :], own, -2.0)
                    k = min(16, len(nodes))
                    top = np.argsort(-mates, axis=1)[:, :k]
                    mate_sims = np.take_along_axis(mates, top, 1)
                    both = np.concatenate([ids, np.where(mate_sims > -2, nodes[top], -1)], axis=1)
                    all_sims = np.concatenate([sims, mate_sims], axis=1)
                    order = np.argsort(-all_sims, axis=1, kind="stable")
                    both, all_sims = np.take_along_axis(both, order, 1)[here], np.take_along_axis(all_sims, order, 1)[here]
                    self._tie(nodes[here], self._diverse(both, all_sims, NEIGHBOURS), layer)
            done += len(nodes)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(q), 1), self.entry, dtype=np.int64)
        for layer in range(len(self.links) - 1, 0, -1):
            entry = self.walk(q, entry, 1, layer)[0]
        return self.walk(q, entry, beam, 0)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of at least this similarity that beams find; a beam that is full of them doubles."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo, n = np.arange(len(q)), len(self.x)
        while len(todo):
            if beam >= n:  # as wide as the shard: all of it
                for at in range(0, len(todo), 512):
                    r, c = np.nonzero(q[todo[at:at + 512]] @ self.x.T >= least)
                    found.append((todo[at:at + 512][r], c))
                break
            full = []
            step = max(16, min(_BATCH, (1 << 16) // beam))
            for at in range(0, len(todo), step):
                own = todo[at:at + step]
                ids, sims = self.search(q[own], beam)
                more = sims[:, -1] >= least
                full.append(own[more])
                r, c = np.nonzero((sims >= least) & ~more[:, None])
                found.append((own[r], ids[r, c]))
            todo = np.concatenate(full)
            beam *= 4
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


def audited_links(one: Graph, other: Graph, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of at least this similarity between two shards, or within one; found from either side is found. Beams widen
    until they find enough of the links of a sample of queries, which is compared with the whole other shard."""
    n, beam = len(other.x), BEAM
    sample = np.unique(np.linspace(0, len(one.x) - 1, min(AUDITED, len(one.x))).astype(int))
    r, c = np.nonzero(one.x[sample] @ other.x.T >= least + 1e-5)
    true = sample[r] * n + c
    if one is other:
        true = true[sample[r] != c]
    while True:
        a, b = other.within(one.x, least, beam)
        d, e = (b, a) if one is other else one.within(other.x, least, beam)[::-1]
        pairs = np.unique(np.concatenate([a, d]) * n + np.concatenate([b, e]))
        if beam >= max(n, len(one.x)) or np.isin(true, pairs).sum() >= RECALL * len(true):
            return pairs // n, pairs % n
        beam *= 2


def _unit(raw: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(raw, dtype=np.float64).reshape(-1, dim)
    return whole, (whole / np.linalg.norm(whole, axis=1)[:, None]).astype(np.float32)


_SHARD = "label long, dim int, shard int, ids binary, copies binary, vectors binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the rows of each (label, dim, shard) of a sorted partition."""
    names = [c.split()[0] for c in _SHARD.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    key, held = None, []

    def done() -> pa.RecordBatch:
        ids, copies, vectors = zip(*held)
        raw = [np.array(ids, dtype=np.int64).tobytes(), np.array(copies, dtype=np.int64).tobytes(), np.array(vectors, dtype=np.float64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*key, *raw], kinds)], names)

    for batch in batches:
        for label, dim, shard, vec, copies, vector in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (label, dim, shard):
                if held:
                    yield done()
                key, held = (label, dim, shard), []
            held.append((vec, copies, vector))
    if held:
        yield done()


def _exact(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose cosine, in double precision, reaches the threshold."""
    length_a, length_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    good = [np.einsum("kd,kd->k", a[r[k:k + 65536]], b[c[k:k + 65536]]) / (length_a[r[k:k + 65536]] * length_b[c[k:k + 65536]]) >= threshold
            for k in range(0, len(r), 65536)]
    keep = np.concatenate(good) if good else np.zeros(0, bool)
    return r[keep], c[keep]


def _queries(threshold: float):
    """Links of each pair of shards: (vec, links, root); both query each other's graph."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, one, two, *raw = (batch.column(k)[row].as_py() for k in range(9))
                ids_a, copies_a, ids_b, copies_b = (np.frombuffer(raw[k], dtype=np.int64) for k in (0, 1, 3, 4))
                a, unit_a = _unit(raw[2], dim)
                b, unit_b = _unit(raw[5], dim)
                graph = Graph(unit_a)
                r, c = audited_links(graph, graph if one == two else Graph(unit_b), threshold - 1e-5)
                if one == two:
                    r, c = r[r != c], c[r != c]
                r, c = _exact(a, b, r, c, threshold)
                ids = np.concatenate([ids_a, ids_b])
                links = np.zeros(len(ids), dtype=np.int64)
                np.add.at(links, r, copies_b[c])
                if one != two:
                    np.add.at(links, len(a) + c, copies_a[r])
                # a forest stands for all links
                root = smallest_reachable(r, c + (0 if one == two else len(a)), len(ids))
                keep = np.flatnonzero(links if one != two else np.append(links[:len(a)], np.zeros(len(b), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(links[keep]), pa.array(ids[root[keep]])], ["vec", "links", "root"])
    return run


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.98, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per vector: its id, n_links (other vectors linked with it), component_id (smallest id reachable by links,
    itself included) and kept (whether it is that one).

    Vectors of equal, non-null labels link where their cosine in double precision is at least ``threshold``. Vectors that
    are null, empty or zero, or hold null or non-finite components, have no links, nor have rows with a null id, whose
    component is null and which aren't kept. Vectors of different lengths don't link. Rows that repeat an id are vectors of
    their own that share it. An empty table gives no rows; other columns are ignored. A link can only be missed if all
    beams on both sides miss it; every unit of work audits a sample against all its vectors.
    """
    v = F.col("v")
    whole = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & fine & (norm > 0) & (norm < float("inf")), F.lit(False))
    valid = whole.filter(good).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0 is 0
    classes = cut(valid.groupBy("label", "v").agg(F.min("id").alias("vec"), F.count("*").alias("copies")), "classes")
    sized = classes.withColumn("dim", F.size("v"))
    counts = cut(sized.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "counts")
    dealt = sized.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("vec"), "shards").cast("int"))
    dealt = dealt.select("label", "dim", "shard", "vec", "copies", "v")
    shards = cut(dealt.repartition("label", "dim", "shard").sortWithinPartitions("label", "dim", "shard", "vec").mapInArrow(_shards, _SHARD), "shards")
    one, two = (shards.select("label", "dim", *[F.col(c).alias(f"{c}_{n}") for c in ("shard", "ids", "copies", "vectors")]) for n in "ab")
    units = one.join(two, ["label", "dim"]).filter("shard_a <= shard_b")
    # a partition for each pair of shards, as far as the cluster's setting goes
    many = counts.agg(F.sum(F.col("shards") * (F.col("shards") + 1) / 2)).first()[0] or 1
    units = units.select("dim", "shard_a", "shard_b", "ids_a", "copies_a", "vectors_a", "ids_b", "copies_b", "vectors_b").repartition(max(1, min(int(many), 100_000)))
    found = cut(units.mapInArrow(_queries(threshold), "vec long, links long, root long"), "found")
    tied = components(found.filter("vec <> root").select("vec", "root")).select(F.col("node").alias("vec"), "label").withColumnRenamed("label", "least")
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    known = classes.join(links, "vec", "left").join(tied, "vec", "left")
    known = known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "vec").alias("component_id"))
    linked = valid.join(known, ["label", "v"]).select("id", "n_links", "component_id")
    alone = whole.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionAll(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
