"""Packs token pieces into sequences of a fixed capacity: dominance reduction, then best fit.

A piece only matters by its length, so the whole instance is a count for each length: at most ``capacity`` rows,
however many documents there are. The plan is made from those counts: sets of up to three pieces that provably
dominate every alternative for their largest piece (Martello and Toth) are fixed, which shrinks the instance, and what is
left goes by best fit in order of decreasing length, many equal sequences at a time. Spark then ranks the
pieces of each length and gives the k-th one the k-th place that the plan holds for that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.llm.tokens import encoded
from tapewatch.llm.totals import before
from tapewatch.session import cut

Bins = list[tuple[int, tuple[int, ...]]]


def _pieces(path: str, drops_space: bool, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, borders in encoded(batches, path, drops_space, end_id):
            size = np.diff(borders)
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(rows)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            at = borders[row] + start
            raw = ids.astype("<u4").tobytes()
            blobs = [raw[4 * a:4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[r] for r in row.tolist()], pa.int64()), pa.array(piece.astype(np.int32)),
                 pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(blobs, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"])
    return run


def pieces(docs: DataFrame, tokenizer: str, drops_space: bool, end_id: int = 0, capacity: int = 2048,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's token ids with ``end_id`` behind them, cut where longer
    than ``capacity``; ids are little-endian unsigned 32-bit integers.

    A null or empty text is the end id alone. Null ids and repeated rows give pieces of their own; an empty table gives none.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, drops_space, end_id, capacity),
                           "doc_id long, piece int, start long, length long, ids binary")


def reduce_by_dominance(counts: Mapping[int, int], capacity: int) -> tuple[Bins, Counter]:
    """(fixed, left): sequences that some best packing has, as (how many, lengths), and the counts that remain.

    For the longest piece x that is left, with companions from the other pieces: nothing fits: x alone. The
    longest fitting y fills the sequence, or only one companion ever fits: x with y. At most two fit, and y is as long as
    any fitting pair: x with y; or the longest fitting pair has y, and no fitting pair's shorter one is longer
    than its other piece: all three. In each case the companions of x in any packing can change places with
    the chosen ones, so fixing the set costs nothing.
    """
    left = Counter({n: c for n, c in counts.items() if c > 0})
    lengths = sorted(left)
    fixed: Bins = []

    def take(many: int, parts: tuple[int, ...]) -> None:
        fixed.append((many, parts))
        for n in parts:
            left[n] -= many
            if not left[n]:
                del left[n]
                lengths.pop(bisect_left(lengths, n))

    def smallest(k: int, x: int) -> list[int]:
        """The k smallest pieces besides one x."""
        out: list[int] = []
        for n in lengths:
            out += [n] * min(k - len(out), left[n] - (n == x))
            if len(out) == k:
                break
        return out

    def longest(room: int, without: Counter) -> int:
        """The longest piece of at most ``room`` that is left beside ``without``; 0 if none."""
        k = bisect_left(lengths, room + 1) - 1
        while k >= 0 and left[lengths[k]] <= without[lengths[k]]:
            k -= 1
        return lengths[k] if k >= 0 else 0

    k = len(lengths) - 1
    while k >= 0:
        x = lengths[k]
        room = capacity - x
        low = smallest(3, x)
        y = longest(room, Counter([x]))
        if not low or low[0] > room:
            take(left[x], (x,))
        elif y == room or sum(low[:2]) > room or len(low) == 1:
            take(left[x] // 2 if y == x else min(left[x], left[y]), (x, y))
        elif len(low) == 2 or sum(low) > room:
            best = (0, 0, 0)
            for a in lengths[:bisect_left(lengths, room)]:
                b = longest(min(room - a, a), Counter([x, a]))
                if left[a] > (a == x) and b:
                    best = max(best, (a + b, a, b))
            half = longest(room // 2, Counter([x]))
            if y >= best[0]:
                take(1, (x, y))
            elif best[1] == y and half <= best[2]:
                take(1, (x, *best[1:]))
            else:
                k -= 1
                continue
        else:
            k -= 1
            continue
        k = min(k, len(lengths) - 1)
        while k + 1 < len(lengths) and lengths[k + 1] <= x and lengths[k + 1] in left:
            k += 1
    return fixed, left


def best_fit(counts: Mapping[int, int], capacity: int) -> Bins:
    """Best-fit decreasing on counts: equal sequences are filled at once."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(room: int, many: int, parts: tuple[int, ...]) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((many, parts))

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                fit = capacity // n
                if todo >= fit:
                    put(capacity - fit * n, todo // fit, (n,) * fit)
                if todo % fit:
                    put(capacity - todo % fit * n, 1, (n,) * (todo % fit))
                break
            room = rooms[at]
            many, parts = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            fit = min(room // n, todo)
            full = min(many, todo // fit)
            put(room - fit * n, full, parts + (n,) * fit)
            if many > full:
                put(room, many - full, parts)
            todo -= full * fit
    return [b for room in rooms for b in by_room[room]]


def plan(counts: Mapping[int, int], capacity: int) -> Bins:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _places(bins: Bins) -> dict[int, np.ndarray]:
    """For each length the places held for it, in runs: (first rank, first sequence, pieces a sequence, offset)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    given: Counter = Counter()
    sequence = 0
    for many, parts in bins:
        offset = 0
        for n, times in Counter(parts).items():
            runs.setdefault(n, []).append((given[n], sequence, times, offset))
            given[n] += many * times
            offset += n * times
        sequence += many
    return {n: np.array(r, dtype=np.int64).T for n, r in runs.items()}


def _place(places: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, start, times, begin = places[n]
                k = np.searchsorted(first, rank[at], side="right") - 1
                within = rank[at] - first[k]
                sequence[at] = start[k] + within // times[k]
                offset[at] = begin[k] + within % times[k] * n
            keep = [k for k, f in enumerate(batch.schema) if f.name not in ("rank", "chunk")]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(sequence), pa.array(offset)],
                                             [batch.schema.field(k).name for k in keep] + ["sequence_id", "offset"])
    return run


def pack(parts: DataFrame, capacity: int = 2048, chunk_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset (long) to rows that have a doc_id, a piece and a length of 1 to ``capacity``.

    Every row lies in one sequence, gapless from 0, in as few sequences as the plan finds. Needs columns of these names;
    others stay. Ties and repeated rows get places of their own. An empty table gives no rows.
    """
    parts = cut(parts, "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    bad = [n for n in counts if n is None or not 1 <= n <= capacity]
    if bad:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    chunks = max(1, -(-sum(counts.values()) // chunk_rows))
    keyed = parts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks))).withColumn("one", F.lit(1))
    ranked = before(keyed, "length", "chunk", ["doc_id", "piece"], "one", "rank").withColumn("rank", F.col("rank").cast("long")).drop("one")
    kept = [f for f in ranked.schema.fields if f.name not in ("rank", "chunk")]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_place(_places(plan(counts, capacity))), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed pieces' ids put together; a sequence has at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("p"))
    whole = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.ids))
    return joined.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x.length).alias("n_tokens"), whole.alias("ids"))
