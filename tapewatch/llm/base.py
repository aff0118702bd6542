"""Word hashing on whole Arrow buffers, and connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.session import cut

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 borders of its rows; a null row is empty."""
    column = column.cast(pa.binary()) if pa.types.is_string(column.type) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    borders = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[borders[0]:borders[-1]], borders - borders[0]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and the words of each row."""
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = borders[:-1][borders[:-1] < len(data)]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, borders))
    hashes, at = [], 0
    while at < len(starts):  # a segment is cut in front of a word
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SEGMENT)))
        end = starts[to] if to < len(starts) else len(data)
        own, begin = word[starts[at]:end], starts[at:to] - starts[at]
        place = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
        place[~own] = 0
        value = (_LOWER[data[starts[at]:end]] + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
        value[~own] = 0
        size = np.add.reduceat(own.astype(np.uint64), begin)
        hashes.append(mix(np.add.reduceat(value, begin) + size * np.uint64(0xD1B54A32D192ED03)))
        at = to
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def shingle_sets(data: np.ndarray, borders: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row's ``words``-word shingles, row after row, and the n + 1 borders.

    A row with fewer words has its whole sequence as the only shingle, a row without words has none.
    """
    hashes, counts = word_hashes(data, borders)
    odd = np.uint64(2) * _powers(words + 2)[1:] + np.uint64(1)
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    left = ends[row] - np.arange(len(hashes))  # words from here to the end of the row
    total = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(words):
        there = left > k
        total[there] += hashes[np.flatnonzero(there) + k] * odd[k]
    whole = np.minimum(counts, words)[row].astype(np.uint64)
    keep = (left >= words) | ((counts[row] < words) & (left == counts[row]))
    total, row = mix(total + whole * odd[words])[keep], row[keep]
    borders = np.searchsorted(row, np.arange(len(counts) + 1))
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        total[a:b].sort()
    keep = np.ones(len(total), dtype=bool)
    keep[1:] = (total[1:] != total[:-1]) | (row[1:] != row[:-1])
    return total[keep], np.searchsorted(row[keep], np.arange(len(counts) + 1))


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of a text column, or of one row where a text is longer."""
    for batch in batches:
        _, borders = byte_views(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(borders, borders[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


#: Bits of a membership filter: 1 MiB, whatever the size of the table that it stands for.
FILTER_BITS = 1 << 23


def only_members(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in ``keys``, to be done before a join that shuffles wide rows.

    The filter has a fixed size: a bit for each hash value. The more keys there are, the more other rows pass;
    no row that has a partner is lost.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = (keys.select(bit.alias("bit")).groupBy(F.expr("bit div 32").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).collect())  # FILTER_BITS / 32 rows at most
    table = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    table[[r["word"] for r in words]] = np.array([r["bits"] for r in words], dtype=np.uint64).astype(np.uint32)
    raw, last = table.tobytes(), len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            there = batch.filter(pa.array(own[batch.column(last).to_numpy()]))
            yield there.select(range(last))

    return rows.withColumn("filter_bit", bit).mapInArrow(run, rows.schema)


def smallest_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links between the places 0..n-1, the smallest place that each one reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = smallest_reachable(place[:len(a)], place[len(a):], len(nodes))
        own = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (two columns of non-null longs) reaches.

    Every task first shrinks its links to a forest. Then alternate steps tie the larger neighbours of each node, and
    next its smaller ones, to the smallest of all, until stars remain. A node's neighbours are never gathered: minima
    are aggregated and joined back, and a hot node's join is split like any skewed join.
    A link of a node to itself does not count; no links give no rows.
    """
    a, b = links.columns
    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).mapInArrow(_forests, "u long, v long"), "forest")
    before = _state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)
