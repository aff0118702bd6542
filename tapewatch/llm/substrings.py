"""Removes byte strings of a given length that occur more than once in a corpus, by hash-compared suffix sorting.

A suffix array of a whole corpus is no table that a task could hold, so suffixes are first parted in such a way that two
which share ``length`` bytes meet. Every window of that length is owned by one anchor in its front part: the place
whose 8 bytes hash lowest there. Equal windows have equal anchors at equal distances. An anchor's key is the hash of the
KEY_BYTES bytes behind it; only anchors whose key comes again are followed up. They meet by key with as much text
around them as their windows reach, and there the windows' suffixes are sorted:

* A prefix sum of polynomial hashes gives the hash of any stretch of bytes at once, so the common extension of two suffixes
  is found by binary search, and comparing two takes logarithmic time.
* Suffixes at the same distance from the same key are merge-sorted by that comparison, all such lists together.
* Neighbours whose common extension reaches ``length`` are compared byte by byte before they count.

Keys with very many occurrences are parted further, by the bytes which the windows of one half of the
distances, and those of the other half, have in common, until lists are short or all windows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.base import byte_views, mix, pieces
from tapewatch.session import cut

KEY_BYTES, GRAM = 100, 8
#: Most occurrences of a key in one task; bytes around anchors that one task takes at a time, and windows that it sorts at a time.
CROWD, TOGETHER, WINDOWS = 20_000, 1 << 18, 1 << 17
#: Bytes of texts from which anchors are chosen at a time.
_SEGMENT = 1 << 18
_ODD, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Prints:
    """Polynomial hashes of any stretch of ``data``, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        self.back = _series(_INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _series(_ODD, len(data)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]


def anchors(data: np.ndarray, borders: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, place, nearest, farthest, key) of the anchors of all windows; an anchor's windows start from ``farthest`` to
    ``nearest`` bytes in front of it."""
    front = length - KEY_BYTES + 1  # starts from which a window's anchor is chosen
    parts = []
    ends = np.repeat(borders[1:], np.diff(borders))
    for at in range(0, max(len(data) - length + 1, 0), _SEGMENT):
        own = data[at:at + _SEGMENT + length]
        n = len(own) - length + 1  # windows of this segment, but for those that cross a border
        n = min(n, _SEGMENT)
        gram = np.zeros(n + front - 1, dtype=np.uint64)
        for k in range(GRAM):
            gram |= own[k:k + len(gram)].astype(np.uint64) << np.uint64(8 * k)
        low = (mix(gram) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= front:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[front - width:front - width + n])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(at + np.arange(n) + length <= ends[at:at + n])
        if not len(start):
            continue
        place = place[start]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        where = place[first]
        key = mix(Prints(own)(where, KEY_BYTES))
        parts.append((at + where, where - start[last], where - start[first], key))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    where, near, far, key = (np.concatenate(x) for x in zip(*parts))
    row = np.searchsorted(borders, where, side="right") - 1
    return row, where - borders[row], near, far, key


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, _SEGMENT):
            row, place, near, far, key = anchors(*byte_views(batch.column(1)), length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(place.astype(np.int32)),
                 pa.array(near.astype(np.int16)), pa.array(far.astype(np.int16))], ["key", "print", "place", "near", "far"])
    return run


def _contexts(length: int):
    """The bytes that an anchor's windows reach; anchors of one text that look the same share a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            out: list[tuple] = []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for print_, text, found in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                same: dict[tuple, list[int]] = {}
                for f in found:
                    p = f["place"]
                    around = text[p - f["far"]:p + length - f["near"]]
                    same.setdefault((f["key"], f["near"], f["far"], around), []).append(p)
                out += [(*k, print_, places) for k, places in same.items()]
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                             ["key", "near", "far", "around", "print", "places"])
    return run


_CONTEXT = "key long, near short, far short, around binary, print long, places array<int>"


class _Sorter:
    """Sorts suffixes of ``data`` by their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        self.data, self.length, self.prints = data, length, Prints(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes share, up to ``length``."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.length)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) >> 1
            same = self.prints(a, middle) == self.prints(b, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b, or, where asked for, equals it."""
        out = or_equal.copy()
        rest = np.flatnonzero(self.whole[a] != self.whole[b])
        x, y = self.start[a[rest]], self.start[b[rest]]
        shared = self.common(x, y)
        end = shared >= self.length
        shared = np.minimum(shared, self.length - 1)
        out[rest] = np.where(end, or_equal[rest], self.data[x + shared] < self.data[y + shared])
        return out

    def sort(self, start: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, same): suffix numbers by bucket and content, and whether each equals the one in front of it."""
        self.start, self.whole = start, self.prints(start, self.length)
        order = np.argsort(bucket, kind="stable")
        sorted_bucket = bucket[order]
        first = np.flatnonzero(np.append(True, sorted_bucket[1:] != sorted_bucket[:-1])) if len(order) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(order)))
        width = 1
        while len(sizes) and width < sizes.max():
            big = np.flatnonzero(sizes > width)  # lists that are not sorted yet
            base = np.repeat(first[big], sizes[big])
            size = np.repeat(sizes[big], sizes[big])
            at = np.arange(len(base)) - np.repeat(np.cumsum(sizes[big]) - sizes[big], sizes[big])
            own = order[base + at]
            run = at // width
            left = run % 2 == 0
            begin = (run ^ 1) * width  # the run that this one is merged with
            low = np.zeros(len(at), dtype=np.int64)
            high = np.clip(size - begin, 0, width)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                other = order[base[open_] + begin[open_] + middle]
                goes = self.before(other, own[open_], ~left[open_])
                low[open_] = np.where(goes, middle + 1, low[open_])
                high[open_] = np.where(goes, high[open_], middle)
            order[base + (run // 2) * 2 * width + at % width + low] = own
            width *= 2
        same = np.zeros(len(order), dtype=bool)
        near = np.flatnonzero((sorted_bucket[1:] == sorted_bucket[:-1]) & (self.whole[order[1:]] == self.whole[order[:-1]])) + 1
        for at in range(0, len(near), 4096):  # collisions are found here
            k = near[at:at + 4096]
            steps = np.arange(self.length)
            a, b = start[order[k]][:, None] + steps, start[order[k - 1]][:, None] + steps
            same[k] = (self.data[a] == self.data[b]).all(axis=1)
        return order, same


def _distances(near: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of distances, all of them, of at most ``WINDOWS`` windows each or of one distance; only windows of equal distance are compared."""
    if not len(near):
        return
    base = int(near.min())
    ends = np.zeros(int(far.max()) - base + 2, dtype=np.int64)
    np.add.at(ends, near - base, 1)
    np.add.at(ends, far - base + 1, -1)
    up_to = np.append(0, np.cumsum(np.cumsum(ends)[:-1]))  # windows in front of each distance
    at = 0
    while at < len(up_to) - 1:
        to = max(at + 1, int(np.searchsorted(up_to, up_to[at] + WINDOWS, side="right")) - 1)
        yield base + at, base + to - 1
        at = to


def repeated(around: list[bytes], near: np.ndarray, far: np.ndarray, group: np.ndarray, often: np.ndarray,
             length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of anchors, the least and greatest distance of a window that occurs again; -1 if none does.

    ``often`` counts a context's occurrences: with two, all its windows repeat.
    """
    data = np.frombuffer(b"".join(around), dtype=np.uint8)
    begin = np.append(0, np.cumsum([len(a) for a in around]))[:-1]
    sorter = _Sorter(data, length)
    low, high = np.full(len(around), 1 << 20), np.full(len(around), -1)
    for least, most in _distances(near, far):
        a, b = np.maximum(near, least), np.minimum(far, most)
        count = np.maximum(b - a + 1, 0).astype(np.int64)
        of = np.repeat(np.arange(len(around)), count)
        distance = a[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        _, bucket = np.unique(np.stack([group[of], distance]), axis=1, return_inverse=True)
        start = begin[of] + far[of] - distance
        order, same = sorter.sort(start, bucket.ravel())
        twice = np.zeros(len(of), dtype=bool)
        twice[order[same]] = True
        twice[order[np.flatnonzero(same) - 1]] = True
        twice |= often[of] > 1
        np.minimum.at(low, of[twice], distance[twice])
        np.maximum.at(high, of[twice], distance[twice])
    return np.where(high < 0, -1, low), high


def _matches(length: int):
    """Spans of repeated bytes, from contexts sorted by key; all contexts of a key are in the partition."""
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        names: dict[tuple, int] = {}
        which = [names.setdefault(r[:4], len(names)) for r in rows]  # equal contexts are sorted once
        often = np.bincount(which, weights=[len(r[5]) for r in rows], minlength=len(names))
        contexts = list(names)
        key, near, far = (np.array([c[k] for c in contexts], dtype=np.int64) for k in range(3))
        low, high = repeated([c[3] for c in contexts], near, far, key, often, length)
        spans = [(r[4], p - int(high[w]), p - int(low[w]) + length) for r, w in zip(rows, which) if high[w] >= 0 for p in r[5]]
        columns = list(zip(*spans)) if spans else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))],
                                          ["print", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        load, group, group_load = 0, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    held += group if len(group) > 1 or len(group[0][5]) > 1 else []
                    load += group_load
                    group, group_load = [], 0
                    if load > TOGETHER:
                        yield solve(held)
                        held, load = [], 0
                group.append(row)
                group_load += len(row[3])
        held += group if len(group) > 1 or group and len(group[0][5]) > 1 else []
        if held:
            yield solve(held)
    return run


def _part(contexts: DataFrame, length: int, crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """(contexts, spans): parts keys with more than ``crowd`` rows; spans are those found on the way.

    ``low`` and ``high`` are the distances that a part is about. All windows of a part hold the bytes from its least
    distance in front of the anchor to those that its greatest one leaves behind it, so their hash makes the new key.
    """
    done, spans = None, None
    todo = contexts.withColumns({"low": F.lit(0), "high": F.lit(length)})
    while True:
        crowds = cut(todo.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key"), "crowds")
        if crowds.isEmpty():
            whole = todo if done is None else done.unionAll(todo)
            return whole.drop("low", "high"), spans
        calm = todo.join(crowds, "key", "left_anti")
        done = calm if done is None else done.unionAll(calm)
        # half 0 is about the distances up to the middle of the part's range, half 1 about those beyond
        point = F.floor((F.col("low") + F.least(F.col("high"), F.lit(length - KEY_BYTES))) / 2).cast("int")
        hot = todo.join(crowds, "key", "left_semi")
        hot = hot.withColumn("middle", point)
        lower = hot.withColumns({"high": F.least("high", "middle")})
        upper = hot.withColumns({"low": F.greatest(F.col("low"), F.col("middle") + 1)})
        halves = lower.unionAll(upper).drop("middle").filter("low <= high and near <= high and far >= low")
        a, b = F.greatest(F.col("near").cast("int"), F.col("low")), F.least(F.col("far").cast("int"), F.col("high"))
        around = F.substr("around", F.col("far") - b + 1, b + length - a)
        halves = halves.withColumns({"around": around, "near": a.cast("short"), "far": b.cast("short")})
        halves = halves.filter("near <= far")
        core = F.substr("around", F.col("far") - F.col("low") + 1, F.col("low") + length - F.col("high"))
        halves = cut(halves.withColumn("key", F.xxhash64("key", "low", "high", core)), "halves")
        # a part in which all contexts are one repeats throughout
        same = halves.groupBy("key").agg(F.min("around").alias("a"), F.max("around").alias("b"), F.min("near").alias("c"), F.max("near").alias("d"),
                                         F.min("far").alias("e"), F.max("far").alias("f"), F.sum(F.size("places")).alias("n"))
        same = cut(same.filter("a = b and c = d and e = f and n > 1").select("key"), "same")
        at = halves.join(same, "key", "left_semi").select("print", "near", "far", F.explode("places").alias("p"))
        own = at.select("print", (F.col("p") - F.col("far")).cast("int").alias("start"), (F.col("p") - F.col("near") + length).cast("int").alias("stop"))
        spans = own if spans is None else spans.unionAll(own)
        todo = halves.join(same, "key", "left_anti")


def _cut_out(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            out: list[tuple] = []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for row, text, spans, copies in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = text or b""
                if copies > 1 and len(text) >= length:
                    merged = [[0, len(text)]]
                else:
                    merged = []
                    for s in sorted((s["start"], s["stop"]) for s in spans or []):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                edges = [0, *[x for s in merged for x in s], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((row, len(text), [{"start": a, "stop": b} for a, b in merged], kept))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["id", "n_bytes", "removed", "kept"])
    return run


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, crowd: int = CROWD) -> DataFrame:
    """One row per document: its id, n_bytes, removed (its maximal removed spans, in bytes) and kept (what remains).

    Removed is every byte covered by a ``length``-byte string that starts at another place too, in the same document or
    in any other, judged on the texts as they came in. A kept part may end inside a character. Documents of the same text
    are matched once: each of them is removed whole, if it is long enough. A null text is empty. Null ids and
    repeated rows are documents of their own, an empty table gives no rows, and other columns are ignored.
    ``length`` is at least 200 and at most 30,000.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("print"))
    classes = cut(rows.groupBy("print").agg(F.count("*").alias("copies"), F.min("id").alias("low")), "classes")
    found = rows.filter(F.octet_length("text") >= length).select("print", "text")
    found = cut(found.mapInArrow(_anchors(length), "key long, print long, place int, near short, far short"), "anchors")
    spot = F.xxhash64("print", "place", "near")
    again = found.groupBy("key").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).filter("a <> b").select("key")
    again = cut(again, "again")  # so that the join with a hot key can be split
    hits = found.join(again, "key", "left_semi").groupBy("print").agg(F.collect_set(F.struct("key", "place", "near", "far")).alias("found"))
    one = rows.join(hits.join(classes, "print"), "print").filter(F.col("id").eqNullSafe(F.col("low"))).select("print", "text", "found")
    contexts = cut(one.mapInArrow(_contexts(length), _CONTEXT), "contexts")
    parted, early = _part(contexts, length, crowd)
    spans = parted.repartition("key").sortWithinPartitions("key").mapInArrow(_matches(length), "print long, start int, stop int")
    spans = spans if early is None else spans.unionAll(early)
    spans = spans.groupBy("print").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    whole = cut(classes.select("print", "copies").join(spans, "print", "left"), "spans")
    return rows.join(whole, "print").select("id", "text", "spans", "copies").mapInArrow(
        _cut_out(length), "id long, n_bytes long, removed array<struct<start:int,stop:int>>, kept binary").withColumnRenamed("id", id_col)
