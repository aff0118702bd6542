"""Exact self-join of documents by the Jaccard similarity of their word shingles.

The Jaccard distance is a metric, but unrelated documents all lie at a distance of nearly 1 from each other, so pivots
drawn from a whole corpus separate nothing. The join therefore starts with projections in which near means equal:

* Window by size. ``| |x| - |y| |`` is the difference of the distances (by symmetric difference) to the empty set, so
  linked documents lie in the same class of sizes or in neighbouring ones; a document is copied into the class below.
* In a class, the shingle space is cut in more parts than two linked documents can differ in elements; they agree
  wholly in one part at least. Documents with an equal part share a cell, and cells that share documents are merged
  into regions. Every link lies within a region.
* Passages that many documents share can tie documents that do not link, so a region too large for one task is cut
  again: linked sets share an element among the rarest ``n - ceil(t n) + 1`` of each, rare meaning rare in the region.
  Sets that share none of these part. This is repeated while regions shrink. Elements are counted by Spark, exactly; those
  in one set only stand first in the order and are never posted.
* Regions are joined by pivots: each document belongs to the Voronoi cell of its nearest pivot, and it is copied as
  a guest into every cell whose pivot is at most twice the radius farther away (triangle inequality). So the cell of
  a document holds all its partners. Cells are split again until they are small; a cell that pivots cannot split
  is cut in blocks, and all pairs of blocks are compared. Large regions are split by Spark, small ones inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.base import byte_views, components, mix, only_members, pieces, shingle_sets, smallest_reachable
from tapewatch.session import cut, discard, scratch

#: Largest load of a cell that one task joins: shingles, and as many again as ROW for each document.
CELL_LOAD, ROW = 4_000_000, 1_000
#: Bytes of text whose shingles a task holds at a time; postings that it ties at a time, about.
PIECE, POSTINGS = 1 << 18, 1 << 17
PIVOTS = 16
#: Shares of the shingle names that are shuffled one after the other; only names that several sets have are kept of each.
NAME_SHARES = 4
_CLASSES: dict[tuple[int, int], list[int]] = {}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def size_class(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Class of a set's size; sizes of linked sets are in one class or in neighbouring ones."""
    starts = _CLASSES.setdefault((num, den), [1])
    while starts[-1] <= n.max(initial=1):
        starts.append(starts[-1] * den // num + 1)
    return np.searchsorted(starts, n, side="right") - 1


def _parts(cls: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts for pairs whose smaller set is of a class, and how many empty parts are allowed for."""
    starts = _CLASSES[num, den]
    while len(starts) < int(cls.max(initial=0)) + 2:
        starts.append(starts[-1] * den // num + 1)
    most = (np.array(starts)[cls + 1] - 1) * (den - num) // num  # elements in which two linked sets differ
    spare = np.where(most == 0, 0, 1 + most // 20)
    return most + 1 + spare, spare


def part_keys(sets: np.ndarray, borders: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): linked rows have a key in common."""
    sizes = np.diff(borders)
    rows = np.flatnonzero(sizes)
    own = size_class(sizes, num, den)
    out = []
    for below in (0, 1):
        for_rows = rows[own[rows] >= below]
        cls = own - below
        count, spare = _parts(np.maximum(cls, 0), num, den)
        row = np.repeat(np.arange(len(sizes)), sizes)
        there = np.isin(row, for_rows) if below else np.ones(len(row), bool)
        row, value = row[there], sets[there]
        if not len(row):
            continue
        part = ((value >> np.uint64(32)) * count[row].astype(np.uint64)) >> np.uint64(32)  # grows with the hash
        first = np.ones(len(row), dtype=bool)
        first[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(first)
        total = np.add.reduceat(mix(value + np.uint64(0x632BE59BD9B4E019)), at)
        row, part = row[at], part[at]
        filled = np.bincount(row, minlength=len(sizes))
        for r in for_rows[(count - filled)[for_rows] > spare[for_rows]].tolist():  # rare: its empty parts count too
            empty = np.setdiff1d(np.arange(count[r]), part[row == r].astype(np.int64)).astype(np.uint64)
            row, part = np.append(row, np.full(len(empty), r)), np.append(part, empty)
            total = np.append(total, np.zeros(len(empty), np.uint64))
        label = cls[row].astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + part
        out.append((row, mix(total + mix(label + np.uint64(1)))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _prints(sets: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A 64-bit print of each whole set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
    return mix(total[borders[1:]] - total[borders[:-1]] + np.diff(borders).astype(np.uint64))


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, PIECE):
            sets, borders = shingle_sets(*byte_views(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(borders)), _signed(_prints(sets, borders))], ["id", "n", "print"])
    return run


def _postings(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task posts equal sets once, so copies add no more rows to a key than there are tasks
        for batch in pieces(batches, 0, PIECE):
            sets, borders = shingle_sets(*byte_views(batch.column(0)), words)
            marks = _prints(sets, borders)
            new = np.array([not (m in seen or seen.add(m)) for m in marks.tolist()], dtype=bool)
            sets, borders = sets[np.repeat(new, np.diff(borders))], np.append(0, np.cumsum(np.diff(borders)[new]))
            row, key = part_keys(sets, borders, num, den)
            yield pa.RecordBatch.from_arrays([_signed(key), _signed(marks[new][row])], ["key", "print"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties the prints of a key to the smallest one; a key's rows are all in this task."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    keys, marks = (np.concatenate(x) for x in zip(*parts))
    del parts
    shares = -(-len(keys) // POSTINGS)
    share = (mix(keys.view(np.uint64)) % np.uint64(shares)).astype(np.int32)
    for k in range(shares):
        own = np.flatnonzero(share == k)
        key, mark = keys[own], marks[own]
        order = np.lexsort((mark, key))
        key, mark = key[order], mark[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        low = mark[first][np.cumsum(first) - 1]
        pairs = np.unique(np.stack([mark, low])[:, mark != low], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, PIECE):
            sets, borders = shingle_sets(*byte_views(batch.column(1)), words)
            same = np.flatnonzero(_prints(sets, borders).view(np.int64) == batch.column(0).to_numpy())
            raw = [sets[borders[r]:borders[r + 1]].tobytes() for r in same.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(pa.array(same)) for k in (2, 0, 3)]
                + [pa.array(np.diff(borders)[same]), pa.array(raw, pa.binary()), pa.array(np.ones(len(same), bool)), pa.array(np.zeros(len(same), bool))],
                ["cell", "print", "copies", "n", "shingles", "home", "apart"])
    return run


def _named(cell: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A hash of each shingle that holds in its own cell only."""
    return mix(shingles + mix(cell.view(np.uint64) + np.uint64(0x8CB92BA72F3D8DD7)))


def _names(share: int):
    """(print, name) of every shingle of (cell, print, shingles) whose name is of the share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, PIECE):
            raw, borders = byte_views(batch.column(2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(borders) // 8)
            name = _named(batch.column(0).to_numpy()[row], np.frombuffer(raw.tobytes(), dtype=np.uint64))
            own = np.flatnonzero(name % np.uint64(NAME_SHARES) == share)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row[own])), _signed(name[own])], ["print", "name"])
    return run


def _rare_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): linked sets of a cell are tied, for one of their rarest shingles is the same.

    A set posts its ``n - ceil(t n) + 1`` rarest shingles; those that no other set of the cell has come first and need no post.
    """
    often, shared = F.count("*").over(Window.partitionBy("name")), None
    for share in range(NAME_SHARES):
        names = rows.select("cell", "print", "shingles").mapInArrow(_names(share), "print long, name long")
        part = cut(names.withColumn("often", often).filter("often > 1"), "shared")
        shared = part if shared is None else shared.unionAll(part)
    inner = Window.partitionBy("print")
    shared = shared.withColumn("place", F.row_number().over(inner.orderBy("often", "name"))).withColumn("own", F.count("*").over(inner))
    left = F.col("n") - F.ceil(F.col("n") * num / F.lit(float(den))) + 1 - (F.col("n") - F.col("own"))
    posts = cut(shared.join(rows.select("print", "n"), "print").filter(F.col("place") <= left).select("name", "print"), "posts")
    low = posts.groupBy("name").agg(F.min("print").alias("low"))
    return posts.join(low, "name").filter("print <> low").select(F.col("print").alias("a"), F.col("low").alias("b")).distinct()


class _Cell:
    """Joins the documents of one cell by pivots and windows; links counts the partners of each home document.

    Home documents meet all others of the cell, or guests only where they meet each other in another cell (``apart``).
    """

    def __init__(self, sets: list[np.ndarray], copies: np.ndarray, home: np.ndarray, num: int, den: int, apart: bool = False) -> None:
        self.num, self.den, self.copies = num, den, copies
        self.sizes = np.array([len(s) for s in sets])
        names, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = often > 1
        number = np.cumsum(shared) - 1
        self.width = int(shared.sum())
        borders = np.append(0, np.cumsum(self.sizes))
        self.own = [number[p[shared[p]]] for p in (place[a:b] for a, b in zip(borders[:-1], borders[1:]))]
        self.links = np.zeros(len(sets), dtype=np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self._join(np.flatnonzero(home), np.flatnonzero(~home) if apart else np.arange(len(sets)))

    def _common(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(others)), dtype=np.float32)
        for at in range(0, self.width, 2048):
            a, b = (np.zeros((len(x), min(2048, self.width - at)), dtype=np.float32) for x in (rows, others))
            for matrix, which in ((a, rows), (b, others)):
                for i, r in enumerate(which.tolist()):
                    lo, hi = np.searchsorted(self.own[r], [at, at + 2048])
                    matrix[i, self.own[r][lo:hi] - at] = 1
            out += a @ b.T
        return out

    def _direct(self, rows: np.ndarray, others: np.ndarray) -> None:
        for at in range(0, len(rows), 512):
            block = rows[at:at + 512]
            common = self._common(block, others)
            union = self.sizes[block][:, None] + self.sizes[others][None, :] - common
            linked = self.den * common >= self.num * union
            linked &= block[:, None] != others[None, :]
            self.links[block] += linked @ self.copies[others]
            a, b = np.nonzero(linked)
            low = smallest_reachable(a, b + len(block), len(block) + len(others))  # a forest stands for all links
            both = np.concatenate([block, others])
            tied = low != np.arange(len(both))
            self.pairs.append((both[tied], both[low[tied]]))

    def _join(self, rows: np.ndarray, others: np.ndarray) -> None:
        if len(rows) * len(others) <= 1 << 16:
            return self._direct(rows, others)
        pivots = rows[:: max(1, len(rows) // PIVOTS)]
        far = []
        for which in (rows, others):
            common = self._common(pivots, which)
            far.append(1 - common / np.maximum(self.sizes[pivots][:, None] + self.sizes[which][None, :] - common, 1))
        near = far[0].argmin(axis=0)
        window = far[1] <= far[1].min(axis=0) + 2 * (1 - self.num / self.den) + 1e-6
        cells = [(rows[near == k], others[window[k]]) for k in range(len(pivots))]
        if sum(len(a) * len(b) for a, b in cells) > 0.7 * len(rows) * len(others):
            return self._direct(rows, others)
        for a, b in cells:
            if len(a):
                self._join(a, b)

    def roots(self) -> np.ndarray:
        a, b = (np.concatenate(x) for x in zip(*self.pairs)) if self.pairs else (np.zeros(0, int), np.zeros(0, int))
        return smallest_reachable(a, b, len(self.sizes))


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each cell of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cell = batch.column(0).to_numpy()
        ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)) if len(cell) else []
        at = 0
        for end in ends:
            if held and held[0].column(0)[0].as_py() != cell[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def _join_cells(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            mark, home = table["print"].to_numpy(), table["home"].to_numpy()
            _, keep = np.unique(np.stack([mark, ~home]), axis=1, return_index=True)  # a repeated row counts once
            keep = keep[np.append(True, np.diff(mark[keep]) != 0)]
            sets = _arrays(table["shingles"].take(pa.array(keep)))
            mark, home = mark[keep], home[keep]
            cell = _Cell(sets, table["copies"].to_numpy()[keep], home, num, den, table["apart"][0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(mark[cell.roots()]), pa.array(cell.links)], ["print", "root", "links"])
    return run


def _assign(num: int, den: int):
    """Gives each document its Voronoi cell, and guests' places in the cells within its window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, salt, pivots = None, None, []
        for batch in batches:
            out = []
            rows = zip(*(batch.column(k).to_pylist() for k in range(7)))
            for at, part, kind, mark, copies, raw, home in rows:
                if (at, part) != (cell, salt):
                    cell, salt, pivots = at, part, []
                own = np.frombuffer(raw, dtype=np.uint64)
                if kind == 0:
                    pivots.append((mark, own))
                    continue
                common = np.array([len(np.intersect1d(own, p, assume_unique=True)) for _, p in pivots])
                far = 1 - common / (np.array([len(p) for _, p in pivots]) + len(own) - common)
                for k in np.flatnonzero(far <= far.min() + 2 * (1 - num / den) + 1e-9).tolist():
                    name = int(mix(np.array([cell, pivots[k][0]]).view(np.uint64)[:1] + mix(np.array([pivots[k][0]]).view(np.uint64))).view(np.int64)[0])
                    out.append((name, mark, copies, len(own), raw, home and k == int(far.argmin()), False, cell))
            columns = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.int64()]
            names = ["cell", "print", "copies", "n", "shingles", "home", "apart", "parent"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)
    return run


_CELLS = "cell long, print long, copies long, n long, shingles binary, home boolean, apart boolean"


def _loads(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").agg(F.sum(F.col("n") + ROW).alias("load"))


def _part(cells: DataFrame, num: int, den: int, bound: int) -> DataFrame:
    """Cuts the cells over ``bound`` into sets that rare shingles tie, again and again while a cell loses a third."""
    names = cells.columns
    loads = cut(_loads(cells).filter(F.col("load") > bound), "large")
    done = []
    while not loads.isEmpty():
        done.append(cells.join(loads, "cell", "left_anti").select(*names))
        tied = components(_rare_links(cells.join(loads, "cell"), num, den))
        tied = tied.withColumnRenamed("node", "print")
        made = cells.join(loads, "cell").withColumnRenamed("cell", "parent").join(tied, "print")
        made = cut(made.withColumn("cell", F.xxhash64("parent", "label")).drop("label"), "parted")
        after = made.groupBy("cell").agg(F.sum(F.col("n") + ROW).alias("own"), F.max("load").alias("load"))
        again = after.filter((F.col("own") > bound) & (F.col("own") <= 0.7 * F.col("load")))
        cells, loads = made.select(*names), cut(again.select("cell", F.col("own").alias("load")), "large")
    for part in done:
        cells = cells.unionAll(part)
    return cells


def _split(cells: DataFrame, num: int, den: int, bound: int) -> DataFrame:
    """Splits the cells over ``bound`` by pivots, and cells that pivots don't split by pairs of blocks."""
    names, done = cells.columns, None
    level = 0
    while True:
        big = cut(_loads(cells).filter(F.col("load") > bound), "big")
        if big.isEmpty():
            return cells if done is None else cells.unionAll(done)
        small = cells.join(big, "cell", "left_anti").select(*names)
        salts = F.ceil(F.col("load") / bound).cast("int")
        rows = cells.join(big, "cell").withColumn("salt", F.pmod(F.xxhash64("print"), salts).cast("int"))
        draw = F.xxhash64("print", F.lit(level))
        picked = (rows.filter("home").groupBy("cell", F.pmod(draw, F.lit(PIVOTS)).alias("k"))
                  .agg(F.min(F.struct(draw.alias("d"), "print", "shingles")).alias("p"), F.max("load").alias("load")))
        picked = picked.select("cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"),
                               "p.print", F.lit(0).cast("long").alias("copies"), "p.shingles", F.lit(True).alias("home"))
        rows = picked.unionAll(rows.select("cell", "salt", F.lit(1).alias("kind"), "print", "copies", "shingles", "home"))
        rows = rows.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
        made = cut(rows.mapInArrow(_assign(num, den), _CELLS + ", parent long"), "voronoi")
        loads = made.groupBy("cell", "parent").agg(F.sum(F.col("n") + ROW).alias("own"))
        stuck = (loads.join(big.withColumnRenamed("cell", "parent"), "parent")
                 .filter((F.col("own") > bound) & (F.col("own") > 0.7 * F.col("load"))).select("cell", F.col("own").alias("load")))
        stuck = cut(stuck, "stuck")
        if not stuck.isEmpty():
            count = F.ceil(2 * F.col("load") / bound).cast("int")
            at = made.join(stuck, "cell").withColumn("blocks", count).withColumn("mine", F.pmod(F.xxhash64("print", F.lit(-1)), "blocks").cast("long"))
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("other")  # hashed like mine
            every = at.select("*", other)
            apart = F.col("mine") != F.col("other")  # home documents of one block meet each other in the cell of both their blocks
            home = every.filter("home").withColumns({"cell": F.xxhash64("cell", "mine", "other"), "apart": apart})
            guest = every.filter(apart | ~F.col("home")).withColumns({"cell": F.xxhash64("cell", "other", "mine"), "apart": apart, "home": F.lit(False)})
            blocks = home.select(*names).unionAll(guest.select(*names))
            done = blocks if done is None else done.unionAll(blocks)
            made = made.join(stuck, "cell", "left_anti")
        cells = cut(small.unionAll(made.select(*names)), "cells")
        level += 1


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                 threshold: tuple[int, int] = (4, 5), cell_load: int = CELL_LOAD) -> DataFrame:
    """One row per document: its id, n_shingles, n_links (other documents linked with it) and component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. A document's set holds its distinct ``words``-word
    shingles, or its whole sequence where it has fewer words. Two documents link when the intersection is at least
    ``threshold`` (a fraction as two integers, above 0) of the union; component_id is the smallest id
    reachable by links, itself included. The result is exact; sets are compared by 64-bit hashes.

    A null or empty text, or one of white space only, has an empty set, links with nothing and is its own component.
    A row with a null id is returned with a null component and no links, and doesn't count as a partner. Rows that
    repeat an id are documents of their own that share it. An empty table gives no rows. Other columns of ``docs`` are
    ignored, whatever their names.
    """
    num, den = threshold
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = cut(rows.mapInArrow(_signatures(words), "id long, n long, print long"), "signatures")
    known = marks.filter("id is not null and n > 0")
    classes = known.groupBy("print").agg(F.min("id").alias("low"), F.count("*").alias("copies"))

    posts = rows.filter("id is not null").select("text").mapInArrow(_postings(words, num, den), "key long, print long")
    near = posts.repartition("key").mapInArrow(_shared, "a long, b long").distinct()
    regions = components(near)
    chosen = cut(regions.withColumnRenamed("node", "print").join(classes, "print"), "chosen")
    chosen = chosen.withColumnRenamed("low", "id")
    with scratch() as held:  # the shingle sets, which only the join of the cells reads
        texts = only_members(rows.filter("id is not null"), chosen, "id").join(chosen, "id").select("print", "text", F.col("label").alias("cell"), "copies")
        cells = cut(texts.mapInArrow(_sets(words), _CELLS), "cells")
        cells = _split(_part(cells, num, den, cell_load), num, den, cell_load)
    joined = (cells.repartition("cell").sortWithinPartitions("cell")
              .mapInArrow(_join_cells(num, den), "print long, root long, links long"))
    joined = cut(joined, "joined")
    discard(docs.sparkSession, held)
    tied = components(joined.filter("print <> root").select("print", "root")).withColumnRenamed("node", "print")
    links = joined.groupBy("print").agg(F.sum("links").alias("links"))
    whole = classes.join(tied, "print", "left").join(links, "print", "left")
    least = whole.filter("label is not null").groupBy("label").agg(F.min("low").alias("least"))
    whole = whole.join(least, "label", "left").select(
        "print", F.coalesce("least", "low").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    found = known.join(whole, "print").select("id", "n", "links", "component")
    alone = marks.filter("id is null or n = 0").select("id", "n", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return found.unionAll(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                                        F.col("links").alias("n_links"), F.col("component").alias("component_id"))
