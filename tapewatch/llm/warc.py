"""WARC files and a fixity audit of their replicas by Merkle trees.

A record's leaf hashes its place, length and bytes. Above the leaves a node hashes up to FANOUT children that follow each
other, so it stands for one range of offsets of a file; file roots go on to a single root of the replica. Two replicas
are compared from their roots down, and only children of nodes that differ are looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewatch.session import cut

FANOUT = 16
#: A part file's number at the start of its name and its count at the end. What is between names the job that wrote it.
FILE_KEY = r"^part-\d+(?=-)|-c\d+(?=\.)"
_HEAD = re.compile(rb"WARC/1\.[01]\r\n")
_LEAF = ("file string, number long, offset long, size long, record_id string, page_id long, url string, payload_size long, "
         "payload_sha256 string, intact boolean, leaf binary")


def warc_record(id_col: str, url_col: str, payload_col: str, date: str) -> Column:
    """One resource record without the two line ends behind it. Line breaks in a url are escaped."""
    url = F.regexp_replace(F.col(url_col), r"[\r\n]+", "%0A")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    h = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\n"), line("WARC-Target-URI", url), line("WARC-Date", F.lit(date)),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))), line("Page-ID", F.col(id_col).cast("string")),
        line("Content-Type", F.lit("text/html")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(payload, 256))),
        line("Content-Length", F.octet_length(payload).cast("string")), F.lit("\r\n"), payload)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               date: str = "2024-01-01T00:00:00Z", records_per_file: int = 50_000) -> None:
    """Writes the rows as gzipped WARC files into the new folder ``path``; a partition gives one file or several.

    The two line ends behind a record are the line separator of Spark's text writer, so files are committed like any
    table, on any store. Null payloads are empty records, null ids and urls leave their header out, repeated rows
    are records of their own, and an empty table gives no records. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).cast("string").alias("u"), F.col(payload_col).cast("string").alias("p"))
    writer = rows.select(warc_record("i", "u", "p", date).alias("value")).write
    writer.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _unpacked(content: bytes) -> Iterator[bytes]:
    """The file's bytes in pieces; gzip members may follow each other, and a damaged member ends the file."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            piece = member.decompress(content, 1 << 22)
            while piece or not member.eof:
                yield piece
                if member.eof or not piece and not member.unconsumed_tail:
                    break
                piece = member.decompress(member.unconsumed_tail, 1 << 22)
        except zlib.error:
            return
        content = member.unused_data


def records(content: bytes) -> Iterator[tuple[int, bytes, dict[str, str], bytes, bool]]:
    """(offset, bytes, header, payload, intact) of each record; what can't be read up to the next record is one that isn't intact."""
    held, base, at = bytearray(), 0, 0
    pieces = _unpacked(content)
    ended = False

    def more() -> bool:
        nonlocal ended, base, at
        if at > 1 << 22:
            del held[:at]
            base, at = base + at, 0
        piece = next(pieces, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        while at >= len(held) and not ended:
            more()
        if at >= len(held):
            return
        while (end := held.find(b"\r\n\r\n", at)) < 0 and more():
            pass
        header: dict[str, str] = {}
        size = None
        if end >= 0 and _HEAD.match(held, at):
            for line in bytes(held[at:end]).split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                header[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
            size = int(header["content-length"]) if header.get("content-length", "").isdigit() else None
        if size is not None:
            width = end - at + 4 + size + 4
            while len(held) - at < width and more():
                pass
            begin = at + width - size - 4
            if bytes(held[at + width - 4:at + width]) == b"\r\n\r\n":
                payload = bytes(held[begin:begin + size])
                told = header.get("warc-payload-digest", "")
                good = not told.startswith("sha256:") or told[7:] == hashlib.sha256(payload).hexdigest()
                yield base + at, bytes(held[at:at + width]), header, payload, good
                at += width
                continue
        while (m := re.compile(rb"\r\n\r\n(?=WARC/1\.[01]\r\n)").search(held, at)) is None and more():
            pass
        stop = m.end() if m else len(held)
        yield base + at, bytes(held[at:stop]), header, b"", False
        at = stop


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in _LEAF.split(", ")]
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = []
            for number, (offset, raw, header, payload, good) in enumerate(records(content.as_py())):
                page = header.get("page-id", "")
                leaf = hashlib.sha256(f"{number}:{len(raw)}:".encode() + raw).digest()
                rows.append((file, number, offset, len(raw), header.get("warc-record-id"), int(page) if re.fullmatch(r"-?\d{1,18}", page) else None,
                             header.get("warc-target-uri"), len(payload), hashlib.sha256(payload).hexdigest(), good, leaf))
                if len(rows) >= 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def read_leaves(spark: SparkSession, path: str, file_key: str = FILE_KEY) -> DataFrame:
    """One row per record of a folder of WARC files, with its hash. ``file_key`` finds the parts of a file's name that are
    the same in all replicas; a name without any stands for itself."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    key = F.array_join(F.regexp_extract_all(name, F.lit(file_key), F.lit(0)), "")
    return files.select(F.when(key != "", key).otherwise(name).alias("file"), "content").mapInArrow(_leaves, _LEAF)


class Tree:
    """The nodes of a replica: ``levels[0]`` are leaves and ``levels[-1]`` is the root; each has (file, at, hash).

    A tree may be asked to be higher than its leaves need; its root then has a chain of single nodes above it.
    """

    def __init__(self, leaves: DataFrame, in_files: int = 0, over_files: int = 0) -> None:
        self.leaves = leaves
        self.levels = [leaves.select("file", F.col("number").alias("at"), F.col("leaf").alias("hash"))]
        most = leaves.agg(F.max("number")).first()[0] or 0
        while most > 0 or len(self.levels) < in_files:
            self.levels.append(cut(self._above(self.levels[-1]), "nodes"))
            most //= FANOUT
        self.of_files = len(self.levels)
        roots = self.levels[-1].select("file", "hash")  # one for each file
        order = F.row_number().over(Window.orderBy("file")) - 1
        top = cut(roots.select(F.lit("").alias("file"), order.cast("long").alias("at"), "hash", F.col("file").alias("of")), "files")
        self.files = top.select("at", F.col("of").alias("file"))
        self.levels.append(top.select("file", "at", F.sha2(F.concat(F.col("of").cast("binary"), "hash"), 256).cast("binary").alias("hash")))
        most = top.agg(F.max("at")).first()[0] or 0
        while most > 0 or len(self.levels) - self.of_files < over_files:
            self.levels.append(cut(self._above(self.levels[-1]), "nodes"))
            most //= FANOUT

    @staticmethod
    def _above(nodes: DataFrame) -> DataFrame:
        up = nodes.withColumn("up", F.expr(f"at div {FANOUT}"))
        parts = F.sort_array(F.collect_list(F.struct("at", "hash")))  # FANOUT at most
        joined = F.aggregate(F.transform(parts, lambda x: x.hash), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
        return up.groupBy("file", "up").agg(F.sha2(joined, 256).cast("binary").alias("hash")).withColumnRenamed("up", "at")

    def root(self) -> bytes | None:
        row = self.levels[-1].select("hash").first()
        return bytes(row[0]) if row else None


def audit(one: Tree, other: Tree) -> DataFrame:
    """(file, number) of the leaves in which two replicas differ, or that only one of them has.

    Trees of equal roots are not looked at further. Where one replica has more files, or longer ones, the lower tree is built
    anew as high as the other, so that both are descended level by level.
    """
    empty = one.leaves.select("file", "number").limit(0)
    if one.root() == other.root():
        return empty
    heights = [max(one.of_files, other.of_files), max(len(t.levels) - t.of_files for t in (one, other))]
    one, other = (t if [t.of_files, len(t.levels) - t.of_files] == heights else Tree(t.leaves, *heights) for t in (one, other))
    wrong = None
    for level in range(len(one.levels) - 1, -1, -1):
        a, b = one.levels[level], other.levels[level]
        if level == one.of_files - 1:  # from ranges of files to the files
            names = one.files.unionAll(other.files).distinct()
            wrong = wrong.select("at").join(names, "at").select("file").distinct()
            a, b = (x.join(wrong, "file", "left_semi") for x in (a, b))
        elif wrong is not None:
            up = F.expr(f"at div {FANOUT}").alias("up")
            keys = wrong.select("file", F.col("at").alias("up"))
            a, b = (x.select("*", up).join(keys, ["file", "up"], "left_semi").select("file", "at", "hash") for x in (a, b))
        both = a.join(b.withColumnRenamed("hash", "its"), ["file", "at"], "full")
        wrong = cut(both.filter(~F.col("hash").eqNullSafe(F.col("its"))).select("file", "at"), "wrong")
    return wrong.select("file", F.col("at").alias("number"))


def audit_folders(spark: SparkSession, one: str, other: str) -> DataFrame:
    """All records of folder ``one`` with ``status``: intact, or changed where the record at its place in folder
    ``other`` has other bytes; and the records that only ``other`` has, as extra.

    A damaged record that can't be parsed still has a leaf. Empty folders of equal roots give no rows.
    """
    a, b = (cut(read_leaves(spark, p), "leaves") for p in (one, other))
    wrong = audit(Tree(a), Tree(b))
    marked = wrong.withColumn("differs", F.lit(True))
    mine = a.join(marked, ["file", "number"], "left").withColumn("status", F.when(F.col("differs"), "changed").otherwise("intact"))
    extra = b.join(wrong, ["file", "number"], "left_semi").join(a.select("file", "number"), ["file", "number"], "left_anti")
    names = [c for c in a.columns if c != "leaf"]
    return mine.select(*names, "status").unionAll(extra.select(*names, F.lit("extra").alias("status")))
