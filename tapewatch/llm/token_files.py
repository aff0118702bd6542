"""Token-id files: every document is compressed by itself with a shared zstandard dictionary.

A folder holds two Parquet tables, so that writing and reading go through Spark's commit protocol on any store:

* ``dictionary``: the dictionary's bytes and their sha256 (one row).
* ``blocks``: documents in ascending order of their ids. ``payload`` is the compressed documents one after the other;
  ``entries`` lists for each its id, offset and size in the payload and its number of tokens; ``dictionary_hash`` names
  the dictionary it needs; ``width`` is the bytes per id, unsigned and little-endian. ``first_id`` and ``last_id`` let a reader skip blocks.

So a short document is read by one small frame, and short frames still compress, since the dictionary, trained on
serialized id arrays, knows what they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.tokens import encoded, encoder
from tapewatch.llm.totals import before

#: The dictionary is trained on about so many documents of at most so many bytes of text, chosen by hash.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 16_384, 65_536
BLOCK_BYTES = 4 << 20
ENTRY = "struct<doc_id:bigint,offset:bigint,size:int,n_tokens:bigint>"
BLOCKS = ("shard int, block int, first_id long, last_id long, n_tokens long, width int, dictionary_hash string, "
          f"entries array<{ENTRY}>, payload binary")


def _serialized(path: str, drops_space: bool, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, borders in encoded(batches, path, drops_space, end_id):
            raw = ids.astype(f"<u{width}").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[width * a:width * b] for a, b in zip(borders[:-1], borders[1:])], pa.binary())], ["raw"])
    return run


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT) if raw else None


def train_dictionary(rows: DataFrame, path: str, drops_space: bool, end_id: int, width: int) -> bytes:
    """A dictionary from a bounded sample of short documents; empty (plain zstandard) where they are too few to train."""
    import zstandard

    short = rows.filter(F.octet_length("text") <= SAMPLE_BYTES)
    n = short.count()
    chosen = short.filter(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) < SAMPLE_DOCS).limit(2 * SAMPLE_DOCS)
    samples = [bytes(r[0]) for r in chosen.mapInArrow(_serialized(path, drops_space, end_id, width), "raw binary").collect()]
    if len(samples) < 100:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # samples without anything in common
        return b""


def _write(path: str, drops_space: bool, end_id: int, width: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        known = _dictionary(dictionary)
        frame = zstandard.ZstdCompressor(level=3, dict_data=known) if known else zstandard.ZstdCompressor(level=3)
        name, shard = hashlib.sha256(dictionary).hexdigest(), TaskContext.get().partitionId()
        block, entries, payload = 0, [], bytearray()

        def done() -> pa.RecordBatch:
            values = [[shard], [block], [entries[0]["doc_id"]], [entries[-1]["doc_id"]], [sum(e["n_tokens"] for e in entries)],
                      [width], [name], [entries], [bytes(payload)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(),
                     pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int32()), ("n_tokens", pa.int64())])), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        for rows, ids, borders in encoded(batches, path, drops_space, end_id):
            raw = ids.astype(f"<u{width}").tobytes()
            for row, a, b in zip(rows, borders[:-1].tolist(), borders[1:].tolist()):
                packed = frame.compress(raw[width * a:width * b])
                entries.append({"doc_id": row, "offset": len(payload), "size": len(packed), "n_tokens": b - a})
                payload += packed
                if len(payload) >= BLOCK_BYTES:
                    yield done()
                    block, entries, payload = block + 1, [], bytearray()
        if entries:
            yield done()
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, drops_space: bool, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, puts ``end_id`` behind it and writes the files into the new folder ``path``.

    A null text is the end id alone. Rows with a null id come first, rows that repeat an id stand side by side, in the
    order of their texts. An empty table gives files without blocks. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = encoder(tokenizer, drops_space).tokenizer.get_vocab_size(with_added_tokens=True)
    width = 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4
    dictionary = train_dictionary(rows, tokenizer, drops_space, end_id, width)
    spark = docs.sparkSession
    table = spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary)], "dictionary_hash string, dictionary binary")
    table.coalesce(1).write.parquet(f"{path}/dictionary")
    # the hash parts rows that repeat an id, should these be many
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_write(tokenizer, drops_space, end_id, width, dictionary), BLOCKS).write.parquet(f"{path}/blocks")


def _read(dictionary: bytes, wanted: frozenset[int] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known, name = _dictionary(dictionary), hashlib.sha256(dictionary).hexdigest()
        frame = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
        for batch in batches:
            for start, width, needs, entries, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if needs != name:
                    raise ValueError(f"a block needs dictionary {needs}, the folder has {name}")
                ids, starts, sizes, raw, held = [], [], [], [], 0
                for e in entries:
                    if wanted is None or e["doc_id"] in wanted:
                        own = frame.decompress(payload[e["offset"]:e["offset"] + e["size"]], max_output_size=width * e["n_tokens"])
                        if len(own) != width * e["n_tokens"]:
                            raise ValueError(f"document {e['doc_id']} is damaged")
                        raw.append(np.frombuffer(own, dtype=f"<u{width}").astype("<u4").tobytes())
                        ids.append(e["doc_id"])
                        starts.append(start)
                        sizes.append(e["n_tokens"])
                        held += len(raw[-1])
                    start += e["n_tokens"]
                    if held > BLOCK_BYTES or e is entries[-1]:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                                                          pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        ids, starts, sizes, raw, held = [], [], [], [], 0
    return run


_ROWS = "doc_id long, start long, n_tokens long, ids binary"


def _parts(spark: SparkSession, path: str) -> tuple[bytes, DataFrame]:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"]), spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): all documents; start counts the ids in front of a document, ids are little-endian
    unsigned 32-bit integers. A block that names another dictionary, or a damaged frame, is an error."""
    dictionary, blocks = _parts(spark, path)
    sizes = before(blocks.select("shard", "block", "n_tokens", F.lit(0).alias("all")), "all", "shard", ["block"], "n_tokens", "start")
    rows = blocks.join(sizes.select("shard", "block", F.col("start").cast("long").alias("start")), ["shard", "block"])
    return rows.select("start", "width", "dictionary_hash", "entries", "payload").mapInArrow(_read(dictionary), _ROWS)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The documents of a short list of ids: only blocks whose range holds one are read, and only their own frames are
    decompressed. ``start`` counts within the block."""
    dictionary, blocks = _parts(spark, path)
    hit = F.lit(False)
    for i in ids:
        hit = hit | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
    rows = blocks.filter(hit).select(F.lit(0).cast("long").alias("start"), "width", "dictionary_hash", "entries", "payload")
    return rows.mapInArrow(_read(dictionary, frozenset(ids)), _ROWS)
