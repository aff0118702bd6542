"""Importance resampling towards a target: hashed word runs, log-ratio gains of their buckets, Gumbel top-k.

The CRC-32 of a word run is never computed from its bytes. One scan of the separator-normalised text gives the running
CRC at every place; appending n bytes multiplies a CRC by x^(8n) over GF(2), so the part of a prefix that
a run does not hold is shifted by the run's length and cancelled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.base import byte_views, pieces
from tapewatch.session import cut

_POLYNOMIAL = 0xEDB88320
_ALL = np.uint32(0xFFFFFFFF)
#: Bytes that are scanned one after the other; all stretches of a text are scanned at the same time.
STRETCH = 256

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


_TABLE = _byte_table()


def _apply(shift: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values for each of the four bytes."""
    return shift[0][crc & 255] ^ shift[1][(crc >> 8) & 255] ^ shift[2][(crc >> 16) & 255] ^ shift[3][crc >> 24]


def _shifts() -> list[np.ndarray]:
    """Shift by 1, 2, 4, ... bytes, up to what a text can hold."""
    byte = np.arange(256, dtype=np.uint32)
    out = [np.stack([_TABLE[byte], byte << 0, byte << 8, byte << 16])]
    while len(out) < 40:
        out.append(np.stack([_apply(out[-1], row) for row in out[-1]]))
    return out


_SHIFTS = _shifts()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after as many zero bytes as ``length`` says for each."""
    out = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        there = np.flatnonzero((length >> k) & 1)
        out[there] = _apply(_SHIFTS[k], out[there])
    return out


def running_crcs(data: np.ndarray) -> np.ndarray:
    """The CRC register (from zero, not inverted) in front of every byte and behind the last one."""
    count = -(-len(data) // STRETCH)
    columns = np.zeros(count * STRETCH, dtype=np.uint8)
    columns[:len(data)] = data
    columns = np.ascontiguousarray(columns.reshape(count, STRETCH).T)
    state = np.zeros(count, dtype=np.uint32)
    for column in columns:
        state = _TABLE[(state ^ column) & 255] ^ (state >> 8)
    reach, k = 1, STRETCH.bit_length() - 1
    while reach < count:  # from the registers of single stretches to those of all that lies before
        state[reach:] ^= _apply(_SHIFTS[k], state[:-reach].copy())
        reach, k = 2 * reach, k + 1
    state = np.concatenate([np.zeros(1, np.uint32), state[:-1]])[:count]
    out = np.empty((STRETCH + 1, count), dtype=np.uint32)
    out[0] = state
    for j, column in enumerate(columns):
        out[j + 1] = state = _TABLE[(state ^ column) & 255] ^ (state >> 8)
    flat = np.ascontiguousarray(out[:-1].T).ravel()
    return np.append(flat, out[-1, -1:])[:len(data) + 1] if count else np.zeros(1, np.uint32)


def _normalised(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words with one space behind each, their starts and ends there, and the words of each row."""
    word = np.concatenate([[False], _WORD[data], [False]])
    border = np.zeros(len(data) + 1, dtype=bool)
    border[borders] = True
    first = np.flatnonzero(word[1:] & (~word[:-1] | border))
    last = np.flatnonzero(word[:-1] & (~word[1:] | border))
    ends = np.cumsum(last - first + 1) - 1
    starts = ends - (last - first)
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = _LOWER[data[word[1:-1]]]
    return out, starts, ends, np.diff(np.searchsorted(first, borders))


def run_crcs(data: np.ndarray, borders: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of each run of 1 to ``most`` words (of a row; row after row, shorter runs first), the runs and the words of each row."""
    text, starts, ends, words = _normalised(data, borders)
    crcs = running_crcs(text)
    row = np.repeat(np.arange(len(words)), words)
    left = np.cumsum(words)[row] - np.arange(len(row)) if len(row) else row
    found, rows = [], []
    for n in range(1, most + 1):
        at = np.flatnonzero(left >= n)
        a, b = starts[at], ends[at + n - 1]
        found.append(crcs[b] ^ shifted(crcs[a] ^ _ALL, b - a) ^ _ALL)
        rows.append(row[at])
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable") if most > 1 else slice(None)
    return np.concatenate(found)[order], np.bincount(rows, minlength=len(words)), words


def run_buckets(docs: DataFrame, most: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, buckets): the hash bucket of every word run of every document, each text scanned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            crcs, runs, words = run_crcs(*byte_views(batch.column(1)), most)
            borders = np.concatenate([[0], np.cumsum(runs)]).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(borders), pa.array((crcs % np.uint32(buckets)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.astype(np.int64)), own], ["doc_id", "n_words", "buckets"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, buckets array<int>")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Runs in each bucket over all documents; a task sends one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    rows = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    out[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to source frequency, by bucket."""
    m, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + m) / ((a + 1.0) * (t + m)))) for a, b in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _ranked(rows: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Adds ``rank`` to the best ``percent`` of a hundred of the documents with enough words.

    Scores are whole numbers of a bounded range, so a table with a row for each score says how many documents are better;
    only documents of one score are sorted together, and the hash in it spreads even equal texts over thousands of scores.
    """
    able = F.col("n_words") >= least_words
    per_score = rows.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    better = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    per_score = per_score.select(F.col("score").alias("own_score"), F.coalesce(F.sum("n").over(better), F.lit(0)).alias("better"),
                                 F.sum("n").over(Window.partitionBy()).alias("able_docs"))
    drawn = F.floor(F.col("able_docs") * percent / 100)
    top = rows.filter(able).join(per_score, F.col("score") == F.col("own_score")).filter(F.col("better") < drawn)
    place = F.col("better") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    top = top.withColumn("rank", F.when(place <= drawn, place)).select(*rows.columns, "rank")
    rest = rows.join(per_score.filter(F.col("better") < drawn).select("own_score"), able & (F.col("score") == F.col("own_score")), "left_anti")
    return top.unionAll(rest.withColumn("rank", F.lit(None).cast("long")))


def importance_sample(docs: DataFrame, target: DataFrame, *, most: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20,
                      percent: int = 10) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): how much each document is like ``target`` (a ``text`` column), and the drawn ones.

    Runs of 1 to ``most`` words of whole texts are hashed to ``buckets``; the weight of a document is the floored mean gain of its runs,
    0 without words (null, empty or all marks). The score adds a Gumbel number from a hash of seed and id, so the best scores
    are a draw without replacement in proportion to exp(weight / 1000). ``rank`` is null for what is not drawn. Equal scores go by
    id, a null id (hashed as ``null``) last; repeated rows all count. An empty target has equal, small counts everywhere.
    """
    found = cut(run_buckets(docs, most, buckets), "buckets")
    aimed = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(found, buckets), bucket_counts(run_buckets(aimed, most, buckets), buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # ``buckets`` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2)
            sums = np.concatenate([[0], np.cumsum(shared.value[own.flatten().to_numpy()])])
            n = own.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(n)
            weight = np.where(n > 0, (sums[ends] - sums[ends - n]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = found.schema["doc_id"].dataType.simpleString()
    rows = found.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = cut(rows.withColumn("score", F.col("weight") + noise), "scores")
    return _ranked(rows, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
