"""Quality scores by nearest neighbours: labelled documents as latent-semantic vectors vote by cosine similarity.

Terms are hashed words, word forms (case, last mark, whether the word repeats the one before) and word lengths. Document
frequencies come from all documents. The latent space is fitted on a bounded sample of labelled documents, whose vectors
every task gets; each task multiplies its documents with all of them, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.base import SPACE, byte_views, pieces, word_hashes

WORD_TERMS, FORMS, LENGTHS = 4096, 4 * 64 * 2, 8
TERMS = WORD_TERMS + FORMS + LENGTHS
#: Borders of the three kinds of terms; each kind has the same share in a document's vector.
KINDS = (0, WORD_TERMS, WORD_TERMS + FORMS, TERMS)
#: Documents that are compared at once with all labelled ones.
BLOCK = 1024
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:127] = True
_MARK &= ~_LETTER


def _ends(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows."""
    word = np.concatenate([[False], ~SPACE[data], [False]])
    border = np.zeros(len(data) + 1, dtype=bool)
    border[borders] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | border))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | border))
    return starts, ends


def term_counts(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How often each row has each term: a dense row per document."""
    hashes, counts = word_hashes(data, borders)
    starts, ends = _ends(data, borders)
    row = np.repeat(np.arange(len(counts)), counts)
    capitals = np.concatenate([[0], np.cumsum(_CAPITAL[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    upper, all_of_it = capitals[ends] - capitals[starts], letters[ends] - letters[starts]
    title = (upper == 1) & _CAPITAL[data[starts]]
    case = np.where(upper == 0, 0, np.where(title, 1, np.where(upper == all_of_it, 2, 3)))
    tail = data[ends - 1].astype(np.int64)
    again = np.zeros(len(hashes), dtype=np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    form = (case * 64 + np.where(_MARK[tail], tail & 63, 0)) * 2 + again
    size = np.minimum(np.log2(np.maximum(ends - starts, 1)).astype(np.int64), LENGTHS - 1)
    term = np.concatenate([(hashes % np.uint64(WORD_TERMS)).astype(np.int64), WORD_TERMS + form, WORD_TERMS + FORMS + size])
    return np.bincount(np.tile(row, 3) * TERMS + term, minlength=len(counts) * TERMS).reshape(len(counts), TERMS)


def term_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Roots of counts times inverse document frequencies, every kind of terms brought to length one."""
    out = np.sqrt(counts.astype(np.float32)) * idf.astype(np.float32)
    for a, b in zip(KINDS[:-1], KINDS[1:]):
        out[:, a:b] /= np.maximum(np.linalg.norm(out[:, a:b], axis=1, keepdims=True), 1e-12)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in pieces(batches, column):
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, term_counts(*byte_views(part.column(column)))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents and, for every term, of those that have it; one row per task and term is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(TERMS, dtype=np.int64), 0
        for part, counts in _blocks(batches, 0):
            found += (counts > 0).sum(axis=0)
            n += part.num_rows
        term = np.append(np.flatnonzero(found), -1)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.append(found[term[:-1]], n))], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS rows at most
    table = {r["term"]: r["n"] for r in rows}
    return table.get(-1, 0), np.array([table.get(k, 0) for k in range(TERMS)], dtype=np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int) -> DataFrame:
    """(text, label) of at most ``per_class`` labelled documents of each class, chosen by a digest of their ids.

    Several labels of one id are averaged; of several texts of one id the smallest is taken.
    """
    known = labels.select("doc_id", F.col("quality").cast("double").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.avg("label").alias("label")).withColumn("digest", F.md5(F.concat(F.lit("vote:"), F.col("doc_id").cast("string"))))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = [known.filter(side).orderBy("digest", "doc_id").limit(per_class) for side in (F.col("label") >= 0.5, F.col("label") < 0.5)]
    chosen = chosen[0].unionAll(chosen[1]).select("doc_id", "label")  # 2 * per_class rows at most
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")


@dataclass(frozen=True)
class Space:
    """Latent space and the labelled documents in it."""

    idf: np.ndarray
    basis: np.ndarray  # TERMS x dims
    vectors: np.ndarray  # labelled documents x dims, of length one
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        out = term_vectors(counts, self.idf) @ self.basis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def vote(self, counts: np.ndarray, neighbours: int) -> np.ndarray:
        """Labels of the most similar labelled documents (all that are as similar as the last of them), weighted by similarity."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = np.round((self.project(counts) @ self.vectors.T).astype(np.float64), 5)
        k = min(neighbours, len(self.labels))
        least = np.partition(near, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
        weight = np.where(near >= least[:, None], np.maximum(near, 0), 0)
        total = weight.sum(axis=1)
        return np.clip(np.where(total > 0, weight @ self.labels / np.where(total > 0, total, 1), self.labels.mean()), 0, 1)


def fit_space(sample: DataFrame, n_docs: int, found: np.ndarray, dims: int) -> Space:
    """Singular vectors of the sample's term vectors. The sample is bounded, its sparse vectors come to the driver."""
    idf = np.log((n_docs + 1) / (found + 1)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in _blocks(batches, 0):
            own = term_vectors(counts, idf)
            terms = [np.flatnonzero(v) for v in own]
            yield pa.RecordBatch.from_arrays([pa.array([t.astype(np.int16).tobytes() for t in terms], pa.binary()),
                                              pa.array([v[t].tobytes() for v, t in zip(own, terms)], pa.binary()), part.column(1)], ["terms", "values", "label"])

    rows = sample.select("text", "label").mapInArrow(run, "terms binary, values binary, label double").orderBy("label", "terms", "values").collect()
    a = np.zeros((len(rows), TERMS), dtype=np.float32)
    for k, r in enumerate(rows):
        a[k, np.frombuffer(r["terms"], dtype=np.int16)] = np.frombuffer(r["values"], dtype=np.float32)
    size, turn = np.linalg.eigh((a @ a.T).astype(np.float64))
    keep = [k for k in np.argsort(-size)[:dims] if size[k] > 1e-6]
    basis = (a.T @ turn[:, keep] / np.sqrt(size[keep])).astype(np.float32)
    vectors = a @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Space(idf, basis, vectors, np.array([r["label"] for r in rows], dtype=np.float64))


def quality_votes(docs: DataFrame, labels: DataFrame, usable: Column, *, neighbours: int = 16, dims: int = 32, per_class: int = 1024) -> DataFrame:
    """(doc_id, score) of every document; the score is the weighted share of good neighbours, from 0 to 1.

    ``usable`` says by ``doc_id`` which rows of ``labels`` (doc_id, quality 0 or 1) may be learned. Only ``per_class`` good
    and as many bad documents are; all documents count for the frequencies and all are scored, by their whole texts.
    A text without words (null, empty, white space) is like no other: its score is the mean label of the sample. Without any
    label every score is 0.5. Null and repeated ids are kept row by row. Other columns are ignored.
    """
    n_docs, found = document_frequencies(docs)
    space = fit_space(labelled_sample(docs, labels, usable, per_class), n_docs, found, dims)
    shared = docs.sparkSession.sparkContext.broadcast(space)  # (TERMS + 2 * per_class) * dims floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in _blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.vote(counts, neighbours))], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
