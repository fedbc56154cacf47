"""Quality scores by nearest-neighbour voting over labelled latent-semantic vectors.

A text becomes a vector of term weights: hashed words, hashed patterns of character classes, and bins of a few surface
measures. A truncated singular value decomposition of the labelled sample gives the latent space. The sample's vectors
are broadcast; each document's exact cosines with all of them are computed block by block, and its nearest neighbours
vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.labelled import MAX_CHARS, sample
from tidemark.llm.text import Words, mix, runs, words

WORD_BUCKETS, SHAPE_BUCKETS, BINS = 2048, 2048, 12
MEASURES = 7
TERMS = WORD_BUCKETS + SHAPE_BUCKETS + MEASURES * BINS
LATENT = 64
NEIGHBOURS = 15
PER_CLASS = (600, 600)   # labelled rows of each class at most
SHARPNESS = 8       # power of the cosine in a vote's weight
BLOCK = 512         # documents whose cosines are held at once
SURFACE_WEIGHT = 3.0

# Character classes: lower case, upper case, digits, space, line end, other letters; every sign is a class of its own.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's stretch."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def terms(w: Words) -> np.ndarray:
    """Documents by terms: log counts of hashed words and shapes, and one bin of each surface measure."""
    n = len(w.first) - 1
    out = np.zeros((n, TERMS), np.float32)
    # Shapes: three classes in a row, runs of one class taken together (signs by their number up to three).
    kind = _CLASS[w.data]
    doc_of = np.repeat(np.arange(n), np.diff(w.offsets))
    if len(kind):
        begin = np.ones(len(kind), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (doc_of[1:] != doc_of[:-1])
        at = np.flatnonzero(begin)
        size = np.minimum(np.diff(np.concatenate([at, [len(kind)]])), 3).astype(np.uint64)
        letter = (kind[at] >= 1) & (kind[at] <= 3)
        sign = kind[at] * np.uint64(4) + np.where(letter, np.uint64(0), size)
        if len(at) >= 3:
            same = doc_of[at[2:]] == doc_of[at[:-2]]
            with np.errstate(over="ignore"):
                three = mix((sign[:-2] * np.uint64(1 << 40) + sign[1:-1] * np.uint64(1 << 20) + sign[2:])[same])
            place = doc_of[at[2:]][same] * SHAPE_BUCKETS + (three % np.uint64(SHAPE_BUCKETS)).astype(np.int64)
            out[:, WORD_BUCKETS:WORD_BUCKETS + SHAPE_BUCKETS] = np.bincount(place, minlength=n * SHAPE_BUCKETS).reshape(n, -1)
    if len(w.hash):
        place = w.doc * WORD_BUCKETS + (w.hash % np.uint64(WORD_BUCKETS)).astype(np.int64)
        out[:, :WORD_BUCKETS] = np.bincount(place, minlength=n * WORD_BUCKETS).reshape(n, -1)
    np.log1p(out, out=out)

    count = np.diff(w.first).astype(float)
    size = np.maximum(np.diff(w.offsets), 1).astype(float)
    some = np.maximum(count, 1)
    again = np.zeros(len(w.hash))
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    low = np.uint64((1 << 20) - 1)  # the document's place; the rest of the hash tells words apart
    pairs = (np.unique(w.hash & ~low | w.doc.astype(np.uint64)) & low).astype(np.int64)
    signs = np.bincount(doc_of, weights=(w.data > 32) & ~((kind >= 1) & (kind <= 3)), minlength=n)
    upper = np.bincount(doc_of, weights=kind == 2, minlength=n)
    lines = np.bincount(doc_of, weights=w.data == 10, minlength=n) + 1
    measures = [_per_doc(again, w.first) / some, np.bincount(pairs, minlength=n) / some ** 0.9, signs / size * 4, upper / size * 2,
                _per_doc((w.end - w.start).astype(float), w.first) / some / 16, np.log1p(count) / 10, np.log1p(count / lines) / 8]
    base = WORD_BUCKETS + SHAPE_BUCKETS
    for k, m in enumerate(measures):
        out[np.arange(n), base + k * BINS + np.clip(m * BINS, 0, BINS - 1).astype(np.int64)] = SURFACE_WEIGHT
    return out


@dataclass
class Voters:
    """The latent space and the labelled vectors in it."""

    idf: np.ndarray       # terms
    basis: np.ndarray     # terms by latent dimensions
    vectors: np.ndarray   # labelled documents by latent dimensions, of length 1
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(counts * self.idf) @ self.basis)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors of each row, by exact cosines in blocks."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        out = np.empty(len(counts))
        k = min(neighbours, len(self.labels))
        for at in range(0, len(counts), BLOCK):
            cosine = self.project(counts[at:at + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.tile(np.arange(k), (len(cosine), 1))
            weight = np.clip(np.take_along_axis(cosine, near, 1), 0, None).astype(float) ** SHARPNESS + 1e-9
            out[at:at + BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(rows: list[tuple[str, int]], latent: int = LATENT) -> Voters:
    """Latent space and voters from labelled texts; without any, every score is one half."""
    if not rows:
        return Voters(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    counts = np.concatenate([terms(words(pa.array([t for t, _ in rows[i:i + 200]], pa.large_string()))) for i in range(0, len(rows), 200)])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
    x = _unit(counts * idf)
    # The sample has fewer rows than terms: the right singular vectors follow from the small Gram matrix.
    value, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    top = np.argsort(-value)[:latent]
    top = top[value[top] > 1e-9 * value.max()]
    basis = (x.T @ (left[:, top] / np.sqrt(value[top]))).astype(np.float32)
    voters = Voters(idf, basis, np.zeros((0, len(top)), np.float32), np.array([y for _, y in rows], float))
    voters.vectors = voters.project(counts)
    return voters


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", per_class: tuple[int, int] = PER_CLASS, max_chars: int = MAX_CHARS) -> Voters:
    """Fit on a bounded sample of the labelled rows for which ``learn`` holds; see ``labelled.sample`` for its bounds."""
    return fit(sample(docs, labels, label_col, learn, id_col, text_col, per_class, max_chars))


def score_quality(docs: DataFrame, voters: Voters, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier).

    Whole texts are scored; null texts count as empty and are scored like any other. A column named score is replaced;
    all others are kept. The voters are broadcast: their size is bounded by the sample and the latent dimensions.
    """
    kept = [c for c in docs.columns if c != "score"]
    place = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for part in runs(batches, text_col, 1 << 20):
            scores = [voters.score(terms(words(part.column(place).slice(at, BLOCK)))) for at in range(0, part.num_rows, BLOCK)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(scores))], [*part.schema.names, "score"])

    schema = docs.select(*kept).schema
    return docs.select(*kept).mapInArrow(run, StructType([*schema, StructField("score", DoubleType())]))
