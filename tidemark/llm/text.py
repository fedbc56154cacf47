"""Words and word shingles of Arrow string columns, as numpy arrays over a whole batch.

A word is a maximal run of ASCII letters, ASCII digits and bytes above 0x7F, with A-Z lower-cased; every other
ASCII character separates. A null text counts as empty. Hashes are 64-bit; equal hashes are taken for equal words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint64)
_WORD = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES >= 128)
WORD_BYTE = _WORD
HASHED = 1 << 17  # bytes of words that are hashed at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x = x ^ (x >> np.uint64(29))
    x = x * _BASE
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of a run of documents; ``first[d]:first[d + 1]`` are those of document ``d``."""

    data: np.ndarray      # bytes of all texts
    offsets: np.ndarray   # byte offsets of the documents
    start: np.ndarray     # byte offset of each word
    end: np.ndarray
    hash: np.ndarray      # uint64
    doc: np.ndarray       # document index of each word
    first: np.ndarray     # word offsets of the documents

    def prefix(self, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes of each word (the whole word if shorter)."""
        return _hashes(self.data, self.start, np.minimum(self.end, self.start + n))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    out = np.zeros(len(length), np.uint64)
    if not len(length):
        return out
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
    # A byte takes some 50 bytes while it is hashed, so words go in runs of HASHED bytes.
    edges = np.unique(np.concatenate([[0], np.searchsorted(at, np.arange(HASHED, at[-1], HASHED)), [len(length)]]))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(length.max()), _BASE)]), dtype=np.uint64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            first, size = at[a:b] - at[a], length[a:b]
            inside = np.arange(at[b] - at[a]) - np.repeat(first, size)
            value = _LOWER[data[inside + np.repeat(start[a:b], size)]] * powers[inside]
            out[a:b] = np.add.reduceat(value, first) + size.astype(np.uint64)
        return mix(out)


def words(texts: pa.Array) -> Words:
    """Words of every text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(data, offsets, start, end, _hashes(data, start, end), doc, first)


def shingles(w: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, index of the first word) of every run of ``k`` words.

    With ``short`` a document of 1 to k - 1 words has one shingle of all its words; without words there is none.
    """
    n = len(w.hash)
    with np.errstate(over="ignore"):
        m = max(n - k + 1, 0)
        acc = np.zeros(m, np.uint64)
        for j in range(k):
            acc = (acc + w.hash[j:j + m]) * _BASE
            acc ^= acc >> np.uint64(31)
        keep = np.flatnonzero(w.doc[:n - k + 1] == w.doc[k - 1:]) if n >= k else np.zeros(0, np.int64)
        value, doc, at = mix(acc[keep]), w.doc[keep], keep
        counts = np.diff(w.first)
        few = np.flatnonzero((counts > 0) & (counts < k)) if short else np.zeros(0, np.int64)
        if len(few):
            one = np.add.reduceat(w.hash * (np.arange(n) - w.first[w.doc] + 1).astype(np.uint64), w.first[few]) \
                if len(few) == len(counts[counts > 0]) else np.array(
                    [np.sum(w.hash[a:b] * np.arange(1, b - a + 1, dtype=np.uint64), dtype=np.uint64)
                     for a, b in zip(w.first[few], w.first[few + 1])], np.uint64)
            value = np.concatenate([value, mix(one)])
            doc, at = np.concatenate([doc, few]), np.concatenate([at, w.first[few]])
            order = np.lexsort((at, doc))
            value, doc, at = value[order], doc[order], at[order]
    return value, doc, at


def runs(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text, which bounds a task's memory."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
