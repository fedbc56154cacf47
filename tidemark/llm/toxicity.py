"""Toxic spans and document scores from a linear-chain conditional random field.

Two states, clean and toxic, follow a text's words. The score of the toxic state at a word is the sum of weights of its
features (the word, its beginnings, its neighbours' beginnings); two more weights stand for entering and staying in the
toxic state. Forward and backward messages give each word's marginal; the largest one of a text, calibrated, is its
score, and words above one half make up the offending spans.

Documents carry labels, words do not: the words of toxic training documents whose features occur nearly only in toxic
documents are labelled toxic, all other words clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from tidemark.llm.labelled import MAX_CHARS, PER_CLASS, distinct, sample
from tidemark.llm.pieces import flat
from tidemark.llm.text import WORD_BYTE, Words, mix, runs, words

BUCKETS = 1 << 21
BEGINNINGS = (4, 5, 6)
SEGMENT = 64
TRAIN_CLEAN = 800
SURE = 14.0         # evidence (nats) that a feature belongs to toxic documents
PRECISE = 0.9       # share of a feature's documents that must be toxic
RUN = 1 << 20       # bytes of text scored at a time; a longer text is worked through in stretches of as much
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("p", FloatType())]))
STEPS, RATE, DECAY = 30, 0.25, 1e-4


def _heads(w: Words) -> np.ndarray:
    """The first 8 bytes of each word, lower-cased, in one integer; zero bytes behind shorter words."""
    out = np.zeros(len(w.start), np.uint64)
    size = w.end - w.start
    last = max(len(w.data) - 1, 0)
    for j in range(8):
        byte = w.data[np.minimum(w.start + j, last)].astype(np.uint64)
        byte = np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)
        out |= np.where(size > j, byte, np.uint64(0)) << np.uint64(8 * j)
    return out


def features(w: Words) -> list[np.ndarray]:
    """Key of each feature of each word: the word, its beginnings, the beginnings of the words before and after."""
    n = len(w.hash)
    if not n:
        return [np.zeros(0, np.uint64)] * (3 + len(BEGINNINGS))
    head = _heads(w)
    keyed = lambda x, kind: mix(x + np.uint64(kind))
    with np.errstate(over="ignore"):
        out = [keyed(w.hash, 1)]
        for size in BEGINNINGS:
            out.append(keyed(head & np.uint64((1 << 8 * size) - 1), 1000 * size))
        near = head & np.uint64((1 << 40) - 1)
        edge = np.flatnonzero(np.diff(w.doc))
        before, after = np.concatenate([[np.uint64(0)], near[:-1]]), np.concatenate([near[1:], [np.uint64(0)]])
        before[edge + 1], after[edge] = 0, 0
        out += [keyed(before, 20_000), keyed(after, 30_000)]
    return out


def marginals(first: np.ndarray, score: np.ndarray, enter: float, leave: float, stay: float, begin: tuple = (1.0, 0.0), end: tuple = (1.0, 1.0)):
    """(toxic marginal of each word, expected numbers of entering, leaving and staying) of chains that start clean.

    ``begin`` and ``end`` are the messages from before and behind the chains, for one that is a stretch of a longer text. Chain d has the words ``first[d]:first[d + 1]``. Segments of a chain are multiplied out side by side for both states
    they may begin in, then joined in order, so long chains take no more steps than short ones.
    """
    n = len(score)
    if not n:
        return np.zeros(0), (0.0, 0.0, 0.0)
    size = np.diff(first)
    per = -(-size // SEGMENT)
    head = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(size)), size)
    inside = np.arange(n) - first[doc]
    seg, col = head[doc] + inside // SEGMENT, inside % SEGMENT
    total = int(head[-1])
    x = np.zeros((SEGMENT, total))
    live = np.zeros((SEGMENT, total), bool)
    x[col, seg] = np.exp(np.clip(score, -30, 30))
    live[col, seg] = True
    t01, t10, t11 = np.exp(enter), np.exp(leave), np.exp(stay)

    # Products of the step matrices [[1, t01 x], [t10, t11 x]] up to each word, and from behind each word to the end.
    ahead = np.zeros((SEGMENT, 4, total))
    p = [np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)]
    for j in range(SEGMENT):
        on, v = live[j], x[j]
        q = [p[0] + p[1] * t10, (p[0] * t01 + p[1] * t11) * v, p[2] + p[3] * t10, (p[2] * t01 + p[3] * t11) * v]
        scale = 1 / (q[0] + q[1] + q[2] + q[3])
        p = [np.where(on, a * scale, b) for a, b in zip(q, p)]
        for k in range(4):
            ahead[j, k] = p[k]
    behind = np.zeros((SEGMENT, 4, total))
    s = [np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)]
    for j in reversed(range(SEGMENT)):
        for k in range(4):
            behind[j, k] = s[k]
        on, v = live[j], x[j]
        q = [s[0] + t01 * v * s[2], s[1] + t01 * v * s[3], t10 * s[0] + t11 * v * s[2], t10 * s[1] + t11 * v * s[3]]
        scale = 1 / (q[0] + q[1] + q[2] + q[3])
        s = [np.where(on, a * scale, b) for a, b in zip(q, s)]
    # Join segments: messages into each from the front, and from behind, step by step over the segments of all chains.
    order = np.argsort(-per, kind="stable")
    front, back = np.zeros((2, total)), np.ones((2, total))
    for k in range(2):
        front[k, head[:-1][per > 0]] = begin[k]
        back[k, head[1:][per > 0] - 1] = end[k]
    longest = int(per.max())
    counts = np.bincount(per, minlength=longest + 1)[::-1].cumsum()[::-1]
    for k in range(1, longest):
        at = head[order[:counts[k + 1]]] + k
        a, b = front[0, at - 1], front[1, at - 1]
        f0, f1 = a * p[0][at - 1] + b * p[2][at - 1], a * p[1][at - 1] + b * p[3][at - 1]
        front[0, at], front[1, at] = f0 / (f0 + f1), f1 / (f0 + f1)
        tail = head[order[:counts[k + 1]] + 1] - 1 - k
        a, b = back[0, tail + 1], back[1, tail + 1]
        b0, b1 = s[0][tail + 1] * a + s[1][tail + 1] * b, s[2][tail + 1] * a + s[3][tail + 1] * b
        back[0, tail], back[1, tail] = b0 / (b0 + b1), b1 / (b0 + b1)
    a0 = front[0] * ahead[:, 0] + front[1] * ahead[:, 2]
    a1 = front[0] * ahead[:, 1] + front[1] * ahead[:, 3]
    b0 = behind[:, 0] * back[0] + behind[:, 1] * back[1]
    b1 = behind[:, 2] * back[0] + behind[:, 3] * back[1]
    z = a0 * b0 + a1 * b1
    toxic = (a1 * b1 / z)[col, seg]

    # Pairs: message before a word, its step, message behind it.
    before0 = np.concatenate([front[0][None], a0[:-1]])
    before1 = np.concatenate([front[1][None], a1[:-1]])
    ways = [before0 * b0, before0 * t01 * x * b1, before1 * t10 * b0, before1 * t11 * x * b1]
    all_ways = sum(ways)
    share = lambda w: float((w / all_ways)[live].sum())
    return toxic, (share(ways[1]), share(ways[2]), share(ways[3]))


def step_product(score: np.ndarray, enter: float, leave: float, stay: float) -> np.ndarray:
    """The product of all step matrices of a chain, scaled."""
    x = np.exp(np.clip(score, -30, 30))
    steps = np.empty((len(x), 2, 2))
    steps[:, 0, 0], steps[:, 0, 1], steps[:, 1, 0], steps[:, 1, 1] = 1, np.exp(enter) * x, np.exp(leave), np.exp(stay) * x
    while len(steps) > 1:
        # Neighbours are multiplied side by side; an odd last one is kept for the next round.
        pairs = np.matmul(steps[:-1:2], steps[1::2])
        steps = np.concatenate([pairs / pairs.sum(axis=(1, 2), keepdims=True), steps[len(pairs) * 2:]])
    return steps[0] if len(steps) else np.eye(2)


@dataclass
class Tagger:
    """Weights by feature key (those that are not 0) and of the chain; the calibration of document scores."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    enter: float
    leave: float
    stay: float
    slope: float = 1.0
    offset: float = 0.0

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Weight and key by bucket. Of two features in one bucket the heavier stays."""
        weights, keys = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.uint64)
        order = np.argsort(np.abs(self.weights), kind="stable")
        at = (self.keys[order] & np.uint64(BUCKETS - 1)).astype(np.int64)
        weights[at], keys[at] = self.weights[order], self.keys[order]
        return weights, keys

    def scores(self, w: Words, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Score of the toxic state at each word."""
        score = np.full(len(w.hash), self.bias)
        for f in features(w):
            at = (f & np.uint64(BUCKETS - 1)).astype(np.int64)
            score += np.where(table[1][at] == f, table[0][at], 0)
        return score

    def tag(self, w: Words, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return marginals(w.first, self.scores(w, table), self.enter, self.leave, self.stay)[0]

    def tag_long(self, data: np.ndarray, table: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginal, start, end in characters) of the words of one text given as bytes, worked through in stretches of about ``size`` bytes.

        Same as ``tag``: a stretch takes along the words beside it, and messages are carried from one to the next.
        """
        chain = self.enter, self.leave, self.stay
        parts, chars = [], 0
        for before, at, to, behind in _stretches(data, size):
            w = words(pa.array([data[before:behind].tobytes()], pa.binary()).cast(pa.string(), safe=False))
            own = slice(*np.searchsorted(w.start, [at - before, to - before]))
            count = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
            shift = chars - count[at - before]
            parts.append((self.scores(w, table)[own].astype(np.float32), (count[w.start[own]] + shift).astype(np.int32), (count[w.end[own]] + shift).astype(np.int32)))
            chars = int(count[to - before] + shift)
        products = [step_product(p[0], *chain) for p in parts]
        ahead, behind = [np.array([1.0, 0.0])], [np.array([1.0, 1.0])]
        for m in products[:-1]:
            f = ahead[-1] @ m
            ahead.append(f / f.sum())
        for m in reversed(products[1:]):
            b = m @ behind[-1]
            behind.append(b / b.sum())
        tops = [marginals(np.array([0, len(p[0])]), p[0].astype(float), *chain, f, b)[0].astype(np.float32) if len(p[0]) else np.zeros(0, np.float32)
                for p, f, b in zip(parts, ahead, reversed(behind))]
        return np.concatenate(tops), *(np.concatenate([p[k] for p in parts]) for k in (1, 2))

    def calibrated(self, top: np.ndarray) -> np.ndarray:
        logit = np.log(np.clip(top, 1e-9, 1 - 1e-9) / (1 - np.clip(top, 1e-9, 1 - 1e-9)))
        return 1 / (1 + np.exp(-(self.slope * logit + self.offset)))


def _tops(first: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The largest marginal of each chain, 0 without words."""
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.maximum.reduceat(p, first[some])
    return out


def _stretches(data: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(start of the word before, start, end, end of the word behind) of stretches of about ``size`` bytes, cut between words."""
    def seek(at: int, word: bool, step: int) -> int:
        """The nearest edge from ``at`` on behind which (or, backwards, before which) no byte is of that kind."""
        block = 1 << 12
        while 0 < at < len(data) or (step > 0 and at == 0):
            piece = data[at:at + block] if step > 0 else data[max(at - block, 0):at][::-1]
            other = np.flatnonzero(WORD_BYTE[piece] != word)
            if len(other):
                return at + step * int(other[0])
            at += step * len(piece)
        return at

    at = 0
    while at < len(data):
        to = seek(min(at + size, len(data)), True, 1)
        before = seek(seek(at, False, -1), True, -1) if at else 0
        behind = seek(seek(to, False, 1), True, 1) if to < len(data) else to
        yield before, at, to, behind
        at = to


def _chunks(rows: list[tuple[str, int]]) -> Iterator[Words]:
    """Words of a hundred texts at a time, which bounds the memory of a fit."""
    for at in range(0, len(rows), 100):
        yield words(pa.array([t for t, _ in rows[at:at + 100]], pa.large_string()))


def clean_counts(rows: list[tuple[str, int]], known: np.ndarray) -> list[np.ndarray]:
    """For each kind of own feature: how many of the texts hold each of the ``known`` keys."""
    out = [np.zeros(len(known)) for _ in range(1 + len(BEGINNINGS))]
    for w in _chunks(rows):
        for total, f in zip(out, features(w)):
            place = np.minimum(np.searchsorted(known, f), len(known) - 1)
            hit = known[place] == f
            both = np.unique(w.doc[hit].astype(np.int64) * len(known) + place[hit])
            total += np.bincount(both % len(known), minlength=len(known))
    return out


def token_labels(word_doc: np.ndarray, own: list[np.ndarray], n: int, toxic: np.ndarray, more: list[np.ndarray], n_more: int) -> np.ndarray:
    """Toxic words of toxic documents: one of their own features (numbers below n) occurs nearly only in toxic documents.

    ``more`` counts the features in ``n_more`` further clean documents.
    Evidence is weighed again among the toxic documents without such a word until no more are found, so rarer
    vocabularies show beside common ones.
    """
    marked = np.zeros(len(word_doc), bool)
    open_ = toxic.astype(bool)
    pairs = []
    for f in own:
        both = np.unique(word_doc * n + f)
        pairs.append((both // n, both % n))
    while open_.any():
        weight = np.where(toxic > 0, open_, True)
        rate = (weight * toxic).sum() / (weight.sum() + n_more)
        new = np.zeros(len(word_doc), bool)
        for f, (doc, key), extra in zip(own, pairs, more):
            held = np.bincount(key, weights=weight[doc], minlength=n) + extra
            share = np.bincount(key, weights=(weight * toxic)[doc], minlength=n) / np.maximum(held, 1)
            a, b = np.clip(share, 1e-9, 1 - 1e-9), 1 - np.clip(share, 1e-9, 1 - 1e-9)
            evidence = held * (a * np.log(a / rate) + b * np.log(b / (1 - rate)))
            new |= ((share >= PRECISE) & (evidence >= SURE))[f]
        marked |= new
        covered = np.bincount(word_doc[new], minlength=len(toxic)) > 0
        if not (covered & open_).any():
            break
        open_ &= ~covered
    return marked & (toxic[word_doc] > 0)


def fit(rows: list[tuple[str, int]]) -> Tagger:
    """A tagger from labelled texts, near copies counted once. With texts of one class only, every score is that class's."""
    rows = distinct(rows)
    toxic = np.array([y for _, y in rows], float)
    if not len(rows) or toxic.min() == toxic.max():
        sign = 1.0 if len(rows) and toxic.max() == 1 else -1.0
        return Tagger(np.zeros(0, np.uint64), np.zeros(0, np.float32), -20.0, -5.0, 0.0, 0.0, 0.0, 10 * sign)
    # The field is trained on the first TRAIN_CLEAN clean documents; the others count as evidence.
    bad, good = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    rows, rest = bad + good[:TRAIN_CLEAN], good[TRAIN_CLEAN:]
    toxic = np.array([y for _, y in rows], float)
    parts, sizes = [], []
    for w in _chunks(rows):
        parts.append(np.stack(features(w)))
        sizes.append(np.diff(w.first))
    feats, size = np.concatenate(parts, axis=1), np.concatenate(sizes)
    del parts
    first = np.concatenate([[0], np.cumsum(size)])
    word_doc = np.repeat(np.arange(len(rows)), size)
    known = np.unique(feats)
    local = np.stack([np.searchsorted(known, f).astype(np.int32) for f in feats])
    del feats
    gold = token_labels(word_doc, list(local[:1 + len(BEGINNINGS)]), len(known), toxic, clean_counts(rest, known), len(rest)).astype(float)
    follows = np.zeros(len(gold))
    follows[1:] = gold[:-1] * (word_doc[1:] == word_doc[:-1])
    seen = np.array([(gold * (1 - follows)).sum(), ((1 - gold) * follows).sum(), (gold * follows).sum()])
    want = sum(np.bincount(f, weights=gold, minlength=len(known)) for f in local)
    theta = np.zeros(len(known))
    # bias, enter, leave, stay
    chain = np.array([-4.0, -1.0, 0.0, 0.0])
    m, v = np.zeros(len(known) + 4), np.zeros(len(known) + 4)
    n = max(gold.sum(), 1.0)
    for step in range(1, STEPS + 1):
        score = chain[0] + sum(theta[f] for f in local)
        p, moves = marginals(first, score, *chain[1:])
        grad = np.concatenate([
            (sum(np.bincount(f, weights=p, minlength=len(known)) for f in local) - want) / n + DECAY * theta,
            [(p.sum() - gold.sum()) / n], (np.array(moves) - seen) / n])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad ** 2
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        # Features that never fire in the gradient stay at 0.
        move[:len(known)] *= np.abs(grad[:len(known)]) > 1e-7
        theta -= move[:len(known)]
        chain -= move[len(known):]
    kept = np.abs(theta) > 1e-3
    tagger = Tagger(known[kept], theta[kept].astype(np.float32), *chain)
    table = tagger.table()
    top = np.clip(np.concatenate([_tops(w.first, tagger.tag(w, table)) for w in _chunks(rows)]), 1e-9, 1 - 1e-9)
    logit, slope, offset = np.log(top / (1 - top)), 0.5, 0.0
    for _ in range(300):
        q = 1 / (1 + np.exp(-(slope * logit + offset)))
        slope -= 0.02 * (((q - toxic) * logit).mean() + 1e-3 * slope)
        offset -= 0.1 * (q - toxic).mean()
    tagger.slope, tagger.offset = max(slope, 0.05), offset
    return tagger


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", per_class: tuple[int, int] = PER_CLASS, max_chars: int = MAX_CHARS) -> Tagger:
    """Fit on a bounded sample of the labelled rows for which ``learn`` holds; see ``labelled.sample`` for its bounds."""
    return fit(sample(docs, labels, label_col, learn, id_col, text_col, per_class, max_chars))


def score_toxicity(docs: DataFrame, tagger: Tagger, text_col: str = "text", score_col: str = "score", spans_col: str = "spans", stretch: int = RUN) -> DataFrame:
    """``docs`` with a score (0 to 1) and spans: character offsets and largest marginal of each toxic stretch.

    Whole texts are scored. Null and empty texts, and texts without words, get the score of a largest marginal of 0 and no
    spans. Columns of the names given are replaced; all others are kept. The tagger is broadcast: its size is bounded by the sample.
    """
    kept = [c for c in docs.columns if c not in (score_col, spans_col)]
    place = kept.index(text_col)
    schema = docs.select(*kept).schema
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float32())])

    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def spans_of(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[dict]:
        hot = np.flatnonzero(p >= 0.5)
        return [{"start": int(start[g[0]]), "end": int(end[g[-1]]), "p": float(p[g].max())}
                for g in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1) if len(g)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        table = tagger.table()
        for part in runs(batches, text_col, stretch):
            data, offsets = flat(part.column(place))
            if part.num_rows == 1 and len(data) > 2 * stretch:
                p, start, end = tagger.tag_long(data, table, stretch)
                tops, spans = np.array([float(p.max(initial=0))]), [spans_of(p, start, end)]
            else:
                w = words(part.column(place))
                p = tagger.tag(w, table)
                tops, spans = _tops(w.first, p), [[] for _ in range(part.num_rows)]
                toxic = np.flatnonzero(tops >= 0.5)
                if len(toxic):
                    chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                    for d in toxic.tolist():
                        own = slice(w.first[d], w.first[d + 1])
                        zero = chars[w.offsets[d]]
                        spans[d] = spans_of(p[own], chars[w.start[own]] - zero, chars[w.end[own]] - zero)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tagger.calibrated(tops)), pa.array(spans, pa.list_(span))],
                                             [*part.schema.names, score_col, spans_col])

    return docs.select(*kept).mapInArrow(run, StructType([*schema, StructField(score_col, DoubleType()), StructField(spans_col, SPANS)]))
