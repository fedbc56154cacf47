"""The random field's messages against enumeration, spans on planted words, and held-out accuracy."""

import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.toxicity import fit, marginals, score_toxicity


@pytest.mark.parametrize("sizes", [[1, 4, 0, 7], [9]])
def test_marginals_by_enumeration(sizes):
    rng = np.random.default_rng(1)
    first = np.concatenate([[0], np.cumsum(sizes)])
    score = rng.normal(0, 2, first[-1])
    enter, leave, stay = -1.0, 0.3, 0.8
    p, moves = marginals(first, score, enter, leave, stay)
    want, counts = np.zeros(len(score)), np.zeros(3)
    for a, b in zip(first[:-1], first[1:]):
        paths, weights = list(itertools.product([0, 1], repeat=b - a)), []
        for path in paths:
            total, before = 0.0, 0
            for t, y in enumerate(path):
                total += score[a + t] * y + {(0, 0): 0.0, (0, 1): enter, (1, 0): leave, (1, 1): stay}[before, y]
                before = y
            weights.append(math.exp(total))
        for path, w in zip(paths, weights):
            share, before = w / sum(weights), 0
            for t, y in enumerate(path):
                want[a + t] += share * y
                counts += share * np.array([(before, y) == (0, 1), (before, y) == (1, 0), (before, y) == (1, 1)])
                before = y
    assert np.allclose(p, want) and np.allclose(moves, counts)


def test_long_chains_equal_short_steps():
    rng = np.random.default_rng(2)
    score = rng.normal(-1, 3, 1000)
    p, _ = marginals(np.array([0, 1000]), score, -1.0, -0.5, 0.4)
    t = np.exp([[0, -1.0], [-0.5, 0.4]])
    a = np.zeros((1000, 2))
    for i in range(1000):
        a[i] = (np.array([1.0, 0.0]) if i == 0 else a[i - 1]) @ t * [1, math.exp(score[i])]
        a[i] /= a[i].sum()
    b = np.ones((1000, 2))
    for i in range(998, -1, -1):
        b[i] = t @ ([1, math.exp(score[i + 1])] * b[i + 1])
        b[i] /= b[i].sum()
    want = a * b
    assert np.allclose(p, want[:, 1] / want.sum(1))


def planted(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = ["".join(rng.choice(["ba", "no", "ti", "ra", "lu"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vilest", "wretch" + rng.choice(["ed", "es", "ing"])])
        rows.append((" ".join(w), int(bad)))
    return rows


def test_spans_and_edges(spark):
    tagger = fit(planted(400, 1))
    rows = [(1, "banora vilest tira", 0), (2, "banora tira lulu", 0), (3, None, 0), (4, "", 0), (None, "é Wretchedly. no", 0), (6, "!!!", 0),
            (2, "banora tira lulu", 0), (7, "bano " * 40_000 + "vilest", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {(r.doc_id, r.text): r for r in score_toxicity(df, tagger).collect()}
    cut = lambda r: [r.text[s.start:s.end] for s in r.spans]
    assert cut(got[1, rows[0][1]]) == ["vilest"] and cut(got[None, rows[4][1]]) == ["Wretchedly"] and cut(got[7, rows[7][1]]) == ["vilest"]
    for key in ((1, rows[0][1]), (None, rows[4][1]), (7, rows[7][1])):
        assert got[key].score > 0.6
    for key in ((2, rows[1][1]), (3, None), (4, ""), (6, "!!!")):
        assert got[key].score < 0.3 and got[key].spans == []
    assert score_toxicity(df.limit(0), tagger).count() == 0


def test_one_class_only():
    assert fit([]).calibrated(np.array([0.0, 1.0])).max() < 0.01
    assert fit([("a b", 0), ("c d", 0)]).calibrated(np.array([0.5])).max() < 0.01
    assert fit([("a b", 1)]).calibrated(np.array([0.0])).min() > 0.99


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.1"
    got = entry.queries()["op5_toxicity"](spark, sf).toPandas()
    labels = duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").df()
    both = got.merge(labels, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    out = both[both.held_out]
    hits = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hits / (out.toxic == 1).sum() > 0.8 and hits / (out.predicted == 1).sum() > 0.8


def test_long_texts_are_scored_alike_in_stretches(spark):
    from tidemark.llm import toxicity as module
    from tidemark.llm.text import words

    rng = np.random.default_rng(2)
    vocabulary = ["vile" + c for c in "abc"] + [f"word{i}" for i in range(30)] + ["é", "naïve", "x" * 400]
    texts = ["".join(vocabulary[i] + [" ", ", ", "\n", "... "][j] for i, j in zip(rng.integers(0, len(vocabulary), n), rng.integers(0, 4, n))) for n in (1, 7, 300, 2500)]
    texts += [" .,", "x" * 5000, " " * 3000 + "vilea" + " " * 3000, ""]
    keys = np.unique(np.concatenate(module.features(words(pa.array(texts)))))
    tagger = module.Tagger(keys, rng.normal(0, 1.5, len(keys)).astype(np.float32), -1.0, -0.7, 0.2, 0.9)
    table = tagger.table()
    for text in texts:
        w = words(pa.array([text]))
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        for size in (60, 1000):
            if not text:
                continue
            p, start, end = tagger.tag_long(np.frombuffer(text.encode(), np.uint8), table, size)
            assert np.allclose(p, tagger.tag(w, table), atol=1e-4)
            assert (start == chars[w.start]).all() and (end == chars[w.end]).all()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    small = {r.doc_id: r for r in module.score_toxicity(df, tagger, stretch=500).collect()}
    whole = {r.doc_id: r for r in module.score_toxicity(df, tagger).collect()}
    for i, r in whole.items():
        assert small[i].score == pytest.approx(r.score, abs=1e-3) and [(x.start, x.end) for x in small[i].spans] == [(x.start, x.end) for x in r.spans]
