"""Near-duplicate groups and link counts against all pairs on small corpora."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard
from tidemark.llm.components import components
from tidemark.llm.jaccard import HASHES, _overlaps, least_matches, near_duplicates, signatures, surviving
from tidemark.llm.text import shingles, words


def grams(text):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """{row number: (class id, links)}"""
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    members = {}
    for a in range(len(rows)):
        members.setdefault(find(a), []).append(a)
    least = {r: min((rows[a][0] for a in m if rows[a][0] is not None), default=None) for r, m in members.items()}
    return [(rows[a][0] if not sets[a] else least[find(a)], links[a]) for a in range(len(rows))]


def corpus(seed, groups, size, words_each=60):
    rng = random.Random(seed)
    make = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for _ in range(groups):
        base = make(rng.randint(20, words_each))
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"w{rng.randrange(4000)}"
            rows.append(" ".join(w))
    ids = rng.sample(range(10 * len(rows)), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("block", [1024, 4])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "VERIFY_BLOCK", block)
    rows = corpus(5, 30, 9)
    rows += [(9001, "One two three"), (9000, "one, TWO three!"), (9002, "one two four"), (9003, None), (9004, ""), (9005, "..!"), (9006, "..!"),
             (None, rows[0][1]), (None, "all alone here with no id at all"), (None, None), (9010, "same row twice over and over again"),
             (9010, "same row twice over and over again"), (9011, "long " * 30_000), (9012, "Long " * 29_000 + "end")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, class string, key int").repartition(3)
    got = near_duplicates(df).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=key) == \
        sorted([(i, c, n) for (i, _), (c, n) in zip(rows, brute(rows))], key=key)
    firsts = {}
    for r in got:
        if r.first and r.class_id is not None and r.n_links:
            firsts.setdefault(r.class_id, set()).add((r.doc_id, r.key))
    assert all(len(v) == 1 for v in firsts.values()) and set(firsts) == {r.class_id for r in got if r.n_links and r.class_id is not None}


def test_large_group_of_different_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    monkeypatch.setattr(jaccard, "VERIFY_BLOCK", 32)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(len(w))] = f"own{i}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, 0, 149) for i in range(150)} == {(i, c, n) for (i, _), (c, n) in zip(rows, brute(rows))}


def test_posterior_bound():
    # The bound falls far below the expected matches at the threshold and rises with the number compared.
    need = least_matches(0.8, 1e-6)
    n = np.arange(16, HASHES + 1, 16)
    assert (need < 0.8 * n).all() and (np.diff(need) > 0).all() and need[-1] > 0.55 * HASHES
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (2000, HASHES)).astype(np.uint16)
    same = rng.random(a.shape) < 0.8
    b = np.where(same, a, rng.integers(0, 1 << 16, a.shape)).astype(np.uint16)
    kept = [surviving(a[i:i + 1], b[i:i + 1], need)[0, 0] for i in range(2000)]
    assert all(kept)
    low = np.where(rng.random(a.shape) < 0.3, a, rng.integers(0, 1 << 16, a.shape)).astype(np.uint16)
    assert not any(surviving(a[i:i + 1], low[i:i + 1], need)[0, 0] for i in range(2000))


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    other = base[:360] + [f"x{i}" for i in range(40)]
    value, doc, _ = shingles(words(pa.array([" ".join(base), " ".join(other), "", " ".join(rng.sample(base, 400))])), 5)
    sig = signatures(value, doc, 4)
    exact = 356 / (396 + 396 - 356)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.12 and (sig[0] == sig[3]).mean() < 0.1 and not sig[2].any()


def test_overlaps_either_way():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, 80)).astype(np.uint64) for _ in range(30)]
    pairs = np.argwhere(np.triu(np.ones((30, 30), bool), 1))
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in pairs]
    assert _overlaps(sets, sets, pairs).tolist() == want
    assert _overlaps(sets, sets, pairs[:3]).tolist() == want[:3]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(7, 7), (-3, 100)] + [
        (rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    root = {x: x for e in edges for x in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()
    assert {(r.id, r.component) for r in got} == {(x, find(x)) for x in root} and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_documents(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
