"""Exact top-k against brute force, with ties, equal vectors and rows that take no part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk
from tidemark.llm.topk import Shard, rounded, top_k


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(64 * x) for x in v]
    out = []
    for q in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard,queries,ranges,group", [(4096, 1024, 4096, 32), (16, 3, 4096, 32), (16, 3, 3, 2)])
def test_equals_brute_force(spark, monkeypatch, shard, queries, ranges, group):
    for name, value in zip(("SHARD", "QUERIES", "RANGES", "GROUP"), (shard, queries, ranges, group)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(3)
    common = [rng.gauss(0, 0.2) for _ in range(12)]
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(150)]
    rows += [(i, common) for i in range(150, 230)] + [(i, [0.0] * 12) for i in range(230, 245)] + [(i, [float(i % 2)] * 12) for i in range(245, 262)]
    rows += [(300, None), (320, []), (340, [float("nan")] * 12), (341, [float("inf")] + [0.0] * 11), (342, [None] + [0.0] * 11), (None, common),
             (360, [1.0, 2.0]), (20, rows[20][1]), (-40, [-x for x in common])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string").repartition(5)
    got = sorted(tuple(r) for r in top_k(rounded(df), F.col("vec_id") % 20 == 0, 20).collect())
    assert got == brute(rows, 20)


def test_pruning_keeps_every_result():
    rng = np.random.default_rng(1)
    for scale in (3, 40, 3000, 1 << 20):
        centres = rng.integers(-scale, scale + 1, (8, 32))
        x = centres[rng.integers(0, 8, 500)] + rng.integers(-scale // 3, scale // 3 + 1, (500, 32))
        ids = rng.permutation(500).astype(np.int64)
        shard = Shard(ids, x)
        queries = x[:40] * rng.choice([-1, 1], (40, 1))
        again = Shard.unpack(500, shard.pack())
        for q, (near, score) in zip(queries, again.search(queries, 7)):
            full = x @ q
            order = np.lexsort((ids, -full))[:7]
            assert near.tolist() == ids[order].tolist() and score.tolist() == full[order].tolist()


def test_a_reached_score_prunes_and_keeps_ties():
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 10, (400, 24))
    x[200:220] = x[180:200]  # equal scores on both sides of every bound
    ids = rng.permutation(400).astype(np.int64)
    queries, k = x[:30], 9
    shards = [Shard(ids[a:a + 100], x[a:a + 100]) for a in range(0, 400, 100)]
    full = queries @ x.T
    least = np.sort(full, axis=1)[:, -k]
    for some, bound in ((shards, np.full(30, topk.UNKNOWN)), (shards, least), (shards[:1], least)):
        n = 100 * len(some)
        for i, (near, score) in enumerate(topk._best(some, queries, k, bound)):
            order = [j for j in np.lexsort((ids[:n], -full[i, :n]))[:k] if full[i, j] >= bound[i]]
            assert near.tolist() == ids[order].tolist() and score.tolist() == full[i, order].tolist()
    free, bound = (shards[1].possible(queries, k, b).sum() for b in (np.full(30, topk.UNKNOWN), least))
    assert bound < free


def test_few_or_no_rows(spark):
    shape = "vec_id long, embedding array<float>"
    assert top_k(rounded(spark.createDataFrame([], shape)), F.col("vec_id") % 20 == 0).count() == 0
    assert top_k(rounded(spark.createDataFrame([(20, [1.0])], shape)), F.col("vec_id") % 20 == 0).count() == 0
    got = top_k(rounded(spark.createDataFrame([(20, [1.0]), (3, [-1.0]), (40, [0.5])], shape)), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(20, 1, 40, 2048), (20, 2, 3, -4096), (40, 1, 20, 2048), (40, 2, 3, -2048)]


def test_index_is_not_numbered_in_one_task(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    plan = top_k(rounded(df), F.col("vec_id") % 20 == 0, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(shard" not in plan and "Join Cross" not in plan and "broadcast" not in plan.lower()
