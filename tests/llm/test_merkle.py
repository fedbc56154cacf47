"""Merkle manifests against trees built by hand in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.merkle import fold, manifest, proof_digest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, _by int, path string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests):
    """(root, path of every digest)."""
    paths, level, homes = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for p, at in zip(paths, homes):
            run = runs[at // 16]
            p.append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
        homes = [at // 16 for at in homes]
        level = [h("".join(r)) for r in runs]
    return level[0], paths


def brute(rows, change=lambda r: r):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done[s] = climb([leaf(r) for r in groups[s]])
    root, ways = climb([done[s][0] for s in names])
    out = []
    for s, way in zip(names, ways):
        for r, path in zip(groups[s], done[s][1]):
            x = leaf(change(r))
            for left, right in path + way:
                x = h(left + x + right)
            out.append((r[0], leaf(r), done[s][0], root, h("".join(a + b for a, b in path + way)), x))
    return out


def got(spark, rows, changed=None):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    out = manifest(df, COLUMNS, "source", "doc_id", changed or {"text": F.col("text")})
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", proof_digest("path"), fold("path", "changed_leaf")).collect()]


def same(a, b):
    key = lambda r: tuple(str(v) for v in r)
    return sorted(a, key=key) == sorted(b, key=key)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 257])
def test_one_group_of_any_size(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert same(got(spark, rows), brute(rows))


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, None, "en", 3, "abc"), (1, None, "en", 3, "abd"), (7, "é", "de", 0, ""),
            (7, "z", "de", 9, "Ünï \x00 code"), (7, "", "de", 9, "-"), (-5, "z", None, 1, "LONG " * 300_000), *[(i, "many", "en", i, str(i)) for i in range(300)],
            *[(i, f"group {i}", "en", i, "T") for i in range(40)]]
    assert same(got(spark, rows), brute(rows))


def test_changed_rows_miss_the_root(spark):
    rows = [(i, f"s{i % 3}", "en", i, "ABC" if i % 2 else "abc") for i in range(60)]
    out = got(spark, rows, {"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lower("text")).otherwise(F.col("text"))})
    lowered = lambda r: (*r[:4], r[4].lower()) if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
    assert same(out, brute(rows, lowered))
    missed = {r[0] for r in out if r[5] != r[3]}
    assert missed == {r[0] for r in rows if lowered(r) != r} and missed


def test_more_blocks_than_one(spark):
    n = 2 * 4096 + 30  # two whole blocks and a short one, beside a small group
    rows = [(i, "hot" if i < n else "cold", "en", 1, str(i)) for i in range(n + 20)]
    assert same(got(spark, rows), brute(rows))


def test_blocks_are_grouped_in_one_shuffle_and_no_python(spark):
    from tidemark.llm.files import shared_folder
    from tidemark.llm import merkle

    nodes = spark.range(100).select(F.concat(F.lit("s"), F.col("id") % 1).alias("g"), F.col("id").alias("_pos"), (F.col("id") * 0 + 100).alias("_n"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    seen = []
    written, merkle.written = merkle.written, lambda df, folder: seen.append(df) or written(df, folder)
    try:
        merkle.grow(nodes, ["g"], shared_folder(spark, "merkle-plan"))
    finally:
        merkle.written = written
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_no_rows(spark):
    assert got(spark, []) == []
