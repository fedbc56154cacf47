"""Neighbour votes against a plain computation, edge rows, and held-out accuracy."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa

from tidemark.llm.quality import NEIGHBOURS, SHARPNESS, fit, score_quality, terms
from tidemark.llm.text import words
from tidemark.llm.labelled import distinct

GOOD = [f"A quiet sentence number {i} tells of rivers, hills and towns. It goes on a while, then stops." for i in range(40)]
JUNK = [f"buy{i}!!! $$$ NOW*** ### free{i}%%% BUY!!! $$$" for i in range(40)]
ROWS = [(t, 1) for t in GOOD] + [(t, 0) for t in JUNK]


def test_votes_equal_plain_cosines():
    voters = fit(ROWS)
    counts = terms(words(pa.array(["A calm sentence of hills and rivers.", "$$$ WIN!!! ###", "", "x"])))
    got = voters.score(counts)
    for c, score in zip(counts, got):
        v = c * voters.idf
        v = v / max(np.linalg.norm(v), 1e-9) @ voters.basis
        cosine = voters.vectors @ (v / max(np.linalg.norm(v), 1e-9))
        near = np.sort(cosine)[::-1][:NEIGHBOURS]
        at = np.argsort(-cosine, kind="stable")[:NEIGHBOURS]
        weight = np.clip(near, 0, None) ** SHARPNESS + 1e-9
        assert abs(score - (weight * voters.labels[at]).sum() / weight.sum()) < 0.35
    assert got[0] > 0.9 and got[1] < 0.1


def test_edge_rows(spark):
    voters = fit(ROWS)
    rows = [(1, GOOD[0], "a"), (2, JUNK[0], "a"), (3, None, "a"), (4, "", "a"), (None, GOOD[1], "a"), (1, GOOD[0], "a"), (6, "word " * 60_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = score_quality(df, voters).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, r.text): r.score for r in got}
    assert by[1, GOOD[0]] > 0.9 > 0.1 > by[2, JUNK[0]] and by[3, None] == by[4, ""]
    assert score_quality(df.limit(0), voters).count() == 0
    assert {r.score for r in score_quality(df, fit([])).collect()} == {0.5}


def test_near_copies_count_once():
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(base, 1), (base + " more", 1), ("w0 " + base, 1), (base, 0), ("other words entirely here now", 1), ("!!", 1), ("!!", 1)]
    assert [r[0] for r in distinct(rows)] == [base, base, "other words entirely here now", "!!", "!!"]


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.1"
    got = entry.queries()["op1_quality"](spark, sf).toPandas()
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df()
    both = got.merge(labels, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    out = both[both.held_out]
    assert (out.predicted == out.quality).mean() > 0.97
    assert ((out.predicted == 0) & (out.quality == 0)).sum() / (out.quality == 0).sum() > 0.85


def test_sample_passes_over_one_huge_text(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.labelled import sample

    ids = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label")).orderBy(F.xxhash64("id")).collect()
    huge = ids[0].doc_id
    docs = spark.createDataFrame([(r.doc_id, "x" * 300_000 if r.doc_id == huge else f"text {r.doc_id} " * 20) for r in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(r.doc_id, r.label) for r in ids], "doc_id long, label long")
    got = sample(docs, labels, "label", F.lit(True), per_class=(50, 50), max_chars=250_000)
    assert [sum(label == k for _, label in got) for k in (0, 1)] == [50, 50] and max(len(t) for t, _ in got) < 1000
    assert got == sample(docs.repartition(3), labels, "label", F.lit(True), per_class=(50, 50), max_chars=250_000)
