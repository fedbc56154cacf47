"""Text scores and alternative-data signals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import signal_label
from tidemark.functions.vocabularies import EVASIVE_PATTERNS, RISK_SEVERITY
from tidemark.operators import text as X
from tidemark.plans import signals as S

D = dt.date


def test_filing_diff_counts_new_risk_words(spark):
    texts = ["rivers supply our mills with power", "rivers supply our mills with power after the litigation and one penalty",
             "one penalty and the bankruptcy of mills", "one penalty and the bankruptcy of mills"]
    rows = [("M", D(2020 + i, 5, 5), i, t) for i, t in enumerate(texts)]
    got = X.filing_diff(spark.createDataFrame(rows, "symbol string, filed date, seq int, text string")).orderBy("seq").collect()
    words = [set(t.split()) for t in texts]
    weight = {w: RISK_SEVERITY[w] for w in ("litigation", "penalty", "bankruptcy")}
    for i, r in enumerate(got):
        new, old = (words[i] - words[i - 1], words[i - 1] - words[i]) if i else (set(), set())
        assert r["severity_score"] == sum(weight.get(w, 0) for w in new) and r["new_risk_count"] == len(new & set(weight))
        assert r["pct_changed"] == (round(100 * len(new | old) / len(words[i] | words[i - 1]), 2) if i else 0.0)


SHORT = "Margins are hard to quantify. We won't speculate on prices. Sales grew. No comment, for competitive reasons. The rest is uncertain."


def test_evasiveness(spark):
    df = spark.createDataFrame([(1, SHORT), (2, "Orders rose by a tenth this spring."), (3, ""), (4, None)], "id int, text string")
    rows = {r["id"]: r for r in X.evasiveness(df).collect()}
    held = [p for p in EVASIVE_PATTERNS if p in SHORT.lower()]
    assert len(held) == 5 == rows[1]["evasive_phrase_count"] and rows[1]["evasiveness_score"] > 0
    assert [m.lower() for m in rows[1]["sample_matches"]] == held
    assert all(rows[i]["evasive_phrase_count"] == 0 and not rows[i]["evasiveness_score"] for i in (2, 3))


def test_evasiveness_by_turn_equals_one_text(spark):
    turns = spark.createDataFrame([("c", i, t + ".") for i, t in enumerate(SHORT.split(". "))], "c string, t int, text string")
    whole = X.evasiveness(spark.createDataFrame([("c", SHORT)], "c string, text string")).collect()[0]
    parts = X.evasiveness_by(turns, "c", "t").collect()[0]
    for n in ("evasive_phrase_count", "evasiveness_score", "sample_matches"):
        assert whole[n] == parts[n]


def test_skill_tags(spark):
    df = spark.createDataFrame([("Machine learning on GPU clusters, PyTorch and AI, top secret",)], "description string")
    literal = {r["skill_category"]: r["count"] for r in X.skill_tags(df).collect()}
    assert literal["ai_ml"] == 1 and literal["gpu_hpc"] == 0 and literal["clearance"] == 1
    folded = {r["skill_category"]: r["count"] for r in X.skill_tags(df, ignore_case=True).collect()}
    assert folded["ai_ml"] == 3 and folded["gpu_hpc"] == 1


def test_literal_search_never_loses_a_match(spark):
    texts = ["C++x", "c++ only", "Ri\u017fc-V", "ap\u0130", "AP\u0131 x", "k8\u017f", "no"]
    df = spark.createDataFrame([(t,) for t in texts], "description string")
    patterns = {"a": [r"\bC\+\+\b", r"\bRISC-V\b", r"\bAPI\b", r"\bk8s\b"]}
    plain = df.select(sum((F.rlike("description", F.lit("(?iU)" + p)).cast("int") for p in patterns["a"]), F.lit(0)))
    got = [r["count"] for r in X.skill_tags(df, patterns, ignore_case=True).collect()]
    assert got == [r[0] for r in plain.collect()] and sum(got) >= 4


def test_labels_follow_the_score(spark):
    scores = [i / 8 for i in range(-24, 25)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in scores], "s double").select(signal_label("s")).collect()]
    order = ["STRONG_BEARISH", "BEARISH", "NEUTRAL", "BULLISH", "STRONG_BULLISH"]
    edges = [-1.5, -0.5, 0.5, 1.5]
    assert [order.index(x) for x in got] == [sum(x > e for e in edges) for x in scores]


def test_composite(spark):
    names = spark.createDataFrame([("BEAR",), ("EMPTY",), ("LIGHT",)], "symbol string")
    filing = spark.createDataFrame([("BEAR", 8, 20.0), ("LIGHT", 1, 5.0)], "symbol string, severity_score int, pct_changed double")
    evasive = spark.createDataFrame([("BEAR", 40.0)], "symbol string, evasiveness_score double")
    rows = {r["symbol"]: r for r in S.composite_signal(names, filing=filing, evasive=evasive).collect()}
    assert rows["EMPTY"]["composite_score"] == 0.0 and rows["EMPTY"]["interpretation"] == "NEUTRAL"
    assert rows["BEAR"]["composite_score"] == pytest.approx((-1.16 * 0.25 - 3 * 0.15) / 0.4)
    assert -1 < rows["LIGHT"]["filing_risk"] < 0


def test_price_overlay(spark):
    days = [(s, D(2024, 1, 1) + dt.timedelta(days=i), 100.0 + i) for s, n in (("L", 21), ("S", 20)) for i in range(n)]
    rows = S.price_overlay(spark.createDataFrame(days, "symbol string, date date, close double")).collect()
    assert [r["symbol"] for r in rows] == ["L"]
    assert rows[0]["price_mom"] == pytest.approx((120 / (sum(range(101, 121)) / 20) - 1) * 100)


def test_contract_surprise(spark):
    rows = [("V1", "A", 100.0, D(2024, 1, 1)), ("V1", "A", 100.0, D(2024, 4, 10)), ("V2", "B", 300.0, D(2024, 6, 1)),
            ("V1", "A", 100.0, D(2024, 6, 2))]
    df = spark.createDataFrame(rows, "vendor string, agency string, amount double, start_date date")
    row = S.contract_surprise(df, as_of="2024-07-01", days=50).collect()[0]
    assert row["recent_90d_awards"] == 400.0 and row["expected_90d_awards"] == pytest.approx(100.0)
    assert row["contract_surprise_ratio"] == pytest.approx(3.0) and row["award_concentration_hhi"] == pytest.approx(6250.0)
    assert row["unique_agencies"] == 2 and row["avg_award_size"] == 200.0


def test_spikes_on_constant_volume(spark):
    df = spark.createDataFrame([("A", 5.0)] * 10 + [("B", 1.0)] * 30 + [("B", 99.0)], "ticker string, share_volume double")
    assert [(r["ticker"], r["share_volume"]) for r in S.volume_spikes(df).collect()] == [("B", 99.0)]


def test_macro(spark):
    rows = [("CPIAUCSL", D(2023, m, 1), 100.0 + m) for m in range(1, 13)] + [("CPIAUCSL", D(2024, 1, 1), 106.1),
            ("UNRATE", D(2024, 1, 1), 6.5), ("SP500", D(2024, 1, 1), 5000.0)]
    df = spark.createDataFrame(rows, "series_id string, date date, value double")
    row = S.macro_regime(df).collect()[0]
    assert row["inflation_cpi"] == pytest.approx((106.1 / 101 - 1) * 100) and row["macro_score"] == -3.0
    assert row["regime"] == "RISK_OFF"
    assert S.series_spread(df, "UNRATE", "CPIAUCSL").collect()[0][0] == pytest.approx(6.5 - 106.1)
    assert S.latest_by_series(df).count() == 3


def test_evasiveness_by_without_samples(spark):
    rows = [("a", 1, "As I said, we will not speculate."), ("a", 2, "It is too early to tell, too early to say."), ("b", 1, "Plain words."), (None, 1, None)]
    turns = spark.createDataFrame(rows, "who string, turn int, text string")
    whole = X.evasiveness_by(turns, "who", "turn").drop("sample_matches")
    plain = X.evasiveness_by(turns, "who", "turn", samples=False)
    assert plain.columns == whole.columns and plain.exceptAll(whole).count() == 0 == whole.exceptAll(plain).count()
