"""Both plans of the ordered and ranking helpers against pandas, on a lopsided key."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered as O, ranking as R, windows as W


@pytest.fixture(scope="module")
def ticks(spark):
    rng = np.random.default_rng(1)
    n = 1500
    pdf = pd.DataFrame({
        "symbol": rng.choice(["A", "B", "C"], n, p=[0.7, 0.2, 0.1]),
        "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.permutation(n * 7)[:n], unit="s"),
        "v": rng.normal(size=n).round(1)})
    return pdf.sort_values(["symbol", "ts"]).reset_index(drop=True), spark.createDataFrame(pdf).cache()


def ordered(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def minute():
    return F.date_trunc("minute", "ts")


def test_positions(ticks):
    pdf, df = ticks
    for cell in (None, minute()):
        got = ordered(O.positions(df, ["symbol"], ["ts"], cell))
        assert (got["_pos"] == pdf.groupby("symbol").cumcount()).all()


def test_running(ticks):
    pdf, df = ticks
    aggs = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "n": ("count", "v"), "l": ("last", "v")}
    for cell in (None, minute()):
        got = ordered(O.running(df, ["symbol"], ["ts"], aggs, cell))
        g = pdf.groupby("symbol")["v"]
        assert np.allclose(got["s"], g.cumsum()) and (got["hi"] == g.cummax()).all() and (got["lo"] == g.cummin()).all()
        assert (got["n"] == g.cumcount() + 1).all() and (got["l"] == pdf["v"]).all()


def test_blocks_keep_frames_whole(ticks):
    pdf, df = ticks
    indexed = O.positions(df, ["symbol"], ["ts"], minute())
    add = lambda d, w: d.withColumn("m", F.sum("v").over(w.rowsBetween(-6, 4)))
    got = ordered(O.in_blocks(indexed, ["symbol"], 6, 4, 10, add))
    want = pdf.groupby("symbol")["v"].transform(
        lambda x: pd.Series([x.iloc[max(0, i - 6):i + 5].sum() for i in range(len(x))], x.index))
    assert len(got) == len(pdf) and np.allclose(got["m"], want)


@pytest.mark.parametrize("a", [0.0, 0.3, 0.9, 0.995])
def test_decay_scan(ticks, a):
    pdf, df = ticks
    first = F.col("_pos") == 0
    b = F.when(first, F.col("v")).otherwise(F.col("v") * (1 - a))
    got = ordered(O.decay_scan(O.positions(df, ["symbol"], ["ts"], minute()), ["symbol"], {"e": (b, a)}))
    want = pdf.groupby("symbol")["v"].transform(lambda x: x.ewm(alpha=1 - a, adjust=False).mean())
    assert np.abs(got["e"] - want).max() < 1e-10


def test_affine_scan(ticks):
    _, df = ticks
    rows = O.positions(df, ["symbol"], ["ts"], minute()).withColumn("a", F.abs(F.sin("v"))).withColumn("b", F.col("v"))
    got = ordered(O.affine_scan(rows, ["symbol"], "a", "b", "s", size=20, before="p"))
    state = {}
    for sym, a, b, s, p in got[["symbol", "a", "b", "s", "p"]].itertuples(index=False):
        past = state.get(sym, 0.0)
        assert p == pytest.approx(past, abs=1e-9)
        state[sym] = a * past + b
        assert s == pytest.approx(state[sym], abs=1e-9)


def test_ranks(ticks):
    pdf, df = ticks
    got = ordered(R.ordinal_rank(df, ["symbol"], "v", ["ts"]))
    want = pdf.sort_values(["symbol", "v", "ts"]).groupby("symbol").cumcount().sort_index() + 1
    assert (got["_rank"] == want).all()
    assert (got["_n"] == pdf.groupby("symbol")["v"].transform("size")).all()
    got = ordered(R.average_ranks(df, ["symbol"], {"r": "v"}))
    assert (got["r"] == pdf.groupby("symbol")["v"].rank()).all()


def test_quantiles(ticks):
    pdf, df = ticks
    probs = {"lo": 0.0, "third": 1 / 3, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    got = R.exact_quantiles(df, ["symbol"], "v", probs).toPandas().set_index("symbol").sort_index()
    want = pdf.groupby("symbol")["v"].quantile(list(probs.values())).unstack()
    assert np.allclose(got[list(probs)], want)
    nearest = R.exact_quantiles(df, [], "v", {"x": 0.37}, "nearest").collect()[0]["x"]
    assert nearest == pdf["v"].quantile(0.37, interpolation="nearest")


def test_one_hot_value(spark):
    rows = [("g", 0.0, i) for i in range(300)] + [("g", float(i), 300 + i) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    assert R.exact_quantiles(df, ["g"], "v", {"q": 0.5, "r": 0.9}).collect()[0][1:] == (0.0, pytest.approx(60.1))
    buckets = W.quantile_bucket(df, "v", 4, "g", "id").groupBy("quantile").count().collect()
    assert {r["count"] for r in buckets} == {100}


def test_value_cell_is_monotone(spark):
    xs = [float("-inf"), -1e300, -5.0, -1.0, -1e-300, 0.0, 1e-300, 0.5, 0.50001, 1.0, 3.0, 1e300, float("inf")]
    from tidemark.functions.columns import value_cell
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(value_cell("x")).collect()]
    assert got == sorted(got)


def test_rolling_span_matches_pandas(ticks):
    pdf, df = ticks
    got = ordered(W._rolling_span(df, "v", 600_000_000, "sum", "symbol", "ts", "o"))
    want = pdf.set_index("ts").groupby("symbol")["v"].rolling("600s").sum().reset_index(drop=True)
    assert np.abs(got["o"] - want).max() < 1e-9


def test_shuffled_input_gives_equal_output(ticks):
    _, df = ticks
    a = ordered(W.trailing_zscore(df, "v", "symbol", "ts", 5, "z"))
    b = ordered(W.trailing_zscore(df.repartition(7, "v"), "v", "symbol", "ts", 5, "z"))
    assert np.allclose(a["z"], b["z"], equal_nan=True)


def test_no_operator_orders_a_tick_table_in_one_window(ticks):
    """Plans over timestamps partition by (key, cell), never by the key alone."""
    _, df = ticks
    plan = W.momentum(df, 5, "symbol", "ts", "v")._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert wide and all("_cell" in line for line in wide)


def test_later_rows_change_no_earlier_zscore(spark):
    import datetime as dt

    values = [float(i * 7 % 5) for i in range(20)]
    for tail in ([], [1e17], [float("inf")], [float("nan"), 3.0], [-1e17, 1e17, 5.0]):
        rows = [("S", dt.datetime(2024, 1, 1 + i), v) for i, v in enumerate(values + tail)]
        df = spark.createDataFrame(rows, "symbol string, ts timestamp, v double")
        by_time = W.trailing_zscore(df, "v", "symbol", "ts", 4, "z").orderBy("ts").collect()
        by_date = W.trailing_zscore(df.withColumn("ts", F.to_date("ts")), "v", "symbol", "ts", 4, "z").orderBy("ts").collect()
        want = pd.Series(values)
        want = ((want - want.expanding(4).mean()) / want.expanding(4).std()).tolist()
        for got in (by_time, by_date):
            for r, w in zip(got, want):
                assert (r.z is None and math.isnan(w)) or r.z == pytest.approx(w, abs=1e-12), (tail, r, w)


def test_zscore_keeps_its_digits_far_from_zero(spark):
    import datetime as dt

    values = [0.0] + [1e9 + i % 3 for i in range(200)]
    rows = [("S", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=17 * i), v) for i, v in enumerate(values)]
    got = W.trailing_zscore(spark.createDataFrame(rows[1:], "symbol string, ts timestamp, v double"), "v", "symbol", "ts", 4, "z").orderBy("ts").collect()
    want = pd.Series([v - 1e9 for v in values[1:]])
    want = ((want - want.expanding(4).mean()) / want.expanding(4).std()).tolist()
    assert all(r.z == pytest.approx(w, abs=1e-6) for r, w in list(zip(got, want))[3:])


def test_a_shared_value_is_ranked_by_many_tasks(spark):
    from pyspark.sql import Window

    n = 60_000
    df = spark.range(n).select(F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("symbol"),
                               F.when(F.col("id") % 20 == 0, F.col("id").cast("double")).otherwise(0.0).alias("v"), F.lit("2024-01-05").alias("period"))
    settings = {"spark.sql.shuffle.partitions": "400", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ranked = R.ordinal_rank(df, ["period"], "v", ["symbol"])
        tasks = ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
        assert tasks[1] == n and tasks[0] < 0.01 * n
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    plain = df.withColumn("w", F.row_number().over(Window.orderBy("v", "symbol"))).select("symbol", "w")
    assert ranked.join(plain, "symbol").filter("_rank <> w or _n <> 60000").count() == 0
    spark.catalog.clearCache()


def test_rows_without_a_period_are_ranked_among_themselves(spark):
    df = spark.createDataFrame([(None, "A", 1.0), (None, "B", 1.0), ("p", "A", 3.0), ("p", "B", None)], "period string, symbol string, v double")
    got = {(r.period, r.symbol): (r._rank, r._n) for r in R.ordinal_rank(df, ["period"], "v", ["symbol"]).collect()}
    assert got == {(None, "A"): (1, 2), (None, "B"): (2, 2), ("p", "A"): (1, 1)}
    got = {(r.period, r.symbol): r.r for r in R.average_ranks(df, ["period"], {"r": "v"}).collect()}
    assert got == {(None, "A"): 1.5, (None, "B"): 1.5, ("p", "A"): 1.0}
