"""Hand-computed fills, books and performance values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import trades as T
from tidemark.operators.trades import position_ledger
from tidemark.session import scope

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)
FILLS = "order_id long, symbol string, side string, price double, quantity long, ts timestamp, commission double"


def fills(spark, *rows):
    data = [(i + 1, r[0], r[1], float(r[2]), r[3], T0 + i * DAY, float(r[4]) if len(r) > 4 else 0.0)
            for i, r in enumerate(rows)]
    return spark.createDataFrame(data, FILLS)


def curve(spark, points):
    return spark.createDataFrame([(T0 + i * DAY, float(e)) for i, e in enumerate(points)], "date timestamp, equity double")


def ledger(df):
    return df.orderBy("order_id").collect()


def test_round_trips(spark):
    f = fills(spark, ("A", "Buy", 100, 10), ("A", "Sell", 110, 10), ("A", "Buy", 100, 10), ("A", "Sell", 90, 10))
    assert [r["pnl"] for r in T.realized_pnl(f).orderBy("ts").collect()] == [100.0, -100.0]
    stats = T.trade_stats(f).collect()[0]
    assert stats["win_rate_pct"] == 50.0 and stats["profit_factor"] == 1.0 and stats["total_trades"] == 2


def test_short_round_trip_and_open_only(spark):
    short = fills(spark, ("A", "Sell", 100, 10), ("A", "Buy", 90, 10))
    assert [r["pnl"] for r in T.realized_pnl(short).collect()] == [100.0]
    opened = fills(spark, ("A", "Buy", 100, 10), ("B", "Buy", 100, 10))
    assert T.realized_pnl(opened).count() == 0
    row = T.performance_summary(curve(spark, [100.0, 101.0]), opened, 100.0).collect()[0]
    assert row["win_rate_pct"] == 0.0 and row["total_trades"] == 0 and row["profit_factor"] == 0.0


def test_ledger_partial_flip_close(spark):
    part = ledger(T.position_ledger(fills(spark, ("A", "Buy", 100, 100), ("A", "Sell", 110, 40))))[-1]
    assert (part["quantity"], part["avg_entry"], part["realized_total"]) == (60.0, 100.0, 400.0)
    flip = ledger(T.position_ledger(fills(spark, ("A", "Buy", 100, 100), ("A", "Sell", 110, 150))))[-1]
    assert (flip["quantity"], flip["avg_entry"], flip["realized_total"]) == (-50.0, 110.0, 1000.0)
    shut = ledger(T.position_ledger(fills(spark, ("A", "Buy", 100, 100), ("A", "Sell", 110, 100))))[-1]
    assert shut["quantity"] == 0.0 and shut["avg_entry"] is None


def test_commission_counts_in_pnl_only(spark):
    f = fills(spark, ("A", "Buy", 100, 10, 1), ("A", "Sell", 110, 10, 2))
    assert T.realized_pnl(f).collect()[0]["pnl"] == 98.0
    assert ledger(T.position_ledger(f))[-1]["realized"] == 100.0


BARS = "symbol string, date date, open double, high double, low double, close double, volume long"


def test_mark_to_market(spark):
    day = T0.date()
    bars = spark.createDataFrame([("AAPL", day, 160.0, 160.0, 160.0, 160.0, 1)], BARS)
    row = T.equity_curve(fills(spark, ("AAPL", "Buy", 150, 100, 1)), bars).collect()[0]
    assert row["equity"] == 100000.0 - 15000.0 - 1.0 + 16000.0 and row["gross_notional"] == 16000.0
    power = T.buying_power(T.equity_curve(fills(spark, ("AAPL", "Buy", 150, 100, 1)), bars), 0.5).collect()[0]
    assert power["buying_power"] == row["equity"] / 0.5 - 16000.0


def test_equity_keeps_every_symbol(spark):
    d0, d1 = T0.date(), (T0 + DAY).date()
    bars = spark.createDataFrame([("A", d0, 10.0, 10.0, 10.0, 10.0, 1), ("B", d0, 20.0, 20.0, 20.0, 20.0, 1),
                                  ("B", d1, 30.0, 30.0, 30.0, 30.0, 1)], BARS)
    f = spark.createDataFrame([(1, "A", "Buy", 10.0, 5, T0, 0.0), (2, "B", "Buy", 20.0, 5, T0, 0.0)], FILLS)
    got = {r["date"]: r["equity"] for r in T.equity_curve(f, bars, 1000.0).collect()}
    assert got == {d0: 1000.0, d1: 1050.0}


def order(kind, side, limit=None, stop=None, qty=50.0):
    return (1, "A", T0.date(), side, kind, "Day", qty, limit, stop)


ORDERS = ("id long, symbol string, date date, side string, type string, tif string, quantity double, "
          "limit_price double, stop_price double")


@pytest.mark.parametrize("o,bar,price", [
    (order("Market", "Buy"), (100, 105, 95, 102), 102.0),
    (order("Limit", "Buy", 96.0), (100, 105, 95, 102), 96.0),
    (order("Limit", "Buy", 90.0), (100, 102, 98, 101), None),
    (order("Limit", "Sell", 104.0), (100, 105, 95, 102), 104.0),
    (order("Limit", "Sell", 99.0), (100, 105, 95, 102), 100.0),
    (order("Stop", "Sell", None, 94.0), (100, 105, 93, 95), 94.0),
    (order("Stop", "Buy", None, 104.0), (100, 105, 93, 95), 104.0),
    (order("StopLimit", "Sell", 93.5, 94.0), (100, 105, 93, 95), 93.5),
    (order("StopLimit", "Buy", 93.5, 94.0), (100, 105, 93, 95), None),
])
def test_fill_model(spark, o, bar, price):
    bars = spark.createDataFrame([("A", T0.date(), *map(float, bar), 10000)], BARS)
    rows = T.label_fills(spark.createDataFrame([o], ORDERS), bars, bps=0.0).collect()
    assert [r["price"] for r in rows] == ([] if price is None else [price])
    if rows:
        assert rows[0]["quantity"] == 50 and rows[0]["commission"] == 1.0


def test_slippage(spark):
    o = spark.createDataFrame([("Buy", 150.0, 100.0), ("Sell", 150.0, 1000.0)], "side string, price double, quantity double")
    buy, sell = T.market_cost(o, bps=2.0).collect()
    assert buy["fill_price"] == pytest.approx(150 * 1.0002) and sell["fill_price"] == pytest.approx(150 * 0.9998)
    assert buy["commission"] == 1.0 and sell["commission"] == 5.0
    own = T.market_cost(o, commission=F.lit(7.0)).collect()
    assert {r["commission"] for r in own} == {7.0}


def test_curve_measures(spark):
    points, e = [], 100_000.0
    for i in range(252):
        points.append(e)
        e *= 1.002 if i % 2 == 0 else 1.0005
    c = curve(spark, points)
    assert T.sharpe_ratio(c).collect()[0][0] > 0 and T.daily_volatility_pct(c).collect()[0][0] > 0
    assert T.max_drawdown_pct(c).collect()[0][0] == 0.0 and T.sortino_ratio(c).collect()[0][0] == 0.0
    dip = curve(spark, [100, 120, 80, 110])
    assert T.max_drawdown_pct(dip).collect()[0][0] == pytest.approx(33.3333333)


def test_annualised_and_empty(spark):
    row = spark.sql("select timestamp'2020-01-01' a, timestamp'2021-12-31' b, 28.0D t")
    years = row.select(T.annualized_return_pct("t", "a", "b").alias("x"), T.annualized_return_pct("t", "b", "a").alias("y"))
    assert years.collect()[0][:] == (pytest.approx(13.137, abs=0.01), 0.0)
    none = fills(spark, ("A", "Buy", 100, 10)).limit(0)
    flat = T.performance_summary(curve(spark, [100.0]), none, 100.0).collect()[0]
    assert flat["total_return_pct"] == 0.0 and flat["sharpe_ratio"] == 0.0 and flat["calmar_ratio"] == 0.0


def test_grouped_summary(spark):
    f = fills(spark, ("A", "Buy", 100, 10), ("A", "Sell", 110, 10), ("A", "Buy", 100, 10), ("A", "Sell", 90, 10))
    f = f.withColumn("account", F.when(F.col("order_id") <= 2, "x").otherwise("y"))
    c = curve(spark, [100, 110, 105, 120]).withColumn("account", F.explode(F.array(F.lit("x"), F.lit("y"))))
    rows = {r["account"]: r for r in T.performance_summary(c, f, 100.0, ["account"]).collect()}
    assert rows["x"]["win_rate_pct"] == 100.0 and rows["y"]["win_rate_pct"] == 0.0
    assert rows["x"]["total_return_pct"] == pytest.approx(20.0)


def test_book_runs_in_the_jvm_and_scopes_release_what_it_kept(spark):
    rows = [(i, f"S{i % 2}", "Buy" if i % 3 else "Sell", 10.0 + i % 5, 1 + i % 4, dt.datetime(2024, 1, 1, i // 60, i % 60), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "order_id long, symbol string, side string, price double, quantity long, ts timestamp, commission double")
    caches = spark._jsparkSession.sharedState().cacheManager()
    spark.catalog.clearCache()
    with scope():
        book = position_ledger(df)
        plan = book._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
        assert book.count() == 200 and not caches.isEmpty()
    assert caches.isEmpty()


def test_one_day_with_very_many_fills_is_no_single_window(spark):
    from tidemark.operators.trades import position_ledger

    n = 4000
    df = spark.range(n).select(
        F.col("id").alias("order_id"), F.lit("A").alias("symbol"), F.when(F.col("id") * 7 % 5 < 3, "Buy").otherwise("Sell").alias("side"),
        (100.0 + F.col("id") * 13 % 17).alias("price"), (1 + F.col("id") * 11 % 9).alias("quantity"), F.lit("2024-01-05").cast("date").alias("ts"), F.lit(1.0).alias("commission"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ledger = position_ledger(df)
        got = ledger.orderBy("order_id").collect()
        plan = ledger._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
        spark.catalog.clearCache()
    quantity, cost, total = 0.0, 0.0, 0.0
    for i, r in enumerate(got):
        price, signed = 100.0 + i * 13 % 17, (1 + i * 11 % 9) * (1 if i * 7 % 5 < 3 else -1)
        after = quantity + signed
        if quantity == 0 or (quantity > 0) == (signed > 0):
            cost = (cost * abs(quantity) + price * abs(signed)) / abs(after)
        else:
            total += (price - cost) * min(abs(signed), abs(quantity)) * (1 if quantity > 0 else -1)
            if after and (after > 0) != (quantity > 0):
                cost = price
        quantity = after
        assert r.quantity == quantity and r.realized_total == pytest.approx(total, abs=1e-6), (i, r)
        assert (r.avg_entry is None) == (quantity == 0) and (quantity == 0 or r.avg_entry == pytest.approx(cost, abs=1e-9))
    # Windows over rows go by symbol and cell; those over a symbol alone see one row per cell.
    assert "_part" in plan
