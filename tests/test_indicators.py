"""Hand-computed indicator values."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators as I


def series(spark, closes, high=None, low=None):
    rows = [("A", i, float(c), float(high[i] if high else c), float(low[i] if low else c))
            for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, i int, close double, high double, low double")
    return df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i"))).drop("i")


def values(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_sma(spark):
    df = series(spark, [10, 20, 30, 40, 50])
    assert values(I.sma(df, 3), "sma_3") == [None, None, 20.0, 30.0, 40.0]
    assert values(I.sma(df, 3, "zero"), "sma_3") == [0.0, 0.0, 20.0, 30.0, 40.0]
    assert values(I.sma(series(spark, [1, 2]), 3, "zero"), "sma_3") == [0.0, 0.0]


def test_ema(spark):
    assert values(I.ema(series(spark, [10, 20, 30, 40]), 3), "ema_3") == pytest.approx([10, 15, 22.5, 31.25])


def test_rsi(spark):
    got = values(I.rsi(series(spark, [100, 102, 105, 103, 108]), 4), "rsi_4")
    assert got[0] == 0.0 and got[1:4] == [50.0] * 3 and got[4] == pytest.approx(83.3333333)
    assert values(I.rsi(series(spark, [5] * 8), 3), "rsi_3") == [0.0] + [50.0] * 7
    assert values(I.rsi(series(spark, range(1, 8)), 3), "rsi_3")[3:] == [100.0] * 4


def test_rsi_keeps_its_value_through_a_long_flat_stretch(spark):
    got = values(I.rsi(series(spark, [100, 103, 101, 104] + [104] * 400), 2), "rsi_2")
    assert got[-1] == pytest.approx(got[4]) and got[-1] not in (0.0, 50.0, 100.0)


def test_bollinger(spark):
    row = I.bollinger(series(spark, [10, 12, 14]), 3, 2.0).orderBy(F.desc("date")).first()
    sd = (8 / 3) ** 0.5
    assert row["bb_middle"] == 12.0 and row["bb_upper"] == pytest.approx(12 + 2 * sd)
    assert row["bb_lower"] == pytest.approx(12 - 2 * sd) and row["bb_width"] == pytest.approx(4 * sd)


def test_macd_against_a_plain_loop(spark):
    closes = [100 + i * 0.5 for i in range(30)]
    def ema(xs, n):
        out = [xs[0]]
        for x in xs[1:]:
            out.append(2 / (n + 1) * x + (1 - 2 / (n + 1)) * out[-1])
        return out
    line = [f - s for f, s in zip(ema(closes, 3), ema(closes, 6))]
    df = I.macd(series(spark, closes), 3, 6, 3)
    assert values(df, "macd_line") == pytest.approx(line) and values(df, "macd_signal") == pytest.approx(ema(line, 3))


def test_atr(spark):
    df = series(spark, [10, 11, 12], high=[11, 13, 12.5], low=[9, 10.5, 11])
    # true ranges from the second bar: 3.0 and 1.5, smoothed with 2/(2+1)
    assert values(I.atr(df, 2), "atr_2") == [None, 3.0, pytest.approx(1.5 * 2 / 3 + 3.0 / 3)]


def test_truncating_the_future_changes_nothing(spark):
    closes = [100 + ((i * 37) % 11) - 5 for i in range(40)]
    full, cut = series(spark, closes), series(spark, closes[:25])
    for make, name in ((lambda d: I.ema(d, 5), "ema_5"), (lambda d: I.rsi(d, 5), "rsi_5"),
                       (lambda d: I.sma(d, 5), "sma_5")):
        assert values(make(full), name)[:25] == pytest.approx(values(make(cut), name), nan_ok=True) or \
            values(make(full), name)[:25] == values(make(cut), name)


def test_hysteresis_enters_and_exits(spark):
    closes = [100, 100, 110, 121, 133, 120, 100, 85, 70, 60, 50]
    rows = I.hysteresis_signals(series(spark, closes), 2, 1, consecutive_bars=2).orderBy("date").collect()
    actions = [r["action"] for r in rows]
    assert actions.count("enter") == 1 and actions.count("exit") == 1 and actions.index("enter") < actions.index("exit")
    entered = rows[actions.index("enter")]
    assert entered["bars_above"] == 2 and entered["confidence"] == 1.0


def test_buy_and_hold_and_registry(spark):
    df = series(spark, [200, 210])
    rows = I.build_strategy("buy_and_hold")(df, capital=10_000.0).collect()
    assert len(rows) == 1 and rows[0]["target_weight"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        I.build_strategy("nothing")
    I.register_strategy("mine", lambda bars: bars.limit(0))
    assert I.build_strategy("mine")(df).count() == 0
    I.STRATEGIES.pop("mine")
