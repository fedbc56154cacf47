"""A streaming replay in order equals the batch operators."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators.trades import position_ledger
from tidemark.streaming.jobs import stream_hysteresis, stream_indicators, stream_positions

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"
FILLS = "order_id long, symbol string, side string, price double, quantity long, ts timestamp, commission double"


def bars(spark, n=90):
    rows = [(f"S{s}", i, 100 + 12 * math.sin(i / 7 + s) + s) for s in range(3) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, i int, close double")
    return df.select("symbol", F.timestamp_seconds(F.col("i") * 86400 + 1_600_000_000).alias("ts"),
                     F.col("close").alias("open"), (F.col("close") + 1).alias("high"),
                     (F.col("close") - 1.5).alias("low"), "close", F.lit(10).cast("long").alias("volume"), "i")


END = "END"


def closing(part):
    """A row of a time far ahead: the watermark passes all others."""
    row = part.limit(1).withColumns({"symbol": F.lit(END), "ts": F.lit("2100-01-01").cast("timestamp")})
    return row.select(part.columns)


def replay(spark, tmp_path, parts, schema, job):
    """Land the parts one file after another, and a last row behind them, run to the end, return the output."""
    src = str(tmp_path / "in")
    for part in [*parts, closing(parts[0])]:
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = job(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck) \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    assert spark.read.parquet(out).filter(F.col("symbol") == END).count() == 0
    return spark.read.parquet(out)


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and a == pytest.approx(b, abs=1e-8))


def test_indicators_replay(spark, tmp_path):
    data = bars(spark)
    parts = [data.filter(F.col("i").between(lo, lo + 44)).drop("i") for lo in (0, 45)]
    got = replay(spark, tmp_path, parts, BARS, lambda s: stream_indicators(s, 5, 5, 4, (5, 2.0), (3, 6, 3), 4))
    b = data.drop("i")
    batch = I.atr(I.macd(I.bollinger(I.rsi(I.ema(I.sma(b, 5, date="ts"), 5, date="ts"), 4, date="ts"), 5, date="ts"),
                         3, 6, 3, date="ts"), 4, date="ts")
    names = [c for c in got.columns if c not in ("symbol", "ts", "late_dropped")]
    want = {(r["symbol"], r["ts"]): r for r in batch.collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 270
    for r in rows:
        for n in names:
            assert close(r[n], want[(r["symbol"], r["ts"])][n]), (n, r)


def test_hysteresis_replay(spark, tmp_path):
    data = bars(spark)
    parts = [data.filter(F.col("i").between(lo, lo + 29)).drop("i") for lo in (0, 30, 60)]
    got = replay(spark, tmp_path, parts, BARS, lambda s: stream_hysteresis(s, lookback_days=10))
    want = {(r["symbol"], r["ts"]): r for r in I.hysteresis_signals(data.drop("i"), 10, date="ts").collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 240
    assert {"enter", "exit"} <= {r["action"] for r in rows}
    for r in rows:
        w = want[(r["symbol"], r["ts"])]
        assert (r["action"], r["bars_above"], r["bars_below"]) == (w["action"], w["bars_above"], w["bars_below"])
        assert close(r["ema"], w["ema"]) and close(r["confidence"], w["confidence"])


def fills(spark, n=120):
    rows = [(i, f"S{i % 3}", "Buy" if (i * 7) % 5 < 3 else "Sell", 100.0 + (i * 13) % 17, 1 + (i * 11) % 9, i, 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "order_id long, symbol string, side string, price double, quantity long, i int, commission double")
    return df.select("order_id", "symbol", "side", "price", "quantity", F.timestamp_seconds(F.col("i") * 60 + 1_600_000_000).alias("ts"), "commission")


def same_book(got, df):
    want = {r["order_id"]: r for r in position_ledger(df).collect()}
    assert sorted(r["order_id"] for r in got) == sorted(want)
    for r in got:
        for n in ("quantity", "avg_entry", "realized", "realized_total"):
            assert close(r[n], want[r["order_id"]][n]), (n, r, want[r["order_id"]])


def test_batches_out_of_order_within_the_delay_lose_nothing(spark, tmp_path):
    df = fills(spark)
    # The second file holds every fifth fill of the first file's hours, and its own come in reverse.
    parts = [df.filter("order_id % 5 <> 3"), df.filter("order_id % 5 = 3").orderBy(F.col("order_id").desc())]
    got = replay(spark, tmp_path, parts, FILLS, stream_positions).collect()
    same_book(got, df)
    assert max(r["late_dropped"] for r in got) == 0


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    df = fills(spark)
    # A delay of ten minutes: when the third file comes, the first one's fills are long gone.
    late = df.filter("order_id in (3, 6)")
    parts = [df.filter("order_id < 60 and order_id not in (3, 6)"), df.filter("order_id between 60 and 99"), late.unionByName(df.filter("order_id >= 100"))]
    got = replay(spark, tmp_path, parts, FILLS, lambda s: stream_positions(s, delay="10 minutes")).collect()
    same_book(got, df.filter("order_id not in (3, 6)"))
    counts = {s: max(r["late_dropped"] for r in got if r["symbol"] == s) for s in ("S0", "S1", "S2")}
    assert counts == {"S0": 2, "S1": 0, "S2": 0}


def test_bars_out_of_order_with_gaps(spark, tmp_path):
    data = bars(spark, 60).withColumn("close", F.when(F.col("i") % 13 == 4, F.lit(None)).when(F.col("i") % 17 == 9, F.lit(float("inf")))
                                      .when((F.col("i") == 0) & (F.col("symbol") == "S1"), F.lit(None)).otherwise(F.col("close")).cast("double"))
    data = data.withColumn("high", F.when(F.col("i") % 19 != 6, F.col("high")))
    parts = [data.filter("i % 4 <> 1").drop("i"), data.filter("i % 4 = 1").drop("i")]
    got = replay(spark, tmp_path, parts, BARS, lambda s: stream_indicators(s, 5, 5, 4, (5, 2.0), (3, 6, 3), 4, delay="100 days"))
    b = data.drop("i")
    batch = I.atr(I.macd(I.rsi(I.ema(b, 5, date="ts"), 4, date="ts"), 3, 6, 3, date="ts"), 4, date="ts")
    want = {(r["symbol"], r["ts"]): r for r in batch.collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 180
    for r in rows:
        for n in ("ema_5", "rsi_4", "macd_line", "macd_signal", "macd_histogram", "atr_4"):
            assert close(r[n], want[(r["symbol"], r["ts"])][n]), (n, r, want[(r["symbol"], r["ts"])])


def test_session_must_keep_state_in_rocksdb(spark):
    from tidemark.streaming.jobs import STATE_SETTING, needs_state_store

    kept = spark.conf.get(STATE_SETTING)
    spark.conf.unset(STATE_SETTING)
    try:
        if spark.conf.get(STATE_SETTING, "") != kept:
            with pytest.raises(ValueError):
                needs_state_store(spark)
    finally:
        spark.conf.set(STATE_SETTING, kept)


def test_fills_of_one_instant_all_count(spark, tmp_path):
    # Several fills share each minute, also across the two files; one row of the first file comes again.
    rows = [(i, "A", "Buy" if i % 4 else "Sell", 10.0 + i % 7, 1 + i % 3, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "order_id long, symbol string, side string, price double, quantity long, commission double")
    df = df.select("order_id", "symbol", "side", "price", "quantity", F.timestamp_seconds(F.floor(F.col("order_id") / 8) * 60 + 1_600_000_000).alias("ts"),
                   "commission")
    parts = [df.filter("order_id < 20"), df.filter("order_id >= 20").unionByName(df.filter("order_id = 19"))]
    got = sorted(replay(spark, tmp_path, parts, FILLS, stream_positions).collect(), key=lambda r: r["order_id"])
    want = {r["order_id"]: r for r in position_ledger(df).collect()}
    assert [r["order_id"] for r in got] == list(range(40)) and got[-1]["late_dropped"] == 1
    for r in got:
        for n in ("quantity", "avg_entry", "realized", "realized_total"):
            assert close(r[n], want[r["order_id"]][n]), (n, r)


def test_release_of_a_long_key_holds_packed_numbers():
    import random
    import tracemalloc
    from types import SimpleNamespace

    from tidemark.streaming.processors import PositionProcessor

    n, rng = 60_000, random.Random(5)
    places = rng.sample(range(n), n)
    waiting = [[]]

    def rows():  # as the state store hands them out: made when read
        for p in places:
            yield (1000 * (p // 3), p, None if p % 1000 == 0 else 1.0 + p % 7, float(p % 5 - 2))

    class Store:
        def __init__(self): self.value = None
        def exists(self): return self.value is not None
        def get(self): return self.value
        def update(self, value): self.value = value

    processor = PositionProcessor("symbol", "ts", "order_id")
    processor.state = Store()
    processor.handle = SimpleNamespace(registerTimer=lambda t: None, deleteTimer=lambda t: None)
    processor.waiting = SimpleNamespace(get=rows, put=lambda r: waiting.append(list(r)), appendList=lambda r: waiting[-1].extend(r), clear=lambda: None)
    tracemalloc.start()
    seen, after = 0, -1
    for frame in processor.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10_000), None):
        assert frame["order_id"].is_monotonic_increasing and frame["order_id"].iloc[0] == after + 1
        seen, after = seen + len(frame), int(frame["order_id"].iloc[-1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    late = waiting[-1]
    assert seen == 30_003 and len(late) == n - seen and all(r[0] > 10_000_000 for r in late)
    assert sum(r[2] is None for r in late) == 29
    assert (peak - 60 * n) < 12e6, peak
