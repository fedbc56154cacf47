"""Streaming runs over bars landed from the given tables.

A symbol has at most one weekly bar, so its rows in a replay are bounded by the
calendar whatever the size of the line items behind them.
"""

from pyspark.sql import functions as F

from catalog import base
from catalog.base import bars, fills, query, shared_folder
from catalog.indicators import ORDERED, ema_cte
from tidemark.streaming import jobs as J


def _replay(spark, parts, job, name):
    """Land the parts one after the other, each a run of the stream of its own, and return what was written.

    A row of a time far ahead comes last, so that the watermark passes all others; it is itself never answered.
    """
    spark.conf.set(J.STATE_SETTING, J.STATE_STORE)
    src, out, state = (shared_folder(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    end = parts[0].limit(1).withColumns({"symbol": F.lit("~"), "ts": F.lit("2200-01-01").cast("timestamp")}).select(parts[0].columns)
    for part in [*parts[:-1], parts[-1].unionByName(end)]:
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(part.schema).parquet(src)
        q = job(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append") \
            .trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def _shuffled(df, middle):
    """Two parts about a moment: some rows of the 60 days before it come late, some of the 60 days behind it early."""
    days = F.datediff("ts", F.lit(middle).cast("timestamp"))
    turn = F.pmod(F.xxhash64("symbol", "ts"), F.lit(3))
    second = F.when(days.between(-60, -1), turn == 0).when(days.between(0, 60), turn != 1).otherwise(days >= 0)
    return [df.filter(~second), df.filter(second)]


def _bars(spark, sf):
    return bars(spark, sf).withColumn("ts", F.col("date").cast("timestamp")).drop("date")


X1 = f"""with recursive {ORDERED}, {ema_cte('e', 'o', 'close', 10)}, {ema_cte('f', 'o', 'close', 12)},
    {ema_cte('s', 'o', 'close', 26)}, ln as (select symbol, pos, f.v-s.v x from f join s using (symbol, pos)), {ema_cte('g', 'ln', 'x', 9)},
    b as (select symbol, pos, case when count(*) over w=10 then avg(close) over w end m from o window w as (partition by symbol order by pos rows 9 preceding))
    select symbol, date::timestamp ts, m sma_10, e.v ema_10, x macd_line, g.v macd_signal from o join e using (symbol, pos)
    join ln using (symbol, pos) join g using (symbol, pos) join b using (symbol, pos)"""
X1_DIGITS = {"sma_10": 5, "ema_10": 5, "macd_line": 5, "macd_signal": 5}


@query("x1_stream_indicators", X1, ("bars",), X1_DIGITS)
def x1(spark, sf):
    out = _replay(spark, [_bars(spark, sf)], lambda s: J.stream_indicators(s, 10, 10), "indicators")
    return out.select("symbol", "ts", "sma_10", "ema_10", "macd_line", "macd_signal")


@query("x1_stream_indicators_shuffled", X1, ("bars",), X1_DIGITS)
def x1_shuffled(spark, sf):
    out = _replay(spark, _shuffled(_bars(spark, sf), "1995-06-01"), lambda s: J.stream_indicators(s, 10, 10, delay="180 days"), "indicators-shuffled")
    return out.select("symbol", "ts", "sma_10", "ema_10", "macd_line", "macd_signal")


X2 = """select symbol, date::timestamp ts, close/lag(close,12) over w-1 momentum from bars
    window w as (partition by symbol order by date) qualify momentum is not null"""


@query("x2_stream_hysteresis", X2, ("bars",), {"momentum": 6})
def x2(spark, sf):
    out = _replay(spark, [_bars(spark, sf)], lambda s: J.stream_hysteresis(s, lookback_days=12), "signals")
    return out.select("symbol", "ts", "momentum")


@query("x2_stream_hysteresis_shuffled", X2, ("bars",), {"momentum": 6})
def x2_shuffled(spark, sf):
    out = _replay(spark, _shuffled(_bars(spark, sf), "1995-06-01"), lambda s: J.stream_hysteresis(s, lookback_days=12, delay="180 days"), "signals-shuffled")
    return out.select("symbol", "ts", "momentum")


base.SQL_VIEWS.update({
    "hour_tape": """select symbol, date_trunc('hour', ts) ts, order_id, price, case when side='Buy' then quantity else -quantity end::double signed,
       row_number() over (partition by symbol order by date_trunc('hour', ts), order_id) rn from fills""",
    "stream_book": """select symbol, rn, ts, order_id, price, signed, 0.0::double qb, 0.0::double ab, signed qa, price aa from hour_tape where rn=1
       union all select t.symbol, t.rn, t.ts, t.order_id, t.price, t.signed, b.qa, b.aa, b.qa+t.signed,
       case when b.qa+t.signed=0 then 0 when b.qa=0 then t.price when sign(b.qa)=sign(t.signed)
         then (b.aa*abs(b.qa)+t.price*abs(t.signed))/abs(b.qa+t.signed)
         when sign(b.qa+t.signed)<>sign(b.qa) then t.price else b.aa end
       from stream_book b join hour_tape t on t.symbol=b.symbol and t.rn=b.rn+1""",
})
base.DEPENDS.update({"hour_tape": ("fills",), "stream_book": ("hour_tape",)})


X3 = """select symbol, ts, order_id, qa quantity, case when qa<>0 then aa end avg_entry,
    case when qb=0 or sign(qb)=sign(signed) then 0 else (price-ab)*least(abs(signed),abs(qb))*sign(qb) end realized, 0::bigint late_dropped from stream_book"""
X3_DIGITS = {"avg_entry": 4, "realized": 4}


@query("x3_stream_positions", X3, ("stream_book",), X3_DIGITS)
def x3(spark, sf):
    # Hours instead of instants: many fills of a symbol share a time.
    hourly = fills(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    out = _replay(spark, [hourly], J.stream_positions, "positions")
    return out.select("symbol", "ts", "order_id", "quantity", "avg_entry", "realized", "late_dropped")


@query("x3_stream_positions_shuffled", X3, ("stream_book",), X3_DIGITS)
def x3_shuffled(spark, sf):
    hourly = fills(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    # Every third fill comes in a second run; none is behind a watermark of five years.
    late = F.pmod(F.xxhash64("order_id"), F.lit(3)) == 0
    out = _replay(spark, [hourly.filter(~late), hourly.filter(late)], lambda s: J.stream_positions(s, delay="1826 days"), "positions-shuffled")
    return out.select("symbol", "ts", "order_id", "quantity", "avg_entry", "realized", "late_dropped")
