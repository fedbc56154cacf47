"""Labels, rolling windows, sampling, buckets."""

from pyspark.sql import functions as F

from catalog.base import bars, macro, otc, query, transactions
from tidemark.operators import aggregates as A, windows as W
from tidemark.plans.study import study_rows

MOM = "price_momentum_12d"

# Panel used by the cross-sectional checks: momentum over 12 bars, return over 4.
PANEL_SQL = """select *, (close/nullif(lag(close,12) over w,0)-1)*100 as price_momentum_12d,
    (lead(close,4) over w - close)/nullif(close,0)*100 as forward_4d_return,
    (lead(close,12) over w - close)/nullif(close,0)*100 as forward_12d_return
    from bars window w as (partition by symbol order by date)"""
STUDY_SQL = """select symbol, date, price_momentum_12d, forward_4d_return,
    least(greatest((rk-1)*5//n+1,1),5)::int as quantile from (
      select *, row_number() over (partition by date order by price_momentum_12d, symbol) rk, count(*) over (partition by date) n
      from (select * from (%s) p where price_momentum_12d is not null and forward_4d_return is not null) s
      join (select date, row_number() over (order by date)-1 i from (
        select distinct date from (%s) p2 where price_momentum_12d is not null and forward_4d_return is not null)) d using (date)
      where i %% 4 = 0) where n >= 5""" % (PANEL_SQL, PANEL_SQL)


def panel(spark, sf):
    return W.momentum(W.forward_returns(bars(spark, sf), [4, 12]), 12)


def buckets(spark, sf):
    return study_rows(panel(spark, sf), MOM, "forward_4d_return")


@query("flagship_momentum_quintiles", f"""
    select quantile, avg(forward_4d_return) avg_return, stddev_samp(forward_4d_return) std_return,
      count(*) filter (forward_4d_return>0) win_count, count(forward_4d_return) total_count,
      count(*) filter (forward_4d_return>0)/count(forward_4d_return)*100 hit_rate_pct from ({STUDY_SQL}) group by 1""",
       ("bars",), {"avg_return": 6, "std_return": 6, "hit_rate_pct": 6})
def flagship(spark, sf):
    return A.quantile_summary(buckets(spark, sf), "forward_4d_return")


@query("w1_forward_returns", """select symbol, date, close,
    (lead(close,4) over w - close)/close*100 forward_4d_return, (lead(close,12) over w - close)/close*100 forward_12d_return,
    lead(date,4) over w forward_4d_available, lead(date,12) over w forward_12d_available
    from bars window w as (partition by symbol order by date)""", ("bars",),
       {"forward_4d_return": 6, "forward_12d_return": 6})
def w1(spark, sf):
    return W.forward_returns(bars(spark, sf).select("symbol", "date", "close"), [4, 12], available=True)


@query("w1_forward_returns_timestamps", """select symbol, ts, price,
    (lead(price,5) over w - price)/nullif(price,0)*100 forward_5d_return from fills window w as (partition by symbol order by ts)""",
       ("fills",), {"forward_5d_return": 6})
def w1_ts(spark, sf):
    from catalog.base import fills
    return W.forward_returns(fills(spark, sf).select("symbol", "ts", "price"), [5], date="ts", close="price")


@query("w2_excess_forward_returns", """select b.symbol, b.date, (lead(close,4) over w - close)/close*100 forward_4d_return,
    (lead(close,4) over w - close)/close*100 - (lead(bc,4) over w - bc)/bc*100 forward_4d_excess
    from (select bars.*, m.close bc from bars left join bars m on m.symbol='S00' and m.date=bars.date) b
    window w as (partition by symbol order by date)""", ("bars",), {"forward_4d_return": 6, "forward_4d_excess": 6})
def w2(spark, sf):
    from tidemark.operators.joins import with_benchmark
    out = W.forward_returns(with_benchmark(bars(spark, sf), "S00"), [4])
    return out.select("symbol", "date", "forward_4d_return", "forward_4d_excess")


@query("w3_momentum", """select symbol, date, close, (close/lag(close,12) over w-1)*100 price_momentum_12d
    from bars window w as (partition by symbol order by date)""", ("bars",), {MOM: 6})
def w3(spark, sf):
    return W.momentum(bars(spark, sf).select("symbol", "date", "close"), 12)


Z_SQL = """select {k}, case when count(*) over w >= {m} and stddev_samp({v}) over w > 1e-12*abs(avg({v}) over w)
    then ({v} - avg({v}) over w)/stddev_samp({v}) over w end z from {t}
    window w as (partition by symbol order by {o} rows unbounded preceding)"""


@query("w4_trailing_zscore", Z_SQL.format(k="symbol, date", m=8, v="close", t="bars", o="date"), ("bars",), {"z": 5})
def w4(spark, sf):
    return W.trailing_zscore(bars(spark, sf), "close", time_col="date", out_col="z").select("symbol", "date", "z")


@query("w4_trailing_zscore_timestamps", Z_SQL.format(k="symbol, ts", m=8, v="price", t="fills", o="ts"), ("fills",),
       {"z": 5})
def w4_ts(spark, sf):
    from catalog.base import fills
    return W.trailing_zscore(fills(spark, sf), "price", time_col="ts", out_col="z").select("symbol", "ts", "z")


@query("w5_rolling_calendar_sum", """select distinct symbol, action_date, sum(amount) over (partition by symbol
    order by action_date range between interval 89 days preceding and current row) amount_90d from transactions""",
       ("transactions",), {"amount_90d": 2})
def w5(spark, sf):
    daily = A.daily_totals(transactions(spark, sf))
    return W.rolling_days(daily, "daily_amount", 90, date="action_date", out="amount_90d") \
        .select("symbol", "action_date", "amount_90d")


@query("w5_rolling_calendar_sum_raw_rows", """select symbol, action_date, amount, sum(amount) over (partition by symbol
    order by action_date range between interval 89 days preceding and current row) amount_90d from transactions""",
       ("transactions",), {"amount_90d": 2})
def w5_raw(spark, sf):
    return W.rolling_days(transactions(spark, sf), "amount", 90, date="action_date", out="amount_90d") \
        .select("symbol", "action_date", "amount", "amount_90d")


@query("w6_rolling_mean_dollar_volume", """select symbol, date, avg(close*volume) over (partition by symbol order by date
    range between interval 62 days preceding and current row) dollar_vol from bars""", ("bars",), {"dollar_vol": 5})
def w6(spark, sf):
    from tidemark.plans.events import dollar_volume
    return dollar_volume(bars(spark, sf)).select("symbol", "date", "dollar_vol")


@query("w6_rolling_mean_timestamps", """select symbol, ts, avg(price) over (partition by symbol order by ts
    range between interval '43199999999 microseconds' preceding and current row) price_mean from fills""",
       ("fills",), {"price_mean": 5})
def w6_ts(spark, sf):
    from catalog.base import fills
    halves = W._rolling_span(fills(spark, sf).select("symbol", "ts", "price"), "price", 43_200_000_000, "mean",
                             "symbol", "ts", "price_mean")
    return halves.select("symbol", "ts", "price_mean")


@query("w7_rolling_rows", """select symbol, date, avg(close) over w close_mean_3, sum(volume) over w volume_sum_3 from bars
    window w as (partition by symbol order by date rows 2 preceding)""", ("bars",),
       {"close_mean_3": 6, "volume_sum_3": 0})
def w7(spark, sf):
    out = W.rolling_rows(W.rolling_rows(bars(spark, sf), "close", 3), "volume", 3, "sum")
    return out.select("symbol", "date", "close_mean_3", "volume_sum_3")


@query("w8_pct_change_and_diff", """select series_id, date, value/lag(value,4) over w-1 yoy, value/lag(value) over w-1 mom,
    value-lag(value) over w diff from macro window w as (partition by series_id order by date)""", ("macro",),
       {"yoy": 6, "mom": 6, "diff": 4})
def w8(spark, sf):
    out = W.pct_change(macro(spark, sf), "value", 4, "series_id", "date", "yoy")
    out = W.pct_change(out, "value", 1, "series_id", "date", "mom")
    return W.difference(out, "value", 1, "series_id", "date", "diff").select("series_id", "date", "yoy", "mom", "diff")


@query("w9_quantile_bucket", """select symbol, date, least(greatest((rk-1)*5//n+1,1),5)::int as quantile from (
    select symbol, date, row_number() over (partition by date order by price_momentum_12d, symbol) rk,
    count(*) over (partition by date) n from (%s) p where price_momentum_12d is not null)""" % PANEL_SQL, ("bars",))
def w9(spark, sf):
    rows = panel(spark, sf).filter(F.col(MOM).isNotNull())
    return W.quantile_bucket(rows, MOM).select("symbol", "date", "quantile")


@query("w9_quantile_bucket_lopsided_group", """select event_id, least(greatest((rk-1)*10//n+1,1),10)::int as quantile from (
    select event_id, row_number() over (partition by user_id % 3 = 0 order by value, event_id) rk,
    count(*) over (partition by user_id % 3 = 0) n from events)""")
def w9_hot(spark, sf):
    from catalog.base import table
    rows = table(spark, sf, "events").withColumn("grp", F.col("user_id") % 3 == 0)
    return W.quantile_bucket(rows, "value", 10, "grp", "event_id").select("event_id", "quantile")


@query("w10_sample_periods", """select symbol, date, close from bars join (select date, row_number() over (order by date)-1 i
    from (select distinct date from bars)) using (date) where i % 4 = 0""", ("bars",))
def w10(spark, sf):
    return W.sample_periods(bars(spark, sf).select("symbol", "date", "close"), 4)


@query("w11_cumulative_drawdown", """select symbol, date, ret, cumulative, cumulative - max(cumulative) over (partition by symbol
    order by date rows unbounded preceding) drawdown from (select *, sum(ret) over (partition by symbol order by date
    rows unbounded preceding) cumulative from (select symbol, date, (close-open)/open*100 ret from bars))""", ("bars",),
       {"ret": 6, "cumulative": 5, "drawdown": 5})
def w11(spark, sf):
    rows = bars(spark, sf).select("symbol", "date", ((F.col("close") - F.col("open")) / F.col("open") * 100).alias("ret"))
    return W.cumulative_drawdown(rows, "ret", by=["symbol"])


@query("w12_xs_standardise", """select symbol, date, case when stddev_pop(close) over w > 0 then
    (close-avg(close) over w)/stddev_pop(close) over w end close_z, case when stddev_pop(volume) over w > 0 then
    (volume-avg(volume) over w)/stddev_pop(volume) over w end volume_z from bars window w as (partition by date)""",
       ("bars",), {"close_z": 6, "volume_z": 6})
def w12(spark, sf):
    return W.xs_standardise(bars(spark, sf), ["close", "volume"]).select("symbol", "date", "close_z", "volume_z")


@query("w13_first_filing", """select symbol, "end", val, filed from (select *, row_number() over (partition by symbol, "end"
    order by filed, val) rn from (select symbol, "end", val, filed from revenue union all
    select symbol, "end", val*1.5, filed + 200 from revenue)) where rn = 1""", ("revenue",), {"val": 2})
def w13(spark, sf):
    from catalog.base import revenue
    from tidemark.operators.sets import first_by
    first = revenue(spark, sf).select("symbol", "end", "val", "filed")
    again = first.select("symbol", "end", (F.col("val") * 1.5).alias("val"), F.date_add("filed", 200).alias("filed"))
    return first_by(first.unionByName(again), ["symbol", "end"], ["filed", "val"])


@query("w14_market_maker_activity", """select ticker, trade_date, market_makers, mm_change, prev_mm,
    (market_makers-prev_mm)/prev_mm mm_change_pct from (select *, market_makers-lag(market_makers) over w mm_change,
    lag(market_makers) over w prev_mm from otc window w as (partition by ticker order by trade_date))
    where mm_change < -1 and prev_mm > 2""", ("otc",), {"mm_change_pct": 6})
def w14(spark, sf):
    out = W.market_maker_activity(otc(spark, sf))
    return out.select("ticker", "trade_date", "market_makers", "mm_change", "prev_mm", "mm_change_pct")
