"""Technical indicators and strategies."""

from pyspark.sql import functions as F

from catalog.base import bars, fills, query
from tidemark.operators import indicators as I

ORDERED = "o as (select symbol, date, high, low, close, row_number() over (partition by symbol order by date)-1 pos from bars)"


def ema_cte(name, source, x, n, start=0):
    """An EMA over ``source(symbol, pos, x)`` as a recursive CTE."""
    a = f"(2.0::double/{n + 1})"
    return (f"{name} as (select symbol, pos, ({x})::double v from {source} where pos={start} union all "
            f"select s.symbol, s.pos, {a}*s.{x}+(1-{a})*e.v from {name} e join {source} s on s.symbol=e.symbol and s.pos=e.pos+1)")


@query("i1_sma", """select symbol, date, case when count(*) over w=10 then avg(close) over w end sma_10 from bars
    window w as (partition by symbol order by date rows 9 preceding)""", ("bars",), {"sma_10": 6})
def i1(spark, sf):
    return I.sma(bars(spark, sf), 10).select("symbol", "date", "sma_10")


@query("i1_sma_zero_warmup", """select symbol, date, case when count(*) over w=20 then avg(close) over w else 0 end sma_20 from bars
    window w as (partition by symbol order by date rows 19 preceding)""", ("bars",), {"sma_20": 6})
def i1_zero(spark, sf):
    return I.sma(bars(spark, sf), 20, "zero").select("symbol", "date", "sma_20")


@query("i2_ema", f"""with recursive {ORDERED}, {ema_cte('e', 'o', 'close', 10)}
    select symbol, date, v ema_10 from o join e using (symbol, pos)""", ("bars",), {"ema_10": 6})
def i2(spark, sf):
    return I.ema(bars(spark, sf), 10).select("symbol", "date", "ema_10")


@query("i2_ema_timestamps", f"""with recursive o as (select symbol, ts, price, row_number() over (partition by symbol order by ts)-1 pos
    from fills), {ema_cte('e', 'o', 'price', 10)} select symbol, ts, v ema_10 from o join e using (symbol, pos)""",
       ("fills",), {"ema_10": 6})
def i2_ts(spark, sf):
    return I.ema(fills(spark, sf), 10, "price", date="ts").select("symbol", "ts", "ema_10")


@query("i3_rsi", f"""with recursive {ORDERED}, c as (select *, greatest(close-lag(close) over w,0) g, greatest(lag(close) over w-close,0) l
    from o window w as (partition by symbol order by pos)),
    r as (select symbol, 14::bigint pos, avg(g) ag, avg(l) al from c where pos between 1 and 14 group by 1 having count(*)=14
    union all select c.symbol, c.pos, (r.ag*13+c.g)/14, (r.al*13+c.l)/14 from r join c on c.symbol=r.symbol and c.pos=r.pos+1)
    select symbol, date, case when pos=0 then 0 when ag is null or (ag=0 and al=0) then 50 when al=0 then 100
    else 100-100/(1+ag/al) end rsi_14 from c left join r using (symbol, pos)""", ("bars",), {"rsi_14": 6})
def i3(spark, sf):
    return I.rsi(bars(spark, sf)).select("symbol", "date", "rsi_14")


@query("i4_bollinger", """select symbol, date, m bb_middle, m+2*d bb_upper, m-2*d bb_lower, 4*d bb_width from (select symbol, date,
    case when count(*) over w=20 then avg(close) over w end m, case when count(*) over w=20 then stddev_pop(close) over w end d
    from bars window w as (partition by symbol order by date rows 19 preceding))""", ("bars",),
       {"bb_middle": 5, "bb_upper": 5, "bb_lower": 5, "bb_width": 5})
def i4(spark, sf):
    return I.bollinger(bars(spark, sf)).select("symbol", "date", "bb_middle", "bb_upper", "bb_lower", "bb_width")


@query("i5_macd", f"""with recursive {ORDERED}, {ema_cte('f', 'o', 'close', 12)}, {ema_cte('s', 'o', 'close', 26)},
    ln as (select symbol, pos, f.v-s.v x from f join s using (symbol, pos)), {ema_cte('g', 'ln', 'x', 9)}
    select symbol, date, x macd_line, g.v macd_signal, x-g.v macd_histogram from o join ln using (symbol, pos)
    join g using (symbol, pos)""", ("bars",), {"macd_line": 5, "macd_signal": 5, "macd_histogram": 5})
def i5(spark, sf):
    return I.macd(bars(spark, sf)).select("symbol", "date", "macd_line", "macd_signal", "macd_histogram")


@query("i6_atr", f"""with recursive {ORDERED}, t as (select symbol, date, pos, greatest(high-low, abs(high-lag(close) over w),
    abs(low-lag(close) over w)) x from o window w as (partition by symbol order by pos)), {ema_cte('e', 't', 'x', 14, 1)}
    select symbol, date, v atr_14 from t left join e using (symbol, pos)""", ("bars",), {"atr_14": 5})
def i6(spark, sf):
    return I.atr(bars(spark, sf)).select("symbol", "date", "atr_14")


@query("i7_hysteresis_signals", f"""with recursive m as (select symbol, date, close/lag(close,12) over w-1 x,
    row_number() over w pos0 from bars window w as (partition by symbol order by date)),
    v as (select symbol, date, x, row_number() over (partition by symbol order by date)-1 pos from m where x is not null),
    {ema_cte('e', 'v', 'x', 5)},
    st as (select symbol, pos, v ema, case when v>0.02 then 1 else 0 end up, case when v<-0.02 then 1 else 0 end dn,
      0 held, 0 was from e where pos=0 union all
      select e.symbol, e.pos, e.v, case when e.v>0.02 then s.up+1 else 0 end, case when e.v<-0.02 then s.dn+1 else 0 end,
      case when e.v>0.02 and s.up+1>=2 then 1 when e.v<-0.02 and s.dn+1>=2 then 0 else s.held end, s.held
      from st s join e on e.symbol=s.symbol and e.pos=s.pos+1)
    select symbol, date, x momentum, ema, up::bigint bars_above, dn::bigint bars_below,
    case when up>=2 and was=0 then 'enter' when dn>=2 and was=1 then 'exit' end "action",
    case when up>=2 and was=0 then least(1, ema/0.04) when dn>=2 and was=1 then least(1, abs(ema)/0.04) end confidence
    from st join v using (symbol, pos)""", ("bars",), {"momentum": 6, "ema": 6, "confidence": 6})
def i7(spark, sf):
    return I.build_strategy("momentum_ema_hysteresis")(bars(spark, sf), lookback_days=12)


@query("i8_buy_and_hold", """select symbol, min(date) date, least(1, 100000.0::double/(select count(distinct symbol) from bars)/
    (arg_min(close, date)*100)) target_weight, 1.0::double confidence from bars group by 1""", ("bars",), {"target_weight": 9})
def i8(spark, sf):
    return I.build_strategy("buy_and_hold")(bars(spark, sf))


@query("f1_strategy_signals_per_symbol", """select symbol, count(*) n_signals from (select symbol, date, row_number() over
    (partition by symbol order by date) rn from bars) where rn <= 1 group by 1""", ("bars",))
def f1(spark, sf):
    signals = I.build_strategy("buy_and_hold")(bars(spark, sf))
    return signals.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_signals"))
