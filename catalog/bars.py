"""Bar quality, cleaning, joins and set operations."""

from pyspark.sql import functions as F

from catalog.base import bars, jobs, otc, query, table, transactions
from tidemark.operators import aggregates as A, cleaning as C, joins as J, sets as U
from tidemark.sources import bars as S

# Bars with faults put in, so that every rule has something to find.
FAULTY_SQL = """select symbol, date, case when volume%13=0 then -open else open end open,
    case when volume%7=0 then low*0.9 else high end high, case when volume%11=0 then high*1.1 else low end low,
    close, case when volume%17=0 then -volume else volume end volume from bars
    union all select symbol, date, open, high, low, close, volume from bars where volume%19=0"""


def faulty(spark, sf):
    b = bars(spark, sf)
    v = F.col("volume")
    bent = b.select(
        "symbol", "date", F.when(v % 13 == 0, -F.col("open")).otherwise(F.col("open")).alias("open"),
        F.when(v % 7 == 0, F.col("low") * 0.9).otherwise(F.col("high")).alias("high"),
        F.when(v % 11 == 0, F.col("high") * 1.1).otherwise(F.col("low")).alias("low"), "close",
        F.when(v % 17 == 0, -v).otherwise(v).alias("volume"))
    return bent.unionByName(b.filter(v % 19 == 0))


VIOLATIONS_SQL = f"""select *, concat_ws(',', case when least(open,high,low,close)<0 then 'negative_ohlc' end,
    case when high<low then 'high_below_low' end, case when high<open then 'high_below_open' end,
    case when high<close then 'high_below_close' end, case when low>open then 'low_above_open' end,
    case when low>close then 'low_above_close' end, case when volume<0 then 'negative_volume' end,
    case when count(*) over (partition by symbol, date)>1 then 'duplicate_timestamp' end) violations from ({FAULTY_SQL})"""


@query("s2_validate_report", f"select * from ({VIOLATIONS_SQL}) where violations <> ''", ("bars",),
       {"high": 4, "low": 4})
def s2(spark, sf):
    return C.validate_bars(faulty(spark, sf), "report").withColumn("violations", F.array_join("violations", ","))


@query("s2_validate_drop", f"select * exclude (violations) from ({VIOLATIONS_SQL}) where violations = ''", ("bars",),
       {"high": 4, "low": 4})
def s2_drop(spark, sf):
    return C.validate_bars(faulty(spark, sf), "drop")


@query("s4_with_benchmark", """select b.*, m.close benchmark_close from bars b left join bars m on m.symbol='S00' and m.date=b.date
    where b.symbol <> 'S00'""", ("bars",))
def s4(spark, sf):
    return J.with_benchmark(bars(spark, sf), "S00", drop=True)


@query("s5_simulation_format", "select cast(date as varchar) ts, open, high, low, close, volume, symbol from bars", ("bars",))
def s5(spark, sf):
    return S.to_simulation_format(bars(spark, sf))


@query("s11_bars_in_range", "select * from bars where date between date '1994-01-01' and date '1996-06-30'", ("bars",))
def s11(spark, sf):
    return S.bars_in_range(bars(spark, sf), "1994-01-01", "1996-06-30")


@query("s11_time_bounds", """select epoch_us(min(date)::timestamp)*1000 earliest, epoch_us(max(date)::timestamp)*1000 latest
    from bars""", ("bars",))
def s11_bounds(spark, sf):
    return S.time_bounds(bars(spark, sf))


HOLES_SQL = """select symbol, date, case when volume%5=0 then null else open end open, high, low,
    case when volume%3=0 then null else close end close, case when volume%4=0 then null else volume end volume from bars"""


def holes(spark, sf):
    v = F.col("volume")
    return bars(spark, sf).select(
        "symbol", "date", F.when(v % 5 != 0, F.col("open")).alias("open"), "high", "low",
        F.when(v % 3 != 0, F.col("close")).alias("close"), F.when(v % 4 != 0, v).alias("volume"))


@query("c1_clean_ohlcv", f"""select symbol, date ts, coalesce(open, lag(open,1) over w, lag(open,2) over w, lag(open,3) over w) open,
    high, low, c as close, coalesce(volume,0) volume, isodow(date)::int day_of_week from (
    select *, coalesce(close, lag(close,1) over w, lag(close,2) over w, lag(close,3) over w) c from ({HOLES_SQL})
    window w as (partition by symbol order by date)) window w as (partition by symbol order by date)
    qualify c is not null""", ("bars",))
def c1(spark, sf):
    return C.clean_ohlcv(holes(spark, sf))


@query("c2_return_outliers", """select symbol, date, close, ret, mean_ret, sd_ret from (select *, avg(ret) over (partition by symbol) mean_ret,
    stddev_samp(ret) over (partition by symbol) sd_ret from (select symbol, date, close, close/lag(close) over
    (partition by symbol order by date)-1 ret from bars)) where sd_ret>0 and abs(ret-mean_ret)>2.5*sd_ret""", ("bars",),
       {"ret": 6, "mean_ret": 6, "sd_ret": 6})
def c2(spark, sf):
    return C.return_outliers(bars(spark, sf), 2.5)


@query("c3_align_to_calendar", """with span as (select symbol, min(date) lo, max(date) hi, count(*) k from bars group by 1),
    spine as (select symbol, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) date from span where k>1),
    j as (select s.symbol, s.date, open, high, low, close, volume from spine s left join bars b using (symbol, date) where isodow(s.date)<=5)
    select symbol, date ts, last_value(open ignore nulls) over w open, last_value(high ignore nulls) over w high,
    last_value(low ignore nulls) over w low, last_value(close ignore nulls) over w as close, coalesce(volume,0) volume from j
    window w as (partition by symbol order by date rows unbounded preceding)
    union all select symbol, date, open, high, low, close, volume from bars where symbol in (select symbol from span where k=1)""",
       ("bars",))
def c3(spark, sf):
    return C.align_to_calendar(bars(spark, sf).withColumnRenamed("date", "ts"))


@query("c4_detect_splits", """select symbol, date, '1:'||cast(round_even(1/r,0) as bigint) ratio_suspected, (1-r)*100 price_drop_pct from (
    select symbol, date, case when lag(close) over w>0 then close/lag(close) over w when lag(close) over w is not null then 1 end r
    from bars window w as (partition by symbol order by date)) where r < 0.4""", ("bars",), {"price_drop_pct": 6})
def c4(spark, sf):
    return C.detect_splits(bars(spark, sf))


@query("c5_normalize_volume", """select symbol, date, case when stddev_samp(volume) over w>0 then (volume-avg(volume) over w)/
    stddev_samp(volume) over w else volume-avg(volume) over w end volume_z from bars window w as (partition by symbol)""",
       ("bars",), {"volume_z": 6})
def c5(spark, sf):
    return C.normalize_volume(bars(spark, sf)).select("symbol", "date", "volume_z")


@query("c6_dated_rows", """select symbol, action_date, amount from transactions where action_date <= date '1996-12-31'
    and amount>0 and day(action_date) <> 13""", ("transactions",))
def c6(spark, sf):
    day = F.col("action_date")
    raw = transactions(spark, sf).select(
        "symbol", F.when(F.dayofmonth(day) == 13, F.lit("not a date"))
        .otherwise(F.concat(day.cast("string"), F.lit("T00:00:00"))).alias("action_date"), "amount")
    return C.dated_rows(raw, "1996-12-31", positive_only=True)


@query("c7_map_vendor", """select n_name symbol, count(*) n, sum(o_totalprice) total from orders join customer on c_custkey=o_custkey
    join nation on n_nationkey=c_nationkey where n_regionkey <> 2 group by 1""", (), {"total": 2})
def c7(spark, sf):
    mapping = table(spark, sf, "customer").join(
        table(spark, sf, "nation").filter("n_regionkey <> 2"), F.col("n_nationkey") == F.col("c_nationkey")
    ).select(F.col("c_custkey").alias("vendor"), F.col("n_name").alias("symbol"))
    rows = C.map_vendor(table(spark, sf, "orders").withColumnRenamed("o_custkey", "vendor"), mapping)
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("c8_contract_intensity", """select symbol, date, close*volume market_cap, case when close*volume>0 then open/(close*volume) end
    contract_intensity from bars""", ("bars",), {"market_cap": 2, "contract_intensity": 9})
def c8(spark, sf):
    out = C.contract_intensity(bars(spark, sf), shares="volume", obligations="open")
    return out.select("symbol", "date", "market_cap", "contract_intensity")


@query("c9_search_awards", """select agency, post_date, keyword, length(description) n from jobs,
    (select unnest(['the','zqx','data']) keyword) where contains(lower(description), keyword)
    and post_date between date '2020-02-01' and date '2021-06-30'""", ("jobs",))
def c9(spark, sf):
    rows = jobs(spark, sf).withColumn("n", F.length("description"))
    out = C.search_awards(rows, ["the", "zqx", "data"], "2020-02-01", "2021-06-30", date="post_date", amount="n")
    return out.select("agency", "post_date", "keyword", "n")


@query("j3_asof_rolling_metric", """select a.symbol, event_date, amount, dollar_vol from awards a asof left join (
    select symbol, date, avg(close*volume) over (partition by symbol order by date range between interval 62 days preceding
    and current row) dollar_vol from bars) d on a.symbol=d.symbol and a.event_date>=d.date""", ("awards", "bars"),
       {"dollar_vol": 5})
def j3(spark, sf):
    from catalog.base import awards
    from tidemark.plans.events import dollar_volume
    volume = dollar_volume(bars(spark, sf)).select("symbol", "date", "dollar_vol")
    return J.asof_values(awards(spark, sf), volume, ["dollar_vol"], "symbol", "event_date", "date") \
        .select("symbol", "event_date", "amount", "dollar_vol")


@query("j3_asof_timestamps", """select a.symbol, a.ts, a.price, b.prior from (select symbol, ts, price from fills where order_id%3=0) a
    asof left join (select symbol, ts, price prior from fills where order_id%3=1) b on a.symbol=b.symbol and a.ts>=b.ts""",
       ("fills",))
def j3_ts(spark, sf):
    from catalog.base import fills
    f = fills(spark, sf)
    right = f.filter("order_id % 3 = 1").select("symbol", F.col("ts").alias("t"), F.col("price").alias("prior"))
    left = f.filter("order_id % 3 = 0").select("symbol", "ts", "price")
    return J.asof_values(left, right, ["prior"], "symbol", "ts", "t")


@query("j4_semi_join_dates", "select symbol, date, close from bars where date in (select date from bars where symbol='S01')",
       ("bars",))
def j4(spark, sf):
    b = bars(spark, sf)
    return J.semi_join_dates(b.select("symbol", "date", "close"), b.filter("symbol = 'S01'"))


@query("j5_min_names_filter", """select symbol, date from (select symbol, date, count(*) over (partition by date) n from bars)
    where n >= 25""", ("bars",))
def j5(spark, sf):
    from tidemark.operators.windows import min_names_filter
    return min_names_filter(bars(spark, sf), 25).select("symbol", "date")


@query("j6_group_zscore", """select ticker, trade_date, coalesce((share_volume-avg(share_volume) over w)/
    nullif(stddev_samp(share_volume) over w,0),0) z from otc window w as (partition by ticker)""", ("otc",), {"z": 6})
def j6(spark, sf):
    return A.group_zscore(otc(spark, sf), "share_volume", ["ticker"]).select("ticker", "trade_date", "z")


IDX_SQL = "select symbol, date, row_number() over (partition by symbol order by date)-1 bar_idx from bars"


@query("j7_align_events", f"""select e.symbol, e.event_date, e.award_id, r rel_day, t0, t0+r bar_idx from (
    select a.*, (select min(bar_idx) from ({IDX_SQL}) i where i.symbol=a.symbol and i.date>=a.event_date) t0,
    (select min(date) from bars b where b.symbol=a.symbol) first_date,
    (select count(*) from bars b where b.symbol=a.symbol) n from awards a) e, (select unnest(range(-2,5)) r)
    where t0 is not null and event_date>=first_date and t0+r between 0 and n-1""", ("awards", "bars"))
def j7(spark, sf):
    from catalog.base import awards
    out = J.align_events(bars(spark, sf), awards(spark, sf), 2, 4)
    return out.select("symbol", "event_date", "award_id", "rel_day", "t0", "bar_idx")


@query("j7_event_outcomes", """select outcome, count(*) n_events from (select case when f is null then 'no_bars' when event_date<f then 'before_first_bar'
    when event_date>l then 'after_last_bar' when nxt-event_date>3 then 'gap' else 'aligned' end outcome from (select a.symbol, a.event_date, b.f, b.l,
    (select min(date) from bars i where i.symbol=a.symbol and i.date>=a.event_date) nxt
    from (select case when award_id::bigint%7=0 then 'none' else symbol end symbol, case when award_id::bigint%11=0 then event_date+3000 when award_id::bigint%13=0 then event_date-3000
    else event_date end event_date from awards) a left join (select symbol, min(date) f, max(date) l from bars group by 1) b on a.symbol=b.symbol)) group by 1""", ("awards", "bars"))
def j7_outcomes(spark, sf):
    from catalog.base import awards
    number = F.col("award_id").cast("long")
    moved = F.when(number % 11 == 0, F.date_add("event_date", 3000)).when(number % 13 == 0, F.date_add("event_date", -3000)).otherwise(F.col("event_date"))
    events = awards(spark, sf).select(F.when(number % 7 == 0, "none").otherwise(F.col("symbol")).alias("symbol"), moved.alias("event_date"))
    return J.event_outcomes(bars(spark, sf), events, max_gap_days=3).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_events"))


@query("k1_sorted_bars", "select symbol, date, close from bars order by symbol, date", ("bars",))
def k1(spark, sf):
    return bars(spark, sf).select("symbol", "date", "close").orderBy("symbol", "date")


@query("k2_top_awards_per_vendor", """select symbol, award_id, amount from (select *, row_number() over (partition by symbol
    order by amount desc, award_id, event_date) rn from awards) where rn<=20""", ("awards",))
def k2(spark, sf):
    from catalog.base import awards
    from tidemark.sources.landed import top_awards
    rows = awards(spark, sf).withColumnRenamed("event_date", "action_date")
    return top_awards(rows, 20, "symbol").select("symbol", "award_id", "amount")


@query("k3_last_rows", """select symbol, date, close from (select *, row_number() over (partition by symbol order by date desc) rn
    from bars) where rn<=6""", ("bars",))
def k3(spark, sf):
    return U.last_n(bars(spark, sf).select("symbol", "date", "close"), ["symbol"], ["date"], 6)


@query("u1_union_relaxed", """select symbol, date::timestamp date, volume::double volume, null::varchar award_id from bars union all
    select symbol, event_date::timestamp, amount, award_id from awards""", ("bars", "awards"))
def u1(spark, sf):
    from catalog.base import awards
    a = bars(spark, sf).select("symbol", "date", "volume")
    b = awards(spark, sf).select("symbol", F.col("event_date").cast("timestamp").alias("date"),
                                 F.col("amount").alias("volume"), "award_id")
    return U.union_relaxed(a, b)


@query("u2_keep_last", """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey
    order by o_orderdate desc, o_orderkey desc) rn from orders) where rn=1""")
def u2(spark, sf):
    rows = table(spark, sf, "orders")
    return U.keep_last(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
TOKENS = f"list_distinct(list_filter(string_split_regex(lower(text), '{WS}'), lambda x: x <> ''))"


@query("u3_token_sets", f"""select doc_id, len(list_distinct(list_concat(a,b))) n_union, len(list_filter(a, lambda x: not list_contains(b,x))) n_minus
    from (select doc_id, {TOKENS} a, list_distinct(list_filter(string_split_regex(lower(source||' '||lang||' the of and'), '{WS}'), lambda x: x <> '')) b
    from documents)""")
def u3(spark, sf):
    from tidemark.functions.columns import set_minus, set_union, token_set
    other = F.concat_ws(" ", "source", "lang", F.lit("the of and"))
    docs = table(spark, sf, "documents").select("doc_id", token_set("text").alias("a"), token_set(other).alias("b"))
    return docs.select("doc_id", F.size(set_union("a", "b")).alias("n_union"), F.size(set_minus("a", "b")).alias("n_minus"))
