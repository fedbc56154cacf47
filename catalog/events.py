"""Event studies over large awards and revenue surprises."""

from pyspark.sql import functions as F

from catalog import base
from catalog.base import awards, bars, query, revenue
from tidemark.operators.aggregates import clustered_t
from tidemark.operators.joins import with_benchmark
from tidemark.plans import events as E
from tidemark.plans.features import fundamental_momentum

WINDOWS = [(-4, -1), (0, 0), (1, 5), (1, 12)]


def _frame(a: int, b: int) -> str:
    side = lambda n: "current row" if n == 0 else f"{abs(n)} {'following' if n > 0 else 'preceding'}"
    return f"(partition by symbol order by i rows between {side(a)} and {side(b)})"


def _car(a: int, b: int) -> str:
    w = _frame(a, b)
    return f"case when count(ar) over {w}={b - a + 1} then sum(ar) over {w} end {E.car_name(a, b)}"


NAMES = [E.car_name(a, b) for a, b in WINDOWS]
STATS = " union all ".join(
    f"""select {{k}} '[{a},{b}]' "window", count({n}) n, coalesce(avg({n}),0) mean_car_pct,
    coalesce(case when count({n})>1 and stddev_samp({n})>0 then avg({n})/(stddev_samp({n})/sqrt(count({n}))) end,0) t_stat,
    coalesce(count(*) filter ({n}>0)/nullif(count({n}),0)*100,0) hit_rate_pct from {{t}} {{g}}"""
    for (a, b), n in zip(WINDOWS, NAMES))
STAT_FLOATS = {"mean_car_pct": 5, "t_stat": 5, "hit_rate_pct": 5}

base.SQL_VIEWS.update({
    "ars": """select symbol, date, row_number() over w-1 i, ((close/lag(close) over w-1)-(bc/lag(bc) over w-1))*100 ar from (
       select b.symbol, b.date, b.close, m.close bc from bars b left join bars m on m.symbol='S00' and m.date=b.date where b.symbol<>'S00')
       window w as (partition by symbol order by date)""",
    "car_bars": f"select symbol, date, i, {', '.join(_car(a, b) for a, b in WINDOWS)} from ars",
    "surprises": """select symbol, ts_available::date event_date, feature_value amount from growth_rows where feature_name='rev_yoy_accel'""",
    "event_cars": f"""select e.symbol, e.event_date, e.amount, e.award_id, {', '.join('c.' + n for n in NAMES)} from awards e asof join car_bars c
       on c.symbol=e.symbol and e.event_date<=c.date where e.event_date >= (select min(date) from ars f where f.symbol=e.symbol)""",
    "surprise_cars": f"""select e.symbol, e.event_date, e.amount, {', '.join('c.' + n for n in NAMES)} from surprises e asof join car_bars c
       on c.symbol=e.symbol and e.event_date<=c.date where e.event_date >= (select min(date) from ars f where f.symbol=e.symbol)""",
})
base.DEPENDS.update({"ars": ("bars",), "car_bars": ("ars",), "surprises": ("growth_rows",),
                     "event_cars": ("awards", "car_bars"), "surprise_cars": ("surprises", "car_bars")})


def priced(spark, sf):
    return with_benchmark(bars(spark, sf), "S00", drop=True)


def surprises(spark, sf):
    rows = fundamental_momentum(revenue(spark, sf)).filter("feature_name = 'rev_yoy_accel'")
    return rows.select("symbol", F.col("ts_available").cast("date").alias("event_date"),
                       F.col("feature_value").alias("amount"))


@query("r8_abnormal_returns", """select e.symbol, e.event_date, e.award_id, (a.i-t.i)::int rel_day, a.ar from (select e.*, c.i t0 from awards e
    asof join ars c on c.symbol=e.symbol and e.event_date<=c.date where e.event_date >= (select min(date) from ars f where f.symbol=e.symbol)) e
    join ars t on t.symbol=e.symbol and t.i=e.t0 join ars a on a.symbol=e.symbol and a.i between e.t0-3 and e.t0+5""",
       ("awards", "ars"), {"ar": 5})
def r8(spark, sf):
    out = E.abnormal_returns(priced(spark, sf), awards(spark, sf), 3, 5)
    return out.select("symbol", "event_date", "award_id", "rel_day", "ar")


@query("r9_event_cars", "select * from event_cars", ("event_cars",), {n: 5 for n in NAMES})
def r9(spark, sf):
    return E.event_cars(priced(spark, sf), awards(spark, sf), WINDOWS)


@query("r10_caar", """select rel_day, n, aar, sum(aar) over (order by rel_day) caar from (select (a.i-e.t0)::int rel_day, count(*) n, avg(a.ar) aar
    from (select e.symbol, c.i t0 from awards e asof join ars c on c.symbol=e.symbol and e.event_date<=c.date
    where e.event_date >= (select min(date) from ars f where f.symbol=e.symbol)) e
    join ars a on a.symbol=e.symbol and a.i between e.t0-5 and e.t0+24 where a.ar is not null group by 1)""", ("awards", "ars"),
       {"aar": 6, "caar": 6})
def r10(spark, sf):
    return E.caar(priced(spark, sf), awards(spark, sf), 5, 24)


@query("r11_car_stats", STATS.format(k="", t="event_cars", g=""), ("event_cars",), STAT_FLOATS)
def r11(spark, sf):
    return E.car_stats(E.event_cars(priced(spark, sf), awards(spark, sf), WINDOWS), WINDOWS)


@query("r12_size_buckets", """with c as (select quantile_cont(amount, 1/3::double) q1, quantile_cont(amount, 2/3::double) q2 from event_cars)
    select case when amount<=q1 then 'small' when amount<=q2 then 'mid' else 'large' end bucket, '[1,12]' "window", count(car_1_12) n,
    coalesce(avg(car_1_12),0) mean_car_pct, coalesce(case when count(car_1_12)>1 and stddev_samp(car_1_12)>0 then
    avg(car_1_12)/(stddev_samp(car_1_12)/sqrt(count(car_1_12))) end,0) t_stat,
    coalesce(count(*) filter (car_1_12>0)/nullif(count(car_1_12),0)*100,0) hit_rate_pct from event_cars, c group by 1""", ("event_cars",), STAT_FLOATS)
def r12(spark, sf):
    return E.size_buckets(E.event_cars(priced(spark, sf), awards(spark, sf), WINDOWS), (1, 12))


@query("r13_large_events", """with recursive d as (select symbol, event_date, max(row(amount, award_id)) top, row_number() over
    (partition by symbol order by event_date) rn from awards where amount>=420000 group by 1,2),
    k as (select symbol, rn, event_date last_kept, true kept from d where rn=1 union all
      select d.symbol, d.rn, case when d.event_date-k.last_kept>30 then d.event_date else k.last_kept end, d.event_date-k.last_kept>30
      from k join d on d.symbol=k.symbol and d.rn=k.rn+1)
    select d.symbol, d.event_date, top[1] amount, top[2] award_id from k join d using (symbol, rn) where kept""", ("awards",))
def r13(spark, sf):
    return E.large_events(awards(spark, sf), 420000, 30)


GROUPED = """(select 'all' "group", * from surprise_cars union all select case when amount>0 then 'positive' else 'negative' end, *
    from surprise_cars where amount<>0)"""


@query("r14_surprise_study", STATS.format(k='"group",', t=GROUPED, g='group by 1'), ("surprise_cars",), STAT_FLOATS)
def r14(spark, sf):
    return E.surprise_study(priced(spark, sf), surprises(spark, sf), 4, 12, WINDOWS)["windows"]


@query("r14_surprise_spread", """select "window", p positive_car, n negative_car, p-n spread from (select "window",
    max(mean_car_pct) filter ("group"='positive') p, max(mean_car_pct) filter ("group"='negative') n from (%s) group by 1)"""
       % STATS.format(k='"group",', t=GROUPED, g='group by 1'), ("surprise_cars",),
       {"positive_car": 5, "negative_car": 5, "spread": 5})
def r14_spread(spark, sf):
    return E.surprise_study(priced(spark, sf), surprises(spark, sf), 4, 12, WINDOWS)["spread"]


CLUSTER = """select {k}, sum(k)::bigint n, count(*) n_months, round(sum(k*m)/sum(k)+1e-9,3) mean_pct,
    round(coalesce(case when sum(k)>1 then (sum(k*m)/sum(k))/(sqrt(greatest(sum(q)-sum(k)*pow(sum(k*m)/sum(k),2),0)/nullif(sum(k)-1,0))/sqrt(sum(k))) end,0)+1e-9,2) naive_t,
    round(coalesce(case when count(*)>1 then avg(m)/(stddev_samp(m)/sqrt(count(*))) end,0)+1e-9,2) clustered_t from (
    select {k}, year(event_date)*12+month(event_date) mo, count(v) k, avg(v) m, sum(v*v) q from ({t}) where v is not null group by all) group by all"""


@query("a8_clustered_t", CLUSTER.format(k="symbol", t="select symbol, event_date, car_1_5 v from event_cars"), ("event_cars",))
def a8(spark, sf):
    return clustered_t(E.event_cars(priced(spark, sf), awards(spark, sf), WINDOWS), "car_1_5", ["symbol"])


@query("r15_reversal_study", """with v as (select e.*, d.dollar_vol from surprise_cars e asof left join (select symbol, date, avg(close*volume) over
    (partition by symbol order by date range between interval 62 days preceding and current row) dollar_vol from bars where symbol<>'S00') d
    on d.symbol=e.symbol and e.event_date>=d.date),
    srt as (select list(dollar_vol order by dollar_vol) l from v where dollar_vol is not null),
    cut as (select l[floor((len(l)-1)*(1/3::double)+0.5)::int+1] q1, l[floor((len(l)-1)*(2/3::double)+0.5)::int+1] q2,
      (select quantile_cont(date_diff('day', date '1970-01-01', event_date)::double, 0.5) from v) mid from srt),
    r as (select v.*, case when dollar_vol<=q1 then 'low_liquidity' when dollar_vol<=q2 then 'mid_liquidity' when dollar_vol is not null
      then 'high_liquidity' end liq, case when date_diff('day', date '1970-01-01', event_date)<mid then 'first_half' else 'second_half' end half from v, cut),
    e as (select event_date, 'groups' section, case when amount>0 then 'positive' else 'negative' end "group", '[1,5]' "window", car_1_5 v from r where amount<>0
      union all select event_date, 'groups', case when amount>0 then 'positive' else 'negative' end, '[1,12]', car_1_12 from r where amount<>0
      union all select event_date, 'long_short', 'all', '[1,5]', -sign(amount)*car_1_5 from r
      union all select event_date, 'long_short', 'all', '[1,12]', -sign(amount)*car_1_12 from r
      union all select event_date, 'oos', half, '[1,5]', -sign(amount)*car_1_5 from r
      union all select event_date, 'oos', half, '[1,12]', -sign(amount)*car_1_12 from r
      union all select event_date, 'liquidity', liq, '[1,12]', -sign(amount)*car_1_12 from r where liq is not null)
    """ + CLUSTER.format(k='section, "group", "window"', t="select * from e"), ("surprise_cars", "bars"))
def r15(spark, sf):
    return E.reversal_study(priced(spark, sf), surprises(spark, sf), [(1, 5), (1, 12)])
