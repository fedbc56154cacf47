"""Features, feature-store operators, as-of panels."""

from pyspark.sql import functions as F

from catalog import base
from catalog.base import awards, bars, query, revenue, shared_folder, shares, transactions
from tidemark.operators import aggregates as A, joins as J
from tidemark.operators.sets import union_relaxed
from tidemark.plans import features as P
from tidemark.plans.study import assemble_panel
from tidemark.sources import feature_store as S

AS_OF = "1998-06-30"

base.SQL_VIEWS.update({
    "velocity": """select symbol, action_date, v, case when n>=8 and sd>1e-12*abs(m) then (v-m)/sd end z from (
       select *, count(*) over w n, avg(v) over w m, stddev_samp(v) over w sd from (
       select symbol, action_date, r/(b*(90/730::double)) v from (select symbol, action_date,
         sum(d) over (partition by symbol order by action_date range between interval 89 days preceding and current row) r,
         sum(d) over (partition by symbol order by action_date range between interval 729 days preceding and current row) b
         from (select symbol, action_date, sum(amount) d from transactions where amount>0 and action_date<=date '1998-06-30'
         group by 1,2))) window w as (partition by symbol order by action_date rows unbounded preceding))""",
    "velocity_rows": """select symbol, (action_date+30)::timestamp ts_available, 'contract_award_velocity_z' feature_name,
       z feature_value, 'usaspending_tx' source, '' source_event_id, action_date::timestamp asof_date from velocity where z is not null""",
    "ttm_rows": """select symbol, (action_date+45)::timestamp ts_available, 'contract_oblig_ttm' feature_name, t feature_value,
       'usaspending_tx' source, '' source_event_id, action_date::timestamp asof_date from (select symbol, action_date,
       sum(d) over (partition by symbol order by action_date range between interval 364 days preceding and current row) t from
       (select symbol, action_date, sum(amount) d from transactions where action_date<=date '1998-06-30' group by 1,2)) where t>0""",
    "growth": """select symbol, "end", filed, y, y-lag(y) over w a from (select symbol, fp, "end", filed, val/lag(val) over
       (partition by symbol, fp order by "end")-1 y from revenue where date_diff('day', start, "end") between 80 and 100 and val>0)
       window w as (partition by symbol, fp order by "end")""",
    "growth_rows": """select symbol, filed::timestamp ts_available, n feature_name, x*100 feature_value, 'sec_xbrl' source,
       "end"::varchar source_event_id, "end"::timestamp asof_date from (select symbol, filed, "end", 'rev_yoy_growth' n, y x from growth
       union all select symbol, filed, "end", 'rev_yoy_accel', a from growth) where x is not null""",
    "size_rows": """select symbol, ts_available, 'shares_outstanding' feature_name, shares feature_value, 'sec_edgar' source,
       '' source_event_id, ts_available asof_date from shares""",
    "panel": """select b.*, v.z contract_award_velocity_z, t.x contract_oblig_ttm, s.x shares_outstanding,
       (lead(close,4) over w-close)/close*100 forward_4d_return, (lead(close,12) over w-close)/close*100 forward_12d_return,
       (close/lag(close,12) over w-1)*100 price_momentum_12d, close*s.x market_cap,
       case when close*s.x>0 then t.x/(close*s.x) end contract_intensity
       from bars b asof left join (select symbol, ts_available ts, feature_value z from velocity_rows) v on b.symbol=v.symbol and b.date>=v.ts
       asof left join (select symbol, ts_available ts, feature_value x from ttm_rows) t on b.symbol=t.symbol and b.date>=t.ts
       asof left join (select symbol, ts_available ts, feature_value x from size_rows) s on b.symbol=s.symbol and b.date>=s.ts
       window w as (partition by b.symbol order by b.date)""",
})
base.DEPENDS.update({
    "velocity": ("transactions",), "velocity_rows": ("velocity",), "ttm_rows": ("transactions",), "growth": ("revenue",),
    "growth_rows": ("growth",), "size_rows": ("shares",), "panel": ("bars", "velocity_rows", "ttm_rows", "size_rows"),
})


def velocity(spark, sf):
    return P.award_velocity(transactions(spark, sf), as_of=AS_OF)


def panel(spark, sf, horizons=(4, 12)):
    tx = transactions(spark, sf)
    rows = union_relaxed(P.award_velocity(tx, as_of=AS_OF), P.trailing_obligations(tx, as_of=AS_OF),
                         P.size_features(shares(spark, sf)))
    return assemble_panel(bars(spark, sf), rows, list(horizons), momentum_rows=12)


@query("a1_daily_totals", "select symbol, action_date, sum(amount) daily_amount from transactions group by 1,2",
       ("transactions",), {"daily_amount": 2})
def a1(spark, sf):
    return A.daily_totals(transactions(spark, sf))


@query("a2_monthly_award_velocity", """select *, sum(monthly_awards) over w trailing_3mo_total, sum(award_count) over w::double trailing_3mo_count
    from (select symbol vendor, cast(date_trunc('month', event_date) as date) "month", sum(amount) monthly_awards,
    count(distinct award_id) award_count, avg(amount) avg_award_size from awards group by 1,2)
    window w as (partition by vendor order by "month" rows 2 preceding)""", ("awards",),
       {"monthly_awards": 2, "avg_award_size": 3, "trailing_3mo_total": 2, "trailing_3mo_count": 0})
def a2(spark, sf):
    rows = awards(spark, sf).withColumnRenamed("symbol", "vendor").withColumnRenamed("event_date", "start_date")
    return A.monthly_award_velocity(rows)


@query("r1_award_velocity", "select * from velocity_rows", ("velocity_rows",), {"feature_value": 5})
def r1(spark, sf):
    return velocity(spark, sf)


@query("r2_trailing_obligations", "select * from ttm_rows", ("ttm_rows",), {"feature_value": 2})
def r2(spark, sf):
    return P.trailing_obligations(transactions(spark, sf), as_of=AS_OF)


@query("r3_fundamental_momentum", "select * from growth_rows", ("growth_rows",), {"feature_value": 6})
def r3(spark, sf):
    return P.fundamental_momentum(revenue(spark, sf))


@query("r4_size_features", "select * from size_rows", ("size_rows",))
def r4(spark, sf):
    return P.size_features(shares(spark, sf))


@query("j1_asof_join", """select b.symbol, b.date, b.close, g.feature_value rev_yoy_growth, a.feature_value rev_yoy_accel from bars b
    asof left join (select * from growth_rows where feature_name='rev_yoy_growth') g on b.symbol=g.symbol and b.date>=g.ts_available
    asof left join (select * from growth_rows where feature_name='rev_yoy_accel') a on b.symbol=a.symbol and b.date>=a.ts_available""",
       ("bars", "growth_rows"), {"rev_yoy_growth": 6, "rev_yoy_accel": 6})
def j1(spark, sf):
    rows = P.fundamental_momentum(revenue(spark, sf))
    return J.asof_join(bars(spark, sf).select("symbol", "date", "close"), rows, ["rev_yoy_growth", "rev_yoy_accel"])


@query("j2_coverage", """select 'rev_yoy_growth' feature, count(g) populated, count(*) total, round(count(g)/count(*)*100,1) coverage_pct from (
    select g.feature_value g from bars b asof left join (select * from growth_rows where feature_name='rev_yoy_growth') g
    on b.symbol=g.symbol and b.date>=g.ts_available) union all
    select 'close', count(close), count(*), round(count(close)/count(*)*100,1) from bars""", ("bars", "growth_rows"))
def j2(spark, sf):
    return J.coverage(j1(spark, sf), ["rev_yoy_growth", "close"])


@query("r5_assemble_panel", "select * from panel", ("panel",),
       {"contract_award_velocity_z": 5, "contract_oblig_ttm": 2, "forward_4d_return": 6, "forward_12d_return": 6,
        "price_momentum_12d": 6, "market_cap": 2, "contract_intensity": 8})
def r5(spark, sf):
    return panel(spark, sf)


@query("s7_feature_store_upsert", """select symbol, ts_available, feature_name, case when day(asof_date)<=10 then feature_value+1
    else feature_value end feature_value, source, source_event_id, asof_date from velocity_rows""", ("velocity_rows",),
       {"feature_value": 5})
def s7(spark, sf):
    rows = velocity(spark, sf)
    fresh = rows.filter(F.dayofmonth("asof_date") <= 10).withColumn("feature_value", F.col("feature_value") + 1)
    return S.upsert(rows, fresh)


@query("s7_feature_store_roundtrip", """select symbol, ts_available, feature_name, case when day(asof_date)<=10 then feature_value+1
    else feature_value end feature_value, source, source_event_id, asof_date from velocity_rows""", ("velocity_rows",),
       {"feature_value": 5})
def s7_store(spark, sf):
    store = S.FeatureStore(spark, shared_folder(spark, "features"))
    rows = velocity(spark, sf)
    store.add(rows)
    store.add(rows.filter(F.dayofmonth("asof_date") <= 10).withColumn("feature_value", F.col("feature_value") + 1))
    return store.read(["contract_award_velocity_z"])


def all_rows(spark, sf):
    return union_relaxed(velocity(spark, sf), P.fundamental_momentum(revenue(spark, sf)))


ALL = "(select * from velocity_rows union all select * from growth_rows)"


@query("s8_feature_point_query", f"""select * from {ALL} where symbol='S03' and ts_available<=timestamp '1996-01-01'
    qualify row_number() over (partition by feature_name order by ts_available desc)=1""", ("velocity_rows", "growth_rows"),
       {"feature_value": 5})
def s8(spark, sf):
    return S.point_query(all_rows(spark, sf), "S03", "1996-01-01")


@query("s9_feature_range_query", f"""select * from {ALL} where symbol in ('S03','S07') and feature_name in ('rev_yoy_growth',
    'contract_award_velocity_z') and ts_available between timestamp '1995-01-01' and timestamp '1996-12-31'""",
       ("velocity_rows", "growth_rows"), {"feature_value": 5})
def s9(spark, sf):
    return S.range_query(all_rows(spark, sf), ["S03", "S07"], ["rev_yoy_growth", "contract_award_velocity_z"],
                         "1995-01-01", "1996-12-31")


@query("s10_feature_summary", f"""select feature_name, count(*) "rows", count(distinct symbol) symbols, min(ts_available) min_ts,
    max(ts_available) max_ts from {ALL} group by 1""", ("velocity_rows", "growth_rows"))
def s10(spark, sf):
    return S.summary(all_rows(spark, sf))
