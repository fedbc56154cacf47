"""Signal studies, regressions and whole study drivers."""


from catalog import base
from catalog.base import bars, query, revenue, shares, transactions
from catalog.features import AS_OF, panel
from catalog.windows import MOM, PANEL_SQL, STUDY_SQL, buckets, panel as momentum_panel
from tidemark.operators import aggregates as A
from tidemark.plans import drivers as D
from tidemark.plans.regression import fama_macbeth, oos_splits
from tidemark.plans.study import signal_study

FWD = "forward_4d_return"
base.SQL_VIEWS.update({
    "study_rows": STUDY_SQL,
    "quintiles": f"""select quantile, date, avg({FWD}) mean_return, stddev_samp({FWD}) std_return, count(*) n_stocks,
       count(*) filter ({FWD}>0) winners, quantile_cont({FWD}, 0.5) median_return from study_rows group by 1,2""",
    "spreads": """select date, max(mean_return) filter (quantile=5) top_mean, max(mean_return) filter (quantile=1) bottom_mean,
       max(mean_return) filter (quantile=5)-max(mean_return) filter (quantile=1) spread from quintiles group by 1
       having spread is not null""",
    "long_short": """select *, cumulative_spread-max(cumulative_spread) over (order by date rows unbounded preceding) drawdown from
       (select *, sum(spread) over (order by date rows unbounded preceding) cumulative_spread from spreads)""",
    "ranks": f"""select *, rank() over (partition by date order by {MOM})+(count(*) over (partition by date, {MOM})-1)/2 rx,
       rank() over (partition by date order by {FWD})+(count(*) over (partition by date, {FWD})-1)/2 ry from study_rows""",
    "ics": f"""select date, covar_pop({MOM}, {FWD})/nullif(stddev_pop({MOM})*stddev_pop({FWD}),0) pearson_ic,
       covar_pop(rx, ry)/nullif(stddev_pop(rx)*stddev_pop(ry),0) spearman_ic from ranks group by 1 having pearson_ic is not null""",
})
base.DEPENDS.update({"study_rows": ("bars",), "quintiles": ("study_rows",), "spreads": ("quintiles",),
                     "long_short": ("spreads",), "ranks": ("study_rows",), "ics": ("ranks",)})


@query("a3_quantile_returns", "select * from quintiles", ("quintiles",),
       {"mean_return": 6, "std_return": 6, "median_return": 6})
def a3(spark, sf):
    return A.quantile_returns(buckets(spark, sf), FWD)


@query("a4_quantile_summary", f"""select quantile, avg({FWD}) avg_return, stddev_samp({FWD}) std_return, count(*) filter ({FWD}>0) win_count,
    count(*) total_count, count(*) filter ({FWD}>0)/count(*)*100 hit_rate_pct from study_rows group by 1""", ("study_rows",),
       {"avg_return": 6, "std_return": 6, "hit_rate_pct": 6})
def a4(spark, sf):
    return A.quantile_summary(buckets(spark, sf), FWD)


@query("a5_ic_by_period", "select * from ics", ("ics",), {"pearson_ic": 6, "spearman_ic": 6})
def a5(spark, sf):
    return A.ic_by_period(buckets(spark, sf), MOM, FWD)


IC_SUMMARY = """select avg(pearson_ic) pearson_ic_mean, stddev_samp(pearson_ic) pearson_ic_std, avg(pearson_ic)/stddev_samp(pearson_ic) pearson_ic_ir,
    avg(spearman_ic) spearman_ic_mean, count(*) filter (pearson_ic>0)/count(*)*100 ic_positive_pct,
    avg(pearson_ic)/stddev_samp(pearson_ic)*sqrt(count(*)) ic_t_stat, count(*) n_ic_periods from ics"""
IC_FLOATS = {"pearson_ic_mean": 6, "pearson_ic_std": 6, "pearson_ic_ir": 6, "spearman_ic_mean": 6, "ic_positive_pct": 6,
             "ic_t_stat": 6}


@query("a6_ic_summary", IC_SUMMARY, ("ics",), IC_FLOATS)
def a6(spark, sf):
    return A.ic_summary(A.ic_by_period(buckets(spark, sf), MOM, FWD))


@query("a7_top_by_year", f"select year(date)::int \"year\", avg({FWD}) top_quintile_return from study_rows where quantile=5 group by 1",
       ("study_rows",), {"top_quintile_return": 6})
def a7(spark, sf):
    return A.top_by_year(buckets(spark, sf), FWD)


@query("a10_cut_points", f"""select quantile, quantile_cont({FWD}, 1/3::double) q1, quantile_cont({FWD}, 2/3::double) q2
    from study_rows group by 1""", ("study_rows",), {"q1": 6, "q2": 6})
def a10(spark, sf):
    return A.cut_points(buckets(spark, sf), FWD, by=["quantile"])


@query("a10_cut_points_whole_table", """select quantile_cont(o_totalprice, 0.5) q50, quantile_cont(o_totalprice, 0.99) q99,
    quantile_cont(o_totalprice, 0.001) q001 from orders""", (), {"q50": 3, "q99": 3, "q001": 3})
def a10_all(spark, sf):
    return A.cut_points(base.table(spark, sf, "orders"), "o_totalprice", {"q50": 0.5, "q99": 0.99, "q001": 0.001})


@query("r6_signal_study_long_short", "select * from long_short", ("long_short",),
       {"top_mean": 6, "bottom_mean": 6, "spread": 6, "cumulative_spread": 5, "drawdown": 5})
def r6(spark, sf):
    return signal_study(momentum_panel(spark, sf), MOM, FWD)["long_short"]


@query("r6_signal_study_spread", """select avg(spread) mean_spread, stddev_samp(spread) std_spread,
    avg(spread)/stddev_samp(spread)*sqrt(63) sharpe, min(drawdown) max_drawdown_pct from long_short""", ("long_short",),
       {"mean_spread": 6, "std_spread": 6, "sharpe": 6, "max_drawdown_pct": 5})
def r6_spread(spark, sf):
    return signal_study(momentum_panel(spark, sf), MOM, FWD)["spread_summary"]


@query("r6_signal_study_meta", f"""select '{MOM}' feature, '{FWD}' forward_col, 5 n_quantiles, 4 rebalance_days, 63.0::double periods_per_year,
    count(distinct date) n_periods, count(distinct symbol) n_symbols, count(*) n_observations, min(date) first_period,
    max(date) last_period from study_rows""", ("study_rows",), {"periods_per_year": 2})
def r6_meta(spark, sf):
    return signal_study(momentum_panel(spark, sf), MOM, FWD)["meta"]


# Slopes by the closed form of one and two standardised regressors.
FM1 = """select date, count(*) n, covar_pop(x, y)/stddev_pop(x) b, pow(covar_pop(x,y)/stddev_pop(x),2)/nullif(var_pop(y),0) r2
    from s group by 1 having count(*)>=3 and stddev_pop(x)>0"""


@query("r7_fama_macbeth_one", f"""with s as (select date, {MOM} x, {FWD} y from study_all), f as ({FM1})
    select '{MOM}' feature, avg(b) mean, stddev_samp(b) std, avg(b)/(stddev_samp(b)/sqrt(count(*))) t_stat, count(*) n_periods,
    avg(r2) avg_r2 from f""", ("study_all",), {"mean": 6, "std": 6, "t_stat": 6, "avg_r2": 6})
def r7_one(spark, sf):
    return fama_macbeth(momentum_panel(spark, sf), [MOM], FWD)


base.SQL_VIEWS["study_all"] = f"""select p.* from (select * from ({PANEL_SQL}) where {MOM} is not null and {FWD} is not null) p
    join (select date, row_number() over (order by date)-1 i from (select distinct date from ({PANEL_SQL}) where {MOM} is not null
    and {FWD} is not null)) using (date) where i % 4 = 0"""
base.DEPENDS["study_all"] = ("bars",)

FM2 = """select {k} date, count(*) n, sd1, sd2, r, c1, c2, (c1-r*c2)/(1-r*r) b1, (c2-r*c1)/(1-r*r) b2, vy from (
    select {k} date, count(*) n, stddev_pop(x1) sd1, stddev_pop(x2) sd2, covar_pop(x1,x2)/nullif(stddev_pop(x1)*stddev_pop(x2),0) r,
    covar_pop(x1,y)/nullif(stddev_pop(x1),0) c1, covar_pop(x2,y)/nullif(stddev_pop(x2),0) c2, var_pop(y) vy from s group by {g})
    where n>=4 and sd1>0 and sd2>0 group by all"""
FM2_OUT = """select {k} feature, avg(b) mean, stddev_samp(b) std, avg(b)/(stddev_samp(b)/sqrt(count(*))) t_stat, count(*) n_periods,
    avg(r2) avg_r2 from (select {k} '{f1}' feature, b1 b, (b1*c1+b2*c2)/vy r2 from f union all
    select {k} '{f2}', b2, (b1*c1+b2*c2)/vy from f) group by all"""
FM_FLOATS = {"mean": 5, "std": 5, "t_stat": 5, "avg_r2": 5}


@query("r7_fama_macbeth_two", f"""with s0 as (select date, contract_intensity x1, price_momentum_12d x2, {FWD} y from panel
    where contract_intensity is not null and price_momentum_12d is not null and {FWD} is not null),
    s as (select s0.* from s0 join (select date, row_number() over (order by date)-1 i from (select distinct date from s0)) using (date)
    where i%4=0), f as ({FM2.format(k='', g='date')}) {FM2_OUT.format(k='', f1='contract_intensity', f2='price_momentum_12d')}""",
       ("panel",), FM_FLOATS)
def r7_two(spark, sf):
    return fama_macbeth(panel(spark, sf), ["contract_intensity", "price_momentum_12d"], FWD)


# Three regressors: the inverse of the 3x3 correlation matrix written out.
FM3 = """select {k} date, n, c1, c2, c3, vy, (c1*(1-r23*r23)+c2*(r13*r23-r12)+c3*(r12*r23-r13))/det b1,
    (c1*(r13*r23-r12)+c2*(1-r13*r13)+c3*(r12*r13-r23))/det b2, (c1*(r12*r23-r13)+c2*(r12*r13-r23)+c3*(1-r12*r12))/det b3 from (
    select *, 1+2*r12*r13*r23-r12*r12-r13*r13-r23*r23 det from (select {k} date, count(*) n, var_pop(y) vy, stddev_pop(x1) d1,
    stddev_pop(x2) d2, stddev_pop(x3) d3, covar_pop(x1,x2)/nullif(stddev_pop(x1)*stddev_pop(x2),0) r12,
    covar_pop(x1,x3)/nullif(stddev_pop(x1)*stddev_pop(x3),0) r13, covar_pop(x2,x3)/nullif(stddev_pop(x2)*stddev_pop(x3),0) r23,
    covar_pop(x1,y)/nullif(stddev_pop(x1),0) c1, covar_pop(x2,y)/nullif(stddev_pop(x2),0) c2, covar_pop(x3,y)/nullif(stddev_pop(x3),0) c3
    from s group by {g}) where n>=5 and d1>0 and d2>0 and d3>0)"""
FM3_OUT = "select {k} feature, avg(b) mean, stddev_samp(b) std, avg(b)/(stddev_samp(b)/sqrt(count(*))) t_stat, count(*) n_periods, " \
    "avg(r2) avg_r2 from (" + " union all ".join(
        f"select {{k}} '{{f{i}}}' feature, b{i} b, (b1*c1+b2*c2+b3*c3)/vy r2 from f" for i in (1, 2, 3)) + ") group by all"
SAMPLED = """s0 as (select {h} horizon, date, {xs}, forward_{h}d_return y from panel where forward_{h}d_return is not null and {ok}),
    s as (select s0.* from s0 join (select date, row_number() over (order by date)-1 i from (select distinct date from s0)) using (date)
    where i%{h}=0)"""


def _sampled(h, columns):
    xs = ", ".join(f"{c} x{i}" for i, c in enumerate(columns, 1))
    return SAMPLED.format(h=h, xs=xs, ok=" and ".join(f"{c} is not null" for c in columns))


THREE = ["contract_award_velocity_z", "contract_intensity", "price_momentum_12d"]


@query("r7_fama_macbeth_three", f"""with {_sampled(4, THREE)}, f as ({FM3.format(k='', g='date')})
    {FM3_OUT.format(k='', f1=THREE[0], f2=THREE[1], f3=THREE[2])}""", ("panel",), FM_FLOATS)
def r7_three(spark, sf):
    return fama_macbeth(panel(spark, sf), THREE, FWD)


def _model_sql(name, columns, h):
    names = [c.replace("_12d", "") for c in columns]
    outer = f"'{name}' model, {h} horizon, "
    named = {f"f{i}": n for i, n in enumerate(names, 1)}
    body = (FM2, FM2_OUT) if len(columns) == 2 else (FM3, FM3_OUT)
    return (f"select * from (with {_sampled(h, columns)}, f as ({body[0].format(k='', g='date')}) "
            f"select {outer} t.* from ({body[1].format(k='', **named)}) t)")


REGRESSIONS = " union all ".join(_model_sql(n, c, h) for h in (4, 12) for n, c in (
    ("velocity_vs_momentum", [THREE[0], THREE[2]]), ("intensity_vs_momentum", [THREE[1], THREE[2]]), ("all_three", THREE)))


@query("r16_oos_splits", f"""with s1 as (select symbol, date, contract_intensity x1, price_momentum_12d x2, {FWD} y from panel
    where contract_intensity is not null and price_momentum_12d is not null and {FWD} is not null),
    d as (select date, row_number() over (order by date)-1 i, count(*) over () n from (select distinct date from s1)),
    y as (select symbol, row_number() over (order by symbol)-1 j from (select distinct symbol from s1)),
    s2 as (select split, s1.* from s1 join d using (date) join y using (symbol), lateral (select unnest(['full',
      case when i < n//2 then 'in_sample_first_half' else 'oos_second_half' end,
      case when j%2=0 then 'universe_A' else 'universe_B' end]) split)),
    s as (select s2.* from s2 join (select split, date, row_number() over (partition by split order by date)-1 i from
      (select distinct split, date from s2)) using (split, date) where i%4=0),
    f as ({FM2.format(k='split,', g='split, date')})
    select *, '{FWD}' forward_col from ({FM2_OUT.format(k='split,', f1='contract_intensity', f2='price_momentum_12d')})""",
       ("panel",), FM_FLOATS)
def r16(spark, sf):
    return oos_splits(panel(spark, sf), ["contract_intensity", "price_momentum_12d"], [4])


# All studies of a driver side by side, as the library runs them.
TABLE_SQL = """with l as (select symbol, date, f feature, h horizon, x, y from ({long}) where x is not null and y is not null),
    s as (select l.* from l join (select feature, horizon, date, row_number() over (partition by feature, horizon order by date)-1 i from
      (select distinct feature, horizon, date from l)) using (feature, horizon, date) where i%horizon=0),
    r as (select *, least(greatest((rk-1)*5//n+1,1),5) q from (select *, row_number() over (partition by feature, horizon, date order by x, symbol) rk,
      count(*) over (partition by feature, horizon, date) n, rank() over (partition by feature, horizon, date order by x)+(count(*) over (partition by feature, horizon, date, x)-1)/2 rx,
      rank() over (partition by feature, horizon, date order by y)+(count(*) over (partition by feature, horizon, date, y)-1)/2 ry from s) where n>=5),
    ic as (select feature, horizon, date, covar_pop(x,y)/nullif(stddev_pop(x)*stddev_pop(y),0) p,
      covar_pop(rx,ry)/nullif(stddev_pop(rx)*stddev_pop(ry),0) sp from r group by all having p is not null),
    sd as (select feature, horizon, date, avg(y) filter (q=5)-avg(y) filter (q=1) spread from r group by all having spread is not null),
    dd as (select *, sum(spread) over w c from sd window w as (partition by feature, horizon order by date rows unbounded preceding)),
    de as (select *, c-max(c) over (partition by feature, horizon order by date rows unbounded preceding) d from dd)
    select feature, horizon, avg(p) pearson_ic_mean, stddev_samp(p) pearson_ic_std, avg(p)/stddev_samp(p) pearson_ic_ir, avg(sp) spearman_ic_mean,
    count(*) filter (p>0)/count(*)*100 ic_positive_pct, avg(p)/stddev_samp(p)*sqrt(count(*)) ic_t_stat, count(*) n_ic_periods, any_value(ms) mean_spread,
    any_value(ss) std_spread, any_value(ms/ss*sqrt(252.0/horizon)) sharpe, any_value(md) max_drawdown_pct from ic join
    (select feature, horizon, avg(spread) ms, stddev_samp(spread) ss, min(d) md from de group by all) using (feature, horizon) group by all"""
TABLE_FLOATS = {**{n: 5 for n in IC_FLOATS}, "mean_spread": 5, "std_spread": 5, "sharpe": 5, "max_drawdown_pct": 4}


def long_sql(source, features):
    return " union all ".join(f"select symbol, date, '{name}' f, {h} h, {column} x, forward_{h}d_return y from {source}"
                              for h in (4, 12) for name, column in features.items())


def velocity(spark, sf):
    return D.velocity_study(transactions(spark, sf), shares(spark, sf), bars(spark, sf), (4, 12), as_of=AS_OF,
                            momentum_rows=12)


@query("r17_velocity_study", TABLE_SQL.format(long=long_sql("panel", {
    "contract_award_velocity_z": "contract_award_velocity_z", "price_momentum": "price_momentum_12d",
    "contract_intensity": "contract_intensity"})), ("panel",), TABLE_FLOATS)
def r17_velocity(spark, sf):
    return velocity(spark, sf)["studies"]


@query("r17_velocity_regressions", REGRESSIONS, ("panel",), FM_FLOATS)
def r17_regressions(spark, sf):
    return velocity(spark, sf)["regressions"]


base.SQL_VIEWS["growth_panel"] = """select b.symbol, b.date, g.x rev_yoy_growth, a.x rev_yoy_accel,
    (lead(close,4) over w-close)/close*100 forward_4d_return, (lead(close,12) over w-close)/close*100 forward_12d_return,
    (close/lag(close,12) over w-1)*100 price_momentum
    from bars b asof left join (select symbol, ts_available ts, feature_value x from growth_rows where feature_name='rev_yoy_growth') g
    on b.symbol=g.symbol and b.date>=g.ts asof left join (select symbol, ts_available ts, feature_value x from growth_rows
    where feature_name='rev_yoy_accel') a on b.symbol=a.symbol and b.date>=a.ts window w as (partition by b.symbol order by b.date)"""
base.DEPENDS["growth_panel"] = ("bars", "growth_rows")


@query("r17_fundamental_study", TABLE_SQL.format(long=long_sql("growth_panel", {
    n: n for n in ("rev_yoy_accel", "rev_yoy_growth", "price_momentum")})), ("growth_panel",), TABLE_FLOATS)
def r17_fundamental(spark, sf):
    return D.fundamental_study(revenue(spark, sf), bars(spark, sf), (4, 12), 12)["studies"]
