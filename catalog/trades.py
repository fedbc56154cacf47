"""Fills, books, equity and performance."""

from pyspark.sql import functions as F

from catalog import base
from catalog.base import bars, fills, orders_view, query, ubars
from tidemark.operators import trades as T

base.SQL_VIEWS.update({
    "tape": """select *, case when side='Buy' then quantity else -quantity end::double signed,
       row_number() over (partition by symbol order by ts, order_id) rn from fills""",
    "book": """select symbol, rn, ts, order_id, price, commission, signed, 0.0::double qb, 0.0::double ab, signed qa, price aa
       from tape where rn=1 union all
       select t.symbol, t.rn, t.ts, t.order_id, t.price, t.commission, t.signed, b.qa, b.aa, b.qa+t.signed,
       case when b.qa+t.signed=0 then 0 when b.qa=0 then t.price when sign(b.qa)=sign(t.signed)
         then (b.aa*abs(b.qa)+t.price*abs(t.signed))/abs(b.qa+t.signed)
         when sign(b.qa+t.signed)<>sign(b.qa) then t.price else b.aa end
       from book b join tape t on t.symbol=b.symbol and t.rn=b.rn+1""",
    "gross": """select *, case when qb=0 or sign(qb)=sign(signed) then 0 else (price-ab)*least(abs(signed),abs(qb))*sign(qb) end g,
       not (qb=0 or sign(qb)=sign(signed)) closes from book""",
    "pnls": "select symbol, ts, order_id, g-commission pnl from gross where closes",
    "equity": """select date, cash, cash+mv equity, gross_notional from (select d.date,
       100000.0::double - (select sum(case when side='Buy' then quantity*price else -quantity*price end + commission)
          from fills f where cast(f.ts as date)<=d.date) cash,
       sum(qty*px) mv, sum(abs(qty)*px) gross_notional from (select distinct date from ubars) d
       join (select dd.date, u.symbol, arg_max(u.close, u.date) px from (select distinct date from ubars) dd
          join ubars u on u.date<=dd.date group by 1,2) p on p.date=d.date
       join (select dd.date, t.symbol, sum(signed) qty from (select distinct date from ubars) dd
          join tape t on cast(t.ts as date)<=dd.date group by 1,2) q on q.date=d.date and q.symbol=p.symbol group by 1)""",
    "rets": """select date as day, (equity-lag(equity) over w)/nullif(lag(equity) over w,0)*100 r from equity
       window w as (order by date) qualify r is not null""",
    "falls": """select max((pk-equity)/pk*100) mdd from (select equity, max(equity) over (order by date rows unbounded preceding) pk
       from equity)""",
})
base.DEPENDS.update({"tape": ("fills",), "book": ("tape",), "gross": ("book",), "pnls": ("gross",),
                     "equity": ("ubars", "tape"), "rets": ("equity",), "falls": ("equity",)})


@query("e1_label_fills", """select order_id, symbol, side, price + case when side='Buy' then 1 else -1 end * price*0.0001 price,
    quantity::bigint quantity, ts, greatest(quantity*0.005, 1.0) commission, 1.0::double slippage_bps from (
    select id order_id, symbol, side, quantity, date ts,
    case "type" when 'Market' then "close" when 'Limit' then case when side='Buy' and low<=limit_price then least(limit_price, "open")
      when side='Sell' and high>=limit_price then greatest(limit_price, "open") end
    when 'Stop' then case when side='Sell' and low<=stop_price or side='Buy' and high>=stop_price then stop_price end
    else case when side='Sell' and low<=stop_price then coalesce(limit_price, stop_price) end end price
    from orders_view join bars using (symbol, date)) where price is not null""", ("orders_view", "bars"),
       {"price": 6, "commission": 6})
def e1(spark, sf):
    return T.label_fills(orders_view(spark, sf), bars(spark, sf))


@query("e2_market_cost", """select order_id, price*case when side='Buy' then 1.0002 else 0.9998 end fill_price,
    greatest(quantity*0.005,1.0) fee from fills""", ("fills",), {"fill_price": 6, "fee": 6})
def e2(spark, sf):
    out = T.market_cost(fills(spark, sf).drop("commission"), bps=2.0)
    return out.select("order_id", "fill_price", F.col("commission").alias("fee"))


@query("f2_custom_commission", "select order_id, price*quantity*0.001 fee from fills", ("fills",), {"fee": 6})
def f2(spark, sf):
    own = F.col("price") * F.col("quantity") * 0.001
    return T.market_cost(fills(spark, sf).drop("commission"), commission=own).select(
        "order_id", F.col("commission").alias("fee"))


@query("e3_realized_pnl", "select symbol, ts, order_id, pnl from pnls", ("pnls",), {"pnl": 5})
def e3(spark, sf):
    return T.realized_pnl(fills(spark, sf))


@query("e4_position_ledger", """select symbol, ts, order_id, qa quantity, case when qa<>0 then aa end avg_entry, g realized,
    sum(g) over (partition by symbol order by rn rows unbounded preceding) realized_total from gross""", ("gross",),
       {"avg_entry": 5, "realized": 5, "realized_total": 3})
def e4(spark, sf):
    return T.position_ledger(fills(spark, sf))


def curve(spark, sf):
    return T.equity_curve(fills(spark, sf), ubars(spark, sf))


@query("e5_equity_curve", "select date, cash, equity, gross_notional from equity", ("equity",),
       {"cash": 2, "equity": 2, "gross_notional": 2})
def e5(spark, sf):
    return curve(spark, sf)


@query("e6_buying_power", "select date, equity/0.3-gross_notional buying_power from equity", ("equity",), {"buying_power": 2})
def e6(spark, sf):
    return T.buying_power(curve(spark, sf)).select("date", "buying_power")


@query("e7_daily_returns", "select day, r return_pct from rets", ("rets",), {"return_pct": 6})
def e7(spark, sf):
    return T.daily_returns(curve(spark, sf))


@query("e8_sharpe", "select (avg(r)-0.01)/sqrt((sum((r-avg_r+0.01)*(r-avg_r+0.01)))/(count(*)-1))*sqrt(252) sharpe_ratio "
                    "from (select r, avg(r) over () avg_r from rets)", ("rets",), {"sharpe_ratio": 6})
def e8(spark, sf):
    return T.sharpe_ratio(curve(spark, sf), rf=2.52)


@query("e9_sortino", "select (avg(r)-0.01)/sqrt(sum(least(r-0.01,0)*least(r-0.01,0))/count(*))*sqrt(252) sortino_ratio from rets",
       ("rets",), {"sortino_ratio": 6})
def e9(spark, sf):
    return T.sortino_ratio(curve(spark, sf), rf=2.52)


@query("e10_max_drawdown", "select mdd max_drawdown_pct from falls", ("falls",), {"max_drawdown_pct": 6})
def e10(spark, sf):
    return T.max_drawdown_pct(curve(spark, sf))


@query("e10_max_drawdown_ticks", """select symbol, max((pk-price)/pk*100) max_drawdown_pct from (select symbol, price, max(price) over
    (partition by symbol order by ts rows unbounded preceding) pk from fills) group by 1""", ("fills",), {"max_drawdown_pct": 6})
def e10_ticks(spark, sf):
    return T.max_drawdown_pct(fills(spark, sf), ["symbol"], "ts", "price")


STATS_SQL = """count(*) total_trades, count(*) filter (pnl>0) winning_trades, count(*) filter (pnl<0) losing_trades,
    avg(pnl) avg_trade_pnl, count(*) filter (pnl>0)/count(*)*100 win_rate_pct,
    sum(pnl) filter (pnl>=0)/-sum(pnl) filter (pnl<0) profit_factor"""


@query("e11_trade_stats", f"select symbol, {STATS_SQL} from pnls group by 1", ("pnls",),
       {"avg_trade_pnl": 5, "win_rate_pct": 6, "profit_factor": 6})
def e11(spark, sf):
    rows = T.realized_pnl(fills(spark, sf))
    return T._trade_stats(rows, ["symbol"])


ANNUAL = "(power(equity_end/100000.0, 1/(date_diff('day', d0, d1)/365.0::double))-1)*100"
ENDS = "(select arg_max(equity, date) equity_end, min(date) d0, max(date) d1 from equity)"


@query("e12_annualised_and_calmar", f"""select (equity_end/100000.0-1)*100 total_return_pct, {ANNUAL} annualized_return_pct,
    {ANNUAL}/mdd calmar_ratio, (select stddev_samp(r) from rets) daily_volatility_pct from {ENDS}, falls""",
       ("rets", "falls"), {"total_return_pct": 6, "annualized_return_pct": 5, "calmar_ratio": 6, "daily_volatility_pct": 6})
def e12(spark, sf):
    out = T.performance_summary(curve(spark, sf), fills(spark, sf))
    return out.select("total_return_pct", "annualized_return_pct", "calmar_ratio", "daily_volatility_pct")


@query("e13_performance_summary", f"""select (equity_end/100000.0-1)*100 total_return_pct, {ANNUAL} annualized_return_pct,
    {ANNUAL}/mdd calmar_ratio, mdd max_drawdown_pct, s.*, t.* from {ENDS}, falls,
    (select avg(r)/stddev_samp(r)*sqrt(252) sharpe_ratio, avg(r)/sqrt(sum(least(r,0)*least(r,0))/count(*))*sqrt(252) sortino_ratio,
      stddev_samp(r) daily_volatility_pct from rets) s, (select {STATS_SQL} from pnls) t""", ("rets", "falls", "pnls"),
       {"total_return_pct": 6, "annualized_return_pct": 5, "calmar_ratio": 6, "max_drawdown_pct": 6, "sharpe_ratio": 6,
        "sortino_ratio": 6, "daily_volatility_pct": 6, "avg_trade_pnl": 5, "win_rate_pct": 6, "profit_factor": 6})
def e13(spark, sf):
    return T.performance_summary(curve(spark, sf), fills(spark, sf))
