"""Order fills, position books, equity curves and performance measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import ratio
from tidemark.operators.ordered import affine_scan, cell_for, dealt, running, with_neighbours
from tidemark.session import reused

# Cost defaults (fixed values).
SLIPPAGE_BPS = 1.0
COMMISSION_PER_SHARE = 0.005
MIN_COMMISSION = 1.0
MARGIN_RATE = 0.30


def _commission(per_share: float, minimum: float) -> Column:
    return F.greatest(F.col("quantity") * per_share, F.lit(minimum))


def _slipped(price: Column, bps: float) -> Column:
    slip = price * (bps / 10_000.0)
    return F.when(F.col("side") == "Buy", price + slip).otherwise(price - slip)


def label_fills(orders: DataFrame, bars: DataFrame, bps: float = SLIPPAGE_BPS,
                per_share: float = COMMISSION_PER_SHARE, min_commission: float = MIN_COMMISSION,
                date: str = "date") -> DataFrame:
    """Orders matched to their symbol's bar of the day; unfilled orders drop out."""
    buy, sell = F.col("side") == "Buy", F.col("side") == "Sell"
    kind, limit, stop = F.col("type"), F.col("limit_price"), F.col("stop_price")
    at_limit = F.when(buy & (F.col("low") <= limit), F.least(limit, "open")).when(
        ~buy & (F.col("high") >= limit), F.greatest(limit, "open"))
    stop_hit = (sell & (F.col("low") <= stop)) | (buy & (F.col("high") >= stop))
    price = (
        F.when(kind == "Market", F.col("close"))
        .when(kind == "Limit", at_limit)
        .when((kind == "Stop") & stop_hit, stop)
        .when((kind == "StopLimit") & sell & (F.col("low") <= stop), F.coalesce(limit, stop))
    )
    matched = orders.join(bars.select("symbol", date, "open", "high", "low", "close"), ["symbol", date])
    return matched.withColumn("_p", price).filter(F.col("_p").isNotNull()).select(
        F.col("id").alias("order_id"), "symbol", "side", _slipped(F.col("_p"), bps).alias("price"),
        F.col("quantity").cast("long").alias("quantity"), F.col(date).alias("ts"),
        _commission(per_share, min_commission).alias("commission"), F.lit(bps).alias("slippage_bps"))


def market_cost(orders: DataFrame, price: str = "price", bps: float = SLIPPAGE_BPS,
                per_share: float = COMMISSION_PER_SHARE, min_commission: float = MIN_COMMISSION,
                commission: Column | None = None) -> DataFrame:
    """Fill price after slippage and the commission of a market order.

    ``commission`` replaces the default model by any expression over the order.
    """
    fee = commission if commission is not None else _commission(per_share, min_commission)
    return orders.select(
        "*", _slipped(F.col(price), bps).alias("fill_price"), fee.alias("commission"),
        F.lit(bps).alias("slippage_bps"))


def _book(fills: DataFrame, by: Sequence[str], ts: str, seq: str) -> DataFrame:
    """Quantity and average cost before and after each fill.

    The quantity is a running sum. Given the quantities, the average cost is an
    affine recurrence (adding mixes prices, reducing keeps the cost, opening and
    flipping restart it), so even one account's endless tape is scanned in blocks.
    """
    signed = F.when(F.col("side") == "Buy", F.col("quantity")).otherwise(-F.col("quantity")).cast("double")
    needed = fills.select(*by, ts, seq, "price", "commission", signed.alias("_signed"))
    # Any number of fills may share a day or an instant, so cells follow the rows and not the calendar.
    tape = running(dealt(needed, by, [ts, seq]), by, [ts, seq],
                   {"qty_after": ("sum", "_signed"), "_seen": ("count", "_signed")}, F.col("_part"))
    before, after = F.col("qty_after") - F.col("_signed"), F.col("qty_after")
    adds = (before == 0) | (F.signum(before) == F.signum("_signed"))
    restarts = (before == 0) | (after == 0) | (~adds & (F.signum(after) != F.signum(before)))
    mixed = F.abs(after)
    a = F.when(restarts, 0.0).when(adds, F.abs(before) / mixed).otherwise(1.0)
    b = (F.when(after == 0, 0.0).when(restarts, F.col("price"))
         .when(adds, F.col("price") * F.abs("_signed") / mixed).otherwise(0.0))
    steps = tape.select(
        *by, ts, seq, "_part", "price", "commission", "_signed", "qty_after", before.alias("qty_before"), adds.alias("_adds"),
        a.alias("_a"), b.alias("_b"), (F.col("_seen") - 1).alias("_pos"))
    return affine_scan(reused(steps), by, "_a", "_b", "avg_after", before="avg_before")


def _gross() -> Column:
    closing = F.least(F.abs("_signed"), F.abs("qty_before"))
    return F.when(F.col("_adds"), F.lit(0.0)).otherwise(
        (F.col("price") - F.col("avg_before")) * closing * F.signum("qty_before"))


def realized_pnl(fills: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "ts", seq: str = "order_id") -> DataFrame:
    """One row per fill that reduces, closes or flips a position, with its net P&L.

    Average-cost accounting; the fill's own commission is deducted.
    """
    closing = _book(fills, list(by), ts, seq).filter(~F.col("_adds"))
    return closing.select(*by, ts, seq, (_gross() - F.col("commission")).alias("pnl"))


def position_ledger(fills: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "ts",
                    seq: str = "order_id") -> DataFrame:
    """Signed quantity, average entry and realised P&L (before commission) per fill."""
    book = _book(fills, list(by), ts, seq).withColumn("realized", _gross())
    totals = running(book, list(by), [ts, seq], {"realized_total": ("sum", "realized")}, F.col("_part"))
    entry = F.when(F.col("qty_after") != 0, F.col("avg_after"))
    return totals.select(*by, ts, seq, F.col("qty_after").alias("quantity"), entry.alias("avg_entry"),
                         "realized", "realized_total")


def equity_curve(fills: DataFrame, bars: DataFrame, capital: float = 100_000.0, by: Sequence[str] = (),
                 ts: str = "ts", seq: str = "order_id", date: str = "date") -> DataFrame:
    """Cash, equity and gross notional at the end of every bar date.

    Fills are totalled per symbol and day first. Each symbol then contributes
    the change of its marked value on its own days only, and one running sum over
    dates gives the account, so no symbol-by-date grid is built. A symbol without
    a bar yet is marked at its last fill price.
    """
    keys = list(by)
    side = F.when(F.col("side") == "Buy", F.lit(1.0)).otherwise(F.lit(-1.0))
    days = fills.groupBy(*keys, "symbol", F.col(ts).cast("date").alias(date)).agg(
        F.sum(side * F.col("quantity")).alias("_dq"),
        (-F.sum(side * F.col("quantity") * F.col("price") + F.col("commission"))).alias("_dcash"),
        F.max_by("price", F.struct(ts, seq)).alias("_traded"),
    )
    marks = bars.select("symbol", F.col(date).cast("date").alias(date), "close")
    owned = days.select(*keys, "symbol").distinct()
    line = days.join(marks.join(owned, "symbol"), [*keys, "symbol", date], "full")
    held = running(line, [*keys, "symbol"], [date],
                   {"_qty": ("sum", "_dq"), "_close": ("last", "close"), "_fill": ("last", "_traded")})
    valued = held.withColumn("_mv", F.coalesce("_qty", F.lit(0.0)) * F.coalesce("_close", "_fill", F.lit(0.0)))

    def changes(df: DataFrame, w) -> DataFrame:
        past = F.coalesce(F.lag("_mv", 1).over(w), F.lit(0.0))
        return df.withColumn("_dmv", F.col("_mv") - past).withColumn("_dgross", F.abs("_mv") - F.abs(past))

    moved = with_neighbours(valued, [*keys, "symbol"], [date], 1, 0, changes)
    daily = moved.groupBy(*keys, date).agg(
        F.sum("_dmv").alias("_dmv"), F.sum("_dgross").alias("_dgross"),
        F.coalesce(F.sum("_dcash"), F.lit(0.0)).alias("_dcash"), F.max(F.col("close").isNotNull()).alias("_is_bar"),
    )
    rows = daily if keys else daily.withColumn("_all", F.lit(0))
    sums = running(rows, keys or ["_all"], [date],
                   {"_m": ("sum", "_dmv"), "gross_notional": ("sum", "_dgross"), "_c": ("sum", "_dcash")})
    cash = F.col("_c") + F.lit(capital)
    return sums.filter("_is_bar").select(*keys, date, cash.alias("cash"), (cash + F.col("_m")).alias("equity"),
                                         "gross_notional")


def buying_power(curve: DataFrame, rate: float = MARGIN_RATE) -> DataFrame:
    """Notional the account can still take on; a rate outside (0, 1] counts as 1."""
    usable = rate if 0 < rate <= 1 else 1.0
    return curve.withColumn("buying_power", F.col("equity") / usable - F.col("gross_notional"))


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key stands in when results are for the whole table."""
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def daily_returns(curve: DataFrame, by: Sequence[str] = (), ts: str = "date", equity: str = "equity") -> DataFrame:
    """Percent change of the last equity of each day; days after a zero are skipped."""
    rows, keys = _keyed(curve, by)
    closes = rows.groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(F.max_by(equity, ts).alias("_eq"))

    def add(df: DataFrame, w) -> DataFrame:
        past = F.lag("_eq", 1).over(w)
        return df.withColumn("return_pct", ratio(F.col("_eq") - past, past) * 100)

    return with_neighbours(closes, keys, ["day"], 1, 0, add).filter("return_pct is not null") \
        .select(*by, "day", "return_pct")


def _return_stats(curve: DataFrame, by: Sequence[str], ts: str, equity: str, rf: float) -> DataFrame:
    """Sharpe, Sortino and volatility per key. ``rf`` is an annual rate in percent."""
    daily = rf / 252.0
    rows, keys = _keyed(daily_returns(curve, by, ts, equity), by)
    short = F.least(F.col("return_pct") - daily, F.lit(0.0))
    raw = rows.groupBy(*keys).agg(
        F.count("return_pct").alias("n"), F.avg("return_pct").alias("m"),
        F.var_samp("return_pct").alias("v"), F.sum(short * short).alias("q"))
    n, m = F.col("n"), F.col("m") - daily
    # The spread is taken around the rate-adjusted mean, hence the added term.
    sd = F.sqrt(F.col("v") + F.try_divide(n * (daily * daily), n - 1))
    down = F.sqrt(F.try_divide(F.col("q"), n))
    year = F.sqrt(F.lit(252.0))
    zero = F.lit(0.0)
    return raw.select(
        *keys,
        F.when((n >= 2) & (sd >= 1e-10), m / sd * year).otherwise(zero).alias("sharpe_ratio"),
        F.when((n >= 2) & (down >= 1e-10), m / down * year).otherwise(zero).alias("sortino_ratio"),
        F.when(n >= 2, F.sqrt("v")).otherwise(zero).alias("daily_volatility_pct"),
    )


def sharpe_ratio(curve, rf: float = 0.0, by: Sequence[str] = (), ts: str = "date", equity: str = "equity") -> DataFrame:
    return _return_stats(curve, by, ts, equity, rf).select(*by, "sharpe_ratio")


def sortino_ratio(curve, rf: float = 0.0, by: Sequence[str] = (), ts: str = "date", equity: str = "equity") -> DataFrame:
    return _return_stats(curve, by, ts, equity, rf).select(*by, "sortino_ratio")


def daily_volatility_pct(curve, by: Sequence[str] = (), ts: str = "date", equity: str = "equity") -> DataFrame:
    return _return_stats(curve, by, ts, equity, 0.0).select(*by, "daily_volatility_pct")


def max_drawdown_pct(curve: DataFrame, by: Sequence[str] = (), ts: str = "date", equity: str = "equity") -> DataFrame:
    """Largest fall from a running peak, in percent of the peak."""
    rows, keys = _keyed(curve, by)
    peaked = running(rows, keys, [ts], {"_peak": ("max", equity)}, cell_for(curve, ts))
    fall = ratio(F.col("_peak") - F.col(equity), "_peak") * 100
    return peaked.groupBy(*keys).agg(F.coalesce(F.max(fall), F.lit(0.0)).alias("max_drawdown_pct")) \
        .select(*by, "max_drawdown_pct")


def _trade_stats(pnls: DataFrame, by: Sequence[str]) -> DataFrame:
    rows, keys = _keyed(pnls, by)
    p = F.col("pnl")
    raw = rows.groupBy(*keys).agg(
        F.count(p).alias("total_trades"), F.count(F.when(p > 0, 1)).alias("winning_trades"),
        F.count(F.when(p < 0, 1)).alias("losing_trades"), F.avg(p).alias("avg_trade_pnl"),
        F.coalesce(F.sum(F.when(p >= 0, p)), F.lit(0.0)).alias("_won"),
        F.coalesce(F.sum(F.when(p < 0, -p)), F.lit(0.0)).alias("_lost"),
    )
    factor = F.when(F.col("_lost") < 1e-10, F.when(F.col("_won") > 0, 999.0).otherwise(0.0)) \
        .otherwise(ratio("_won", "_lost"))
    zero = F.lit(0.0)
    return raw.select(
        *keys, "total_trades", "winning_trades", "losing_trades",
        F.coalesce("avg_trade_pnl", zero).alias("avg_trade_pnl"),
        F.coalesce(ratio("winning_trades", "total_trades") * 100, zero).alias("win_rate_pct"),
        factor.alias("profit_factor"))


def trade_stats(fills: DataFrame, by: Sequence[str] = (), ts: str = "ts", seq: str = "order_id") -> DataFrame:
    """Win rate, profit factor, trade counts and average P&L of closed trades."""
    return _trade_stats(realized_pnl(fills, [*by, "symbol"], ts, seq), by).select(
        *by, "total_trades", "winning_trades", "losing_trades", "avg_trade_pnl", "win_rate_pct", "profit_factor")


def win_rate(fills: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return trade_stats(fills, by).select(*by, "win_rate_pct")


def profit_factor(fills: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return trade_stats(fills, by).select(*by, "profit_factor")


def annualized_return_pct(total_pct, start, end) -> Column:
    """Compound yearly rate with 365-day years; 0 for an empty span."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    micros = F.unix_micros(as_col(end).cast("timestamp")) - F.unix_micros(as_col(start).cast("timestamp"))
    years = micros / (365.0 * 86_400e6)
    growth = 1 + as_col(total_pct) / 100
    return F.when(years >= 1e-10, (F.pow(growth, F.try_divide(F.lit(1.0), years)) - 1) * 100).otherwise(0.0)


def calmar_ratio(annual_pct, drawdown_pct) -> Column:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.when(as_col(drawdown_pct) >= 1e-10, as_col(annual_pct) / as_col(drawdown_pct)).otherwise(0.0)


def performance_summary(curve: DataFrame, fills: DataFrame, capital: float = 100_000.0, by: Sequence[str] = (),
                        start=None, end=None, ts: str = "date", equity: str = "equity",
                        fill_ts: str = "ts") -> DataFrame:
    """The thirteen performance measures, one row per key."""
    rows, keys = _keyed(curve, by)
    first = F.lit(start).cast("timestamp") if start is not None else F.min(ts)
    last = F.lit(end).cast("timestamp") if end is not None else F.max(ts)
    ends = rows.groupBy(*keys).agg(F.max_by(equity, ts).alias("_end"), first.alias("_t0"), last.alias("_t1"))
    total = F.when(F.lit(capital) > 0, (F.col("_end") - capital) / capital * 100).otherwise(0.0)
    fall, _ = _keyed(max_drawdown_pct(curve, by, ts, equity), by)
    trades = _trade_stats(realized_pnl(fills, [*by, "symbol"], fill_ts), by)
    joined = (
        ends.withColumn("total_return_pct", total)
        .withColumn("annualized_return_pct", annualized_return_pct("total_return_pct", "_t0", "_t1"))
        .join(_return_stats(curve, by, ts, equity, 0.0), keys, "left")
        .join(fall, keys, "left").join(trades, keys, "left")
        .withColumn("calmar_ratio", calmar_ratio("annualized_return_pct", "max_drawdown_pct"))
    )
    counts = ("total_trades", "winning_trades", "losing_trades")
    measures = ("total_return_pct", "annualized_return_pct", "sharpe_ratio", "sortino_ratio", "max_drawdown_pct",
                "win_rate_pct", "profit_factor", "avg_trade_pnl", *counts, "calmar_ratio", "daily_volatility_pct")
    return joined.select(*by, *[F.coalesce(F.col(m), F.lit(0 if m in counts else 0.0)).alias(m) for m in measures])
