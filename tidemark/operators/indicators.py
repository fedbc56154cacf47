"""Technical indicators and the two signal strategies over bar tables.

Every indicator is a window or a :func:`decay_scan`, so a long history is cut
into blocks and no indicator runs row by row in Python.

A bar whose price is NULL, NaN or infinite is a gap to the recurrences (EMA,
RSI, MACD, ATR, hysteresis): the indicator is NULL on it and goes on behind it as
if the bar were not there, so weights follow the bars that have a price. Frames
over rows (SMA, Bollinger) are NULL while they hold a NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import ratio
from tidemark.operators.ordered import cell_for, decay_scan, positions, running, with_neighbours


def _indexed(bars: DataFrame, by: str, date: str) -> DataFrame:
    return positions(bars, [by], [date], cell_for(bars, date))


def present(*columns: str) -> Column:
    """Whether all of ``columns`` hold finite numbers."""
    numbers = [F.col(c).cast("double") for c in columns]
    return reduce(and_, [F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)) for x in numbers])


def _over_gaps(bars: DataFrame, columns: Sequence[str], scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``scan`` over the bars that have all of ``columns``; the others keep their rows, with NULL in what it adds."""
    done = scan(bars.filter(present(*columns)))
    added = [F.lit(None).cast(done.schema[c].dataType).alias(c) for c in done.columns if c not in bars.columns]
    return done.unionByName(bars.filter(~present(*columns)).select("*", *added))


def _ema_step(x: Column, period: int, first: int = 0) -> tuple[Column, float]:
    """Recurrence of an EMA that is seeded by its value at position ``first``."""
    alpha = 2.0 / (period + 1)
    step = F.when(F.col("_pos") < first, F.lit(0.0)).when(F.col("_pos") == first, x).otherwise(x * alpha)
    return step, 1.0 - alpha


def sma(bars: DataFrame, n: int, warmup: str = "null", column: str = "close", by: str = "symbol",
        date: str = "date", out: str | None = None) -> DataFrame:
    """Simple moving average; ``warmup`` is ``null`` or ``zero``."""
    early = {"null": F.lit(None).cast("double"), "zero": F.lit(0.0)}[warmup]

    def add(df: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-(n - 1), 0)
        return df.withColumn(out or f"sma_{n}", F.when(F.count(column).over(frame) == n, F.avg(column).over(frame))
                             .otherwise(early))

    return with_neighbours(bars, [by], [date], n - 1, 0, add, cell_for(bars, date))


def ema(bars: DataFrame, n: int, column: str = "close", by: str = "symbol", date: str = "date",
        out: str | None = None) -> DataFrame:
    """Exponential moving average seeded with the first value."""
    def scan(rows: DataFrame) -> DataFrame:
        return decay_scan(_indexed(rows, by, date), [by], {out or f"ema_{n}": _ema_step(F.col(column), n)}).drop("_pos")

    return _over_gaps(bars, [column], scan)


def rsi(bars: DataFrame, n: int = 14, column: str = "close", by: str = "symbol", date: str = "date",
        out: str | None = None) -> DataFrame:
    """Wilder's relative strength index; 0 on the first bar, 50 until seeded."""
    name = out or f"rsi_{n}"

    def changes(df: DataFrame, w) -> DataFrame:
        move = F.col(column) - F.lag(column, 1).over(w)
        return df.withColumn("_up", F.greatest(move, F.lit(0.0))).withColumn("_down", F.greatest(-move, F.lit(0.0)))

    def seeds(df: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-(n - 1), 0)
        return df.withColumn("_up0", F.avg("_up").over(frame)).withColumn("_down0", F.avg("_down").over(frame))

    def step(x: str) -> tuple[Column, float]:
        b = (F.when(F.col("_pos") < n, F.lit(0.0)).when(F.col("_pos") == n, F.col(f"{x}0"))
             .otherwise(F.col(x) / n))
        return b, (n - 1) / n

    def scan(priced: DataFrame) -> DataFrame:
        rows = _indexed(priced, by, date)
        cell = cell_for(bars, date)
        rows = with_neighbours(rows, [by], [date], 1, 0, changes, cell) if cell is None else _two(rows, by, 1, changes)
        rows = with_neighbours(rows, [by], [date], n, 0, seeds, cell) if cell is None else _two(rows, by, n, seeds)
        scanned = decay_scan(rows, [by], {"_gain": step("_up"), "_loss": step("_down")})
        # A flat stretch scales gain and loss alike, so the index keeps its last value.
        raw = (F.when((F.col("_gain") == 0) & (F.col("_loss") == 0), F.lit(None).cast("double"))
               .when(F.col("_loss") == 0, F.lit(100.0))
               .otherwise(100.0 - 100.0 / (1.0 + ratio("_gain", "_loss"))))
        carried = running(scanned.withColumn("_raw", raw), [by], [date], {"_last": ("last", "_raw")}, cell)
        value = F.when(F.col("_pos") == 0, F.lit(0.0)).otherwise(F.coalesce("_last", F.lit(50.0)))
        return carried.select(*priced.columns, value.alias(name))

    return _over_gaps(bars, [column], scan)


def _two(rows: DataFrame, by: str, before: int, add) -> DataFrame:
    """Bounded frame over rows that already carry positions."""
    from tidemark.operators.ordered import in_blocks
    return in_blocks(rows, [by], before, 0, max(8192, 8 * before), add)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, column: str = "close", by: str = "symbol",
              date: str = "date") -> DataFrame:
    """Middle, upper and lower band and their width, with the population deviation."""
    def add(df: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-(n - 1), 0)
        full = F.count(column).over(frame) == n
        return df.withColumn("bb_middle", F.when(full, F.avg(column).over(frame))) \
                 .withColumn("_dev", F.when(full, F.stddev_pop(column).over(frame) * k))

    banded = with_neighbours(bars, [by], [date], n - 1, 0, add, cell_for(bars, date))
    return banded.select(
        *bars.columns, "bb_middle", (F.col("bb_middle") + F.col("_dev")).alias("bb_upper"),
        (F.col("bb_middle") - F.col("_dev")).alias("bb_lower"), (F.col("_dev") * 2.0).alias("bb_width"))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close",
         by: str = "symbol", date: str = "date") -> DataFrame:
    """Difference of two EMAs, its own EMA, and the gap between them."""
    def scan(rows: DataFrame) -> DataFrame:
        x = F.col(column)
        lines = decay_scan(_indexed(rows, by, date), [by], {"_fast": _ema_step(x, fast), "_slow": _ema_step(x, slow)})
        lines = lines.withColumn("macd_line", F.col("_fast") - F.col("_slow"))
        done = decay_scan(lines, [by], {"macd_signal": _ema_step(F.col("macd_line"), signal)})
        return done.select(*rows.columns, "macd_line", "macd_signal",
                           (F.col("macd_line") - F.col("macd_signal")).alias("macd_histogram"))

    return _over_gaps(bars, [column], scan)


def atr(bars: DataFrame, n: int = 14, by: str = "symbol", date: str = "date", out: str | None = None) -> DataFrame:
    """Average true range: an EMA of the true range from the second bar on."""
    name = out or f"atr_{n}"

    def add(df: DataFrame, w) -> DataFrame:
        prev = F.lag("close", 1).over(w)
        span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
        return df.withColumn("_tr", span)

    def scan(whole: DataFrame) -> DataFrame:
        rows = _indexed(with_neighbours(whole, [by], [date], 1, 0, add, cell_for(bars, date)), by, date)
        scanned = decay_scan(rows, [by], {"_atr": _ema_step(F.col("_tr"), n, first=1)})
        return scanned.select(*whole.columns, F.when(F.col("_pos") > 0, F.col("_atr")).alias(name))

    return _over_gaps(bars, ["high", "low", "close"], scan)


def hysteresis_signals(bars: DataFrame, lookback_days: int = 63, ema_period: int = 5,
                       upper_threshold: float = 0.02, lower_threshold: float = -0.02,
                       consecutive_bars: int = 2, by: str = "symbol", date: str = "date") -> DataFrame:
    """Momentum smoothed by an EMA, acted on after N consecutive bars outside a band.

    The state machine is two facts per row: how long the EMA has stayed beyond a
    threshold (distance to the last row that was not), and which side triggered
    last (the last non-null trigger). Both are running aggregates. The lookback
    counts bars that have a close; the others give no signal.
    """
    def lagged(df: DataFrame, w) -> DataFrame:
        return df.withColumn("_past", F.lag("close", lookback_days).over(w))

    rows = with_neighbours(bars.filter(present("close")).select(by, date, "close"), [by], [date], lookback_days, 0, lagged,
                           cell_for(bars, date))
    rows = rows.filter(F.col("_past") > 0).withColumn("momentum", F.col("close") / F.col("_past") - 1)
    cell = cell_for(rows, date)
    smooth = decay_scan(positions(rows, [by], [date], cell), [by],
                        {"ema": _ema_step(F.col("momentum"), ema_period)})
    above, below = F.col("ema") > upper_threshold, F.col("ema") < lower_threshold
    marked = (smooth.withColumn("_not_above", F.when(~above, F.col("_pos")))
              .withColumn("_not_below", F.when(~below, F.col("_pos"))))
    counted = running(marked, [by], [date], {"_a": ("max", "_not_above"), "_b": ("max", "_not_below")}, cell)
    counted = (counted.withColumn("bars_above", F.col("_pos") - F.coalesce("_a", F.lit(-1)))
               .withColumn("bars_below", F.col("_pos") - F.coalesce("_b", F.lit(-1))))
    buys, sells = F.col("bars_above") >= consecutive_bars, F.col("bars_below") >= consecutive_bars
    fired = counted.withColumn("_fired", F.when(buys, F.lit(1)).when(sells, F.lit(0)))
    held = running(fired, [by], [date], {"_held": ("last", "_fired")}, cell)

    def before(df: DataFrame, w) -> DataFrame:
        return df.withColumn("_was", F.coalesce(F.lag("_held", 1).over(w), F.lit(0)))

    state = with_neighbours(held, [by], [date], 1, 0, before, cell) if cell is None else _two(held, by, 1, before)
    enters, exits = buys & (F.col("_was") == 0), sells & (F.col("_was") == 1)
    return state.select(
        by, date, "momentum", "ema", "bars_above", "bars_below",
        F.when(enters, "enter").when(exits, "exit").alias("action"),
        F.when(enters, F.least(F.lit(1.0), F.col("ema") / (upper_threshold * 2)))
        .when(exits, F.least(F.lit(1.0), F.abs("ema") / (abs(lower_threshold) * 2))).alias("confidence"),
    )


def buy_and_hold_signals(bars: DataFrame, capital: float = 100_000.0, by: str = "symbol",
                         date: str = "date") -> DataFrame:
    """One entry per symbol on its first bar, sized by an equal share of the capital."""
    firsts = bars.groupBy(by).agg(F.min(date).alias(date), F.min_by("close", date).alias("close"))
    universe = bars.agg(F.countDistinct(by).alias("_k")).withColumn("_all", F.lit(0))
    sized = firsts.withColumn("_all", F.lit(0)).join(universe, "_all")
    weight = F.least(F.lit(1.0), ratio(F.lit(capital) / F.col("_k"), F.col("close") * 100.0))
    return sized.select(by, date, weight.alias("target_weight"), F.lit(1.0).alias("confidence"))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "momentum_ema_hysteresis": hysteresis_signals,
    "buy_and_hold": buy_and_hold_signals,
}


def register_strategy(name: str, strategy: Callable[..., DataFrame]) -> None:
    """Add a ``(bars, **params) -> signals`` function to the registry."""
    STRATEGIES[name] = strategy


def build_strategy(name: str) -> Callable[..., DataFrame]:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[name]
