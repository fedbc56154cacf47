"""Forward labels, trailing windows, period sampling and quantile buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.columns import clip, micros, ratio
from tidemark.operators.ordered import cell_for, join_safe, positions, running, running_moments, with_neighbours
from tidemark.operators.ranking import ordinal_rank
from tidemark.schemas import require_columns

DEFAULT_HORIZONS = (5, 10, 20, 40, 60, 120)


def forward_returns(bars: DataFrame, horizons: Sequence[int] = DEFAULT_HORIZONS, by: str = "symbol",
                    date: str = "date", close: str = "close", benchmark: str = "benchmark_close",
                    available: bool = False) -> DataFrame:
    """Percent return over the next h rows of a symbol; NULL at the tail.

    With a benchmark column the excess return over the same rows is added, and
    ``available`` adds the date on which each label becomes known.
    """
    require_columns(bars, [by, date, close], "bars")
    excess = benchmark in bars.columns

    def add(df: DataFrame, w) -> DataFrame:
        cols: list[Column] = []
        for h in horizons:
            own = ratio(F.lead(close, h).over(w) - F.col(close), close) * 100.0
            cols.append(own.alias(f"forward_{h}d_return"))
            if excess:
                base = ratio(F.lead(benchmark, h).over(w) - F.col(benchmark), benchmark) * 100.0
                cols.append((own - base).alias(f"forward_{h}d_excess"))
            if available:
                cols.append(F.lead(date, h).over(w).alias(f"forward_{h}d_available"))
        return df.select("*", *cols)

    return with_neighbours(bars, [by], [date], 0, max(horizons), add, cell_for(bars, date))


def momentum(bars: DataFrame, n: int = 63, by: str = "symbol", date: str = "date", close: str = "close",
             out: str | None = None) -> DataFrame:
    """Percent change of the close against the close n rows earlier."""
    name = out or f"price_momentum_{n}d"

    def add(df: DataFrame, w) -> DataFrame:
        return df.withColumn(name, (ratio(close, F.lag(close, n).over(w)) - 1) * 100)

    return with_neighbours(bars, [by], [date], n, 0, add, cell_for(bars, date))


def pct_change(df: DataFrame, column: str, k: int = 1, by: str = "symbol", order: str = "date",
               out: str | None = None) -> DataFrame:
    """Fractional change against the row k earlier."""
    def add(d: DataFrame, w) -> DataFrame:
        return d.withColumn(out or f"{column}_pct_change", ratio(column, F.lag(column, k).over(w)) - 1)

    return with_neighbours(df, [by], [order], k, 0, add, cell_for(df, order))


def difference(df: DataFrame, column: str, k: int = 1, by: str = "symbol", order: str = "date",
               out: str | None = None) -> DataFrame:
    """Difference to the row k earlier."""
    def add(d: DataFrame, w) -> DataFrame:
        return d.withColumn(out or f"{column}_diff", F.col(column) - F.lag(column, k).over(w))

    return with_neighbours(df, [by], [order], k, 0, add, cell_for(df, order))


def rolling_rows(df: DataFrame, column: str, n: int, agg: str = "mean", by: str = "symbol",
                 order: str = "date", out: str | None = None) -> DataFrame:
    """Sum or mean over the last n rows, with as few as one row available."""
    fn = {"sum": F.sum, "mean": F.avg}[agg]

    def add(d: DataFrame, w) -> DataFrame:
        return d.withColumn(out or f"{column}_{agg}_{n}", fn(column).over(w.rowsBetween(-(n - 1), 0)))

    return with_neighbours(df, [by], [order], n - 1, 0, add, cell_for(df, order))


def rolling_days(df: DataFrame, column: str, days: int, agg: str = "sum", by: str = "symbol",
                 date: str = "date", out: str | None = None) -> DataFrame:
    """Sum or mean over the left-open calendar window (t - days, t].

    Rows that share a date see the same window. On a DATE column whose rows
    repeat per day, the days are totalled first, so a busy day is never sorted.
    """
    name = out or f"{column}_{agg}_{days}d"
    if not isinstance(df.schema[date].dataType, T.DateType):
        return _rolling_span(df, column, days * 86_400_000_000, agg, by, date, name)
    w = Window.partitionBy(by).orderBy("_day").rangeBetween(-(days - 1), 0)
    daily = (
        df.groupBy(by, date).agg(F.sum(column).alias("_s"), F.count(column).alias("_k"))
        .withColumn("_day", F.unix_date(date))
    )
    total, count = F.sum("_s").over(w), F.sum("_k").over(w)
    windowed = daily.select(by, date, (total if agg == "sum" else ratio(total, count)).alias(name))
    # A row without a date lies in no window.
    return join_safe(df, windowed.filter(F.col(date).isNotNull()), [by, date]).select(*df.columns, name)


def rolling_daily(df: DataFrame, column: str, spans: dict[str, int], by: str = "symbol",
                  date: str = "date") -> DataFrame:
    """Several left-open calendar sums over a table with one row per key and DATE.

    One shuffle serves every span; ``spans`` maps output names to days.
    """
    day = df.withColumn("_day", F.unix_date(date))
    w = Window.partitionBy(by).orderBy("_day")
    return day.select(*df.columns, *[F.sum(column).over(w.rangeBetween(-(d - 1), 0)).alias(n)
                                     for n, d in spans.items()])


# A span is cut into so many cells; it divides a day's microseconds.
SPAN_CELLS = 512


def _rolling_span(df: DataFrame, column: str, span: int, agg: str, by: str, ts: str, out: str) -> DataFrame:
    """Timestamp version: what the span covers of its first cell, the whole cells between, and of the row's own cell.

    Nothing is subtracted, so neither huge nor infinite values outside a row's span touch its result. A row is placed twice
    in the cells of its key: at its own time, and a span later, where it drops out of the windows of the rows met there.
    """
    size = span // SPAN_CELLS
    at, cell = micros(ts), F.floor(micros(ts) / F.lit(size)).cast("long")
    value = F.col(column).cast("double")
    own = df.select(F.col(by), at.alias("_t"), cell.alias("_cell"), value.alias("_x"), F.struct(*df.columns).alias("_row"))
    gone = df.filter(F.col(ts).isNotNull()).select(F.col(by), (at + span).alias("_t"), (cell + SPAN_CELLS).alias("_cell"), value.alias("_gone"))
    line = own.unionByName(gone, allowMissingColumns=True)
    here = Window.partitionBy(by, "_cell").orderBy("_t")
    upto, after = here.rangeBetween(Window.unboundedPreceding, 0), here.rangeBetween(1, Window.unboundedFollowing)
    ends = line.select(by, "_cell", "_row", F.sum("_x").over(upto).alias("_s1"), F.count("_x").over(upto).alias("_k1"),
                       F.sum("_gone").over(after).alias("_s2"), F.count("_gone").over(after).alias("_k2")).filter("_row is not null")
    between = Window.partitionBy(by).orderBy("_cell").rangeBetween(-(SPAN_CELLS - 1), -1)
    cells = (df.groupBy(F.col(by), cell.alias("_cell")).agg(F.sum(value).alias("_s"), F.count(column).alias("_k"))
             .select(by, "_cell", F.sum("_s").over(between).alias("_s3"), F.sum("_k").over(between).alias("_k3")))
    both = join_safe(ends, cells, [by, "_cell"])
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("_s1", "_s2", "_s3")]
    total, count = parts[0] + parts[1] + parts[2], F.col("_k1") + F.col("_k2") + F.coalesce("_k3", F.lit(0))
    result = F.when((count > 0) & F.col(f"_row.{ts}").isNotNull(), total if agg == "sum" else total / count)
    return both.select("_row.*", result.alias(out))


def trailing_zscore(df: DataFrame, value_col: str, by: str = "symbol", time_col: str = "ts_available",
                    min_periods: int = 8, out_col: str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Expanding z-score over each key's history up to and including the row.

    NULL below ``min_periods`` rows, when the history has no spread and once it
    holds an infinite value or a NaN. Later rows never change earlier ones. ``tie``
    completes the order when times repeat.
    """
    out = out_col or f"{value_col}_z"
    # With a tie-break rows may repeat per day, so a day is no longer a bound.
    cell = F.col(time_col) if tie else cell_for(df, time_col)
    stats = running_moments(df, [by], [time_col, *tie], value_col, cell).withColumn(
        "_sd", F.when(F.col("_k") > 1, F.sqrt(F.col("_m2") / (F.col("_k") - 1))))
    # A deviation within rounding error of the mean is no spread.
    spread = (F.col("_sd") > F.abs("_mean") * 1e-12) & (F.col("_sd") < float("inf"))
    z = F.when((F.col("_k") >= min_periods) & spread, (F.col(value_col) - F.col("_mean")) / F.col("_sd"))
    return stats.select(*df.columns, z.alias(out))


def distinct_periods(df: DataFrame, period: str = "date") -> DataFrame:
    """Distinct period values with their 0-based chronological index.

    Ordering the whole list is bounded by the calendar for dates; timestamps are
    indexed day by day.
    """
    uniq = df.select(period).where(F.col(period).isNotNull()).distinct().withColumn("_all", F.lit(0))
    return positions(uniq, ["_all"], [period], cell_for(uniq, period, "day"), out="period_index").drop("_all")


def sample_within(df: DataFrame, k: int | Column, by: Sequence[str], period: str = "date") -> DataFrame:
    """Rows of every k-th distinct period of each group; k may be one of its columns."""
    if isinstance(k, int) and k <= 1:
        return df
    uniq = df.select(*by, period).distinct()
    kept = positions(uniq, list(by), [period], cell_for(uniq, period, "day"), "_i").filter(F.col("_i") % k == 0)
    return df.join(kept.drop("_i"), [*by, period], "left_semi")


def sample_periods(df: DataFrame, k: int, period: str = "date") -> DataFrame:
    """Rows of every k-th distinct period, counted from the first."""
    if k <= 1:
        return df
    kept = distinct_periods(df, period).filter(F.col("period_index") % k == 0).select(period)
    if isinstance(df.schema[period].dataType, T.DateType):
        kept = F.broadcast(kept)  # calendar-bounded: 36 525 dates to a century
    return df.join(kept, period, "left_semi")


def min_names_filter(df: DataFrame, n: int, period: str = "date") -> DataFrame:
    """Rows of periods that hold at least n rows."""
    wide = df.groupBy(period).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= n).select(period)
    return df.join(wide, period, "left_semi")


def quantile_bucket(df: DataFrame, feature: str, q: int = 5, period: str = "date", tie: str = "symbol",
                    out: str = "quantile", min_names: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Bucket 1..q by ascending rank within the period's own row count.

    Periods with fewer than ``min_names`` rows are left out. ``by`` ranks several
    studies held in one table side by side.
    """
    ranked = ordinal_rank(df, [*by, period], feature, [tie]).filter(F.col("_n") >= min_names)
    bucket = F.floor((F.col("_rank") - 1) * q / F.col("_n")) + 1
    return ranked.select(*df.columns, clip(bucket, 1, q).cast("int").alias(out))


def cumulative_drawdown(df: DataFrame, column: str, order: str = "date", by: Sequence[str] = (),
                        cum_out: str = "cumulative", dd_out: str = "drawdown") -> DataFrame:
    """Running sum and its additive distance below the running maximum."""
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    cell = cell_for(rows, order)
    summed = running(rows, keys, [order], {cum_out: ("sum", column)}, cell)
    peaked = running(summed, keys, [order], {"_peak": ("max", cum_out)}, cell)
    return peaked.select(*df.columns, cum_out, (F.col(cum_out) - F.col("_peak")).alias(dd_out))


def xs_standardise(df: DataFrame, columns: Sequence[str], period: str = "date") -> DataFrame:
    """Z-score per period with the population deviation; NULL without spread."""
    stats = df.groupBy(period).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns],
    )
    z = [F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"{c}_z")
         for c in columns]
    return df.join(stats, period).select(*df.columns, *z)


def market_maker_activity(df: DataFrame, ticker: str = "ticker", date: str = "trade_date",
                          column: str = "market_makers") -> DataFrame:
    """Weeks in which the number of market makers fell by two or more."""
    def add(d: DataFrame, w) -> DataFrame:
        prev = F.lag(column, 1).over(w)
        return d.select("*", (F.col(column) - prev).alias("mm_change"), prev.alias("prev_mm"))

    moved = with_neighbours(df, [ticker], [date], 1, 0, add, cell_for(df, date))
    change = F.coalesce(ratio(F.col(column) - F.col("prev_mm"), "prev_mm"), F.lit(0.0))
    return moved.withColumn("mm_change_pct", change).filter((F.col("mm_change") < -1) & (F.col("prev_mm") > 2))
