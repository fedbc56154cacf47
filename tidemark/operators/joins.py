"""Benchmark attach, as-of joins and event alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.columns import ratio
from tidemark.operators.ordered import cell_for, join_safe, positions, running
from tidemark.schemas import require_columns


def with_benchmark(bars: DataFrame, benchmark: str, drop: bool = False, date: str = "date") -> DataFrame:
    """Attach one symbol's close by date as ``benchmark_close``."""
    base = bars.filter(F.col("symbol") == benchmark).groupBy(date).agg(F.max("close").alias("benchmark_close"))
    if isinstance(bars.schema[date].dataType, T.DateType):
        base = F.broadcast(base)  # one row per date: 36 525 to a century
    rows = bars.filter(F.col("symbol") != benchmark) if drop else bars
    return rows.join(base, date, "left").select(*bars.columns, "benchmark_close")


def _day_seen(ts: str) -> Column:
    """First DATE on which a timestamp is already known at midnight."""
    day = F.to_date(F.col(ts))
    return F.when(F.col(ts) == day.cast("timestamp"), day).otherwise(F.date_add(day, 1))


def _align_time(left: DataFrame, right: DataFrame, lt: str, rt: str) -> tuple[DataFrame, DataFrame]:
    """Bring both time columns to one type without moving a visibility border."""
    l_date = isinstance(left.schema[lt].dataType, T.DateType)
    r_date = isinstance(right.schema[rt].dataType, T.DateType)
    if l_date and not r_date:
        right = right.withColumn("_seen", F.col(rt)).withColumn(rt, _day_seen(rt))
    elif r_date and not l_date:
        right = right.withColumn(rt, F.col(rt).cast("timestamp"))
    return left, right


def asof_values(left: DataFrame, right: DataFrame, values: Sequence[str], by: str = "symbol",
                left_ts: str = "date", right_ts: str = "ts_available", unique_left: bool = False) -> DataFrame:
    """Attach to each left row the right row's values known at its time.

    Backward as-of per column: the last non-null value with right time <= left
    time. Right rows should be unique per (key, time). Unless the left side is
    declared unique per (key, time) its distinct times are resolved first and
    joined back, so many left rows at one time never meet in a window.
    """
    left, right = _align_time(left, right, left_ts, right_ts)
    cell = cell_for(left, left_ts)
    out_cols = [*left.columns, *values]
    points = left if unique_left else left.select(by, left_ts).distinct()
    if cell is None and "_seen" in right.columns:
        # Several timestamps may become visible on one day: the latest counts.
        right = right.groupBy(by, right_ts).agg(*[
            F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_seen"))).alias(v) for v in values])
    line = points.withColumn("_bar", F.lit(1)).unionByName(
        right.select(by, F.col(right_ts).alias(left_ts), *[F.col(v).alias(f"_v_{v}") for v in values],
                     F.lit(0).alias("_bar")),
        allowMissingColumns=True)
    carried = running(line, [by], [left_ts, "_bar"], {v: ("last", f"_v_{v}") for v in values}, cell)
    resolved = carried.filter("_bar = 1")
    if unique_left:
        return resolved.select(*out_cols)
    return left.join(resolved.select(by, left_ts, *values), [by, left_ts], "left").select(*out_cols)


def feature_columns(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long feature rows to one row per (symbol, ts_available), one column per name."""
    require_columns(features, ["symbol", "ts_available", "feature_name", "feature_value"], "features")
    tie = [c for c in ("asof_date", "source_event_id", "feature_value") if c in features.columns]
    stamp = F.struct(*tie)

    def pick(name: str) -> Column:
        mine = (F.col("feature_name") == name) & F.col("feature_value").isNotNull()
        return F.max_by("feature_value", F.when(mine, stamp)).alias(name)

    return (
        features.filter(F.col("feature_name").isin(list(names)))
        .groupBy("symbol", "ts_available").agg(*[pick(n) for n in names])
    )


def asof_join(bars: DataFrame, features: DataFrame, names: Sequence[str], ts: str = "date") -> DataFrame:
    """Point-in-time panel: bars plus one column per feature name.

    All features ride through one shuffle on the symbol. A feature stamped at
    exactly the bar's time is visible to it; earlier values carry forward.
    """
    require_columns(bars, ["symbol", ts], "bars")
    if not names:
        return bars
    return asof_values(bars, feature_columns(features, names), names, "symbol", ts, "ts_available", True)


def coverage(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Populated share of each feature column, in percent with one decimal."""
    present = [n for n in names if n in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(n).alias(f"_k_{n}") for n in present])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_k_{n}").alias("populated")) for n in present])
    rows = counts.select("total", F.inline(pairs))
    pct = F.round(F.coalesce(ratio("populated", "total") * 100, F.lit(0.0)), 1)
    return rows.select("feature", "populated", "total", pct.alias("coverage_pct"))


def semi_join_dates(df: DataFrame, dates: DataFrame, date: str = "date") -> DataFrame:
    """Rows whose date appears in ``dates``."""
    return df.join(dates.select(date).distinct(), date, "left_semi")


def bar_index(bars: DataFrame, by: str = "symbol", date: str = "date") -> DataFrame:
    """Bars with their 0-based position ``bar_idx`` in the symbol's history."""
    return positions(bars, [by], [date], cell_for(bars, date), "bar_idx")


def event_days(indexed: DataFrame, events: DataFrame, by: str = "symbol", event_date: str = "event_date",
               date: str = "date", max_gap_days: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(symbol, event_date) -> ``t0``, the position of the first bar on or after it.

    Only distinct event dates are resolved; ``carry`` names bar columns to bring
    along. Dates before a symbol's first bar or after its last are left out.
    """
    days = events.select(by, F.col(event_date).alias("_event")).distinct()
    on_days = isinstance(indexed.schema[date].dataType, T.DateType)
    kind = T.DateType() if on_days else T.TimestampType()
    if on_days and not isinstance(events.schema[event_date].dataType, T.DateType):
        at = _day_seen("_event")
    else:
        at = F.col("_event").cast(kind)
    points = days.select(by, at.alias("_t"), F.lit(0).alias("_bar"), "_event")
    bar = F.struct(F.col("bar_idx").alias("t0"), F.col(date).alias("t0_date"), *carry)
    marks = indexed.select(by, F.col(date).cast(kind).alias("_t"), F.lit(1).alias("_bar"), bar.alias("_next"))
    if on_days:
        # Calendar-bounded: the next bar is the first one on the rows that follow.
        ahead = Window.partitionBy(by).orderBy("_t", "_bar").rowsBetween(0, Window.unboundedFollowing)
        line = marks.unionByName(points, allowMissingColumns=True)
        found = line.withColumn("_next", F.first("_next", ignorenulls=True).over(ahead)).filter("_bar = 0")
    else:
        # Bars strictly before the event number the next one.
        line = marks.drop("_next").unionByName(points, allowMissingColumns=True)
        line = line.withColumn("_one", F.when(F.col("_bar") == 1, 1))
        seen = running(line, [by], ["_t", "_bar"], {"_k": ("count", "_one")}, cell_for(line, "_t")).filter("_bar = 0")
        bars = marks.select(by, F.col("_next.t0").alias("_k"), "_next")
        found = seen.select(by, "_event", "_t", "_k").join(bars, [by, "_k"])
    rows = found.filter("_next is not null").select(by, F.col("_event").alias(event_date), "_t", "_next.*")
    # Day zero at the very first bar is valid only when the event falls on it.
    rows = rows.filter((F.col("t0") > 0) | (F.col("_t") == F.col("t0_date").cast(kind))).drop("_t")
    if max_gap_days is not None:
        rows = rows.filter(F.datediff("t0_date", event_date) <= max_gap_days)
    return rows


def event_outcomes(bars: DataFrame, events: DataFrame, by: str = "symbol", event_date: str = "event_date", date: str = "date",
                   max_gap_days: int | None = None) -> DataFrame:
    """``events`` with ``t0`` and what became of each: ``outcome``.

    ``aligned``, ``before_first_bar``, ``after_last_bar``, ``gap`` (the next bar lies more than ``max_gap_days`` ahead) or
    ``no_bars`` (the symbol has none, or symbol or date are NULL). Every event has one row; t0 is NULL unless aligned. Event studies
    use the aligned ones.
    """
    indexed = bar_index(bars, by, date)
    placed = event_days(indexed, events, by, event_date, date).select(by, event_date, F.col("t0").alias("_t0"), "t0_date")
    last = bars.groupBy(by).agg(F.max(F.col(date).cast("timestamp")).alias("_last"))
    rows = join_safe(join_safe(events, placed, [by, event_date]), last, [by])
    far = F.lit(False) if max_gap_days is None else F.datediff("t0_date", event_date) > max_gap_days
    outcome = (F.when(F.col("_last").isNull() | F.col(by).isNull() | F.col(event_date).isNull(), "no_bars").when(F.col("_t0").isNotNull(), F.when(far, "gap").otherwise("aligned"))
               .when(F.col(event_date).cast("timestamp") > F.col("_last"), "after_last_bar").otherwise("before_first_bar"))
    return rows.withColumn("outcome", outcome).withColumn("t0", F.when(F.col("outcome") == "aligned", F.col("_t0"))).select(*events.columns, "t0", "outcome")


def align_events(bars: DataFrame, events: DataFrame, pre: int, post: int, by: str = "symbol",
                 event_date: str = "event_date", max_gap_days: int | None = None) -> DataFrame:
    """Event rows times relative days -pre..post with the bar position of each."""
    indexed = bar_index(bars, by)
    aligned = events.join(event_days(indexed, events, by, event_date, max_gap_days=max_gap_days), [by, event_date])
    last = indexed.groupBy(by).agg(F.max("bar_idx").alias("_last"))
    offsets = F.sequence(F.greatest(F.lit(-pre), -F.col("t0")),
                         F.least(F.lit(post), F.col("_last") - F.col("t0")))
    return aligned.join(last, by).withColumn("rel_day", F.explode(offsets)).drop("_last") \
        .withColumn("rel_day", F.col("rel_day").cast("int")).withColumn("bar_idx", F.col("t0") + F.col("rel_day"))
