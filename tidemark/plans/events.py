"""Event studies.

A cumulative abnormal return depends only on the symbol and its day zero, so
windows are summed once per bar and events look theirs up. The events table,
however large or lopsided, is joined once on (symbol, event_date) and is never
multiplied by the window length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import no_nan, ratio
from tidemark.operators.aggregates import clustered_t, cut_points, t_stat
from tidemark.operators.joins import align_events, asof_values, bar_index, event_days
from tidemark.operators.ordered import cell_for, running, with_neighbours
from tidemark.operators.ranking import exact_quantiles
from tidemark.operators.windows import rolling_days
from tidemark.schemas import require_columns
from tidemark.session import reused

Windows = Sequence[tuple[int, int]]


def default_windows(pre: int, post: int) -> list[tuple[int, int]]:
    return list(dict.fromkeys([(-pre, -1), (0, 0), (1, 5), (1, 20), (1, post)]))


def bar_abnormal_returns(bars: DataFrame, by: str = "symbol", date: str = "date") -> DataFrame:
    """Bars with ``ar``: return minus benchmark return over one row, in percent."""
    require_columns(bars, [by, date, "close", "benchmark_close"], "bars")

    def add(df: DataFrame, w) -> DataFrame:
        own = ratio("close", F.lag("close", 1).over(w)) - 1
        base = ratio("benchmark_close", F.lag("benchmark_close", 1).over(w)) - 1
        return df.withColumn("ar", (own - base) * 100)

    return with_neighbours(bars, [by], [date], 1, 0, add, cell_for(bars, date))


def abnormal_returns(bars: DataFrame, events: DataFrame, pre: int = 5, post: int = 60, by: str = "symbol",
                     event_date: str = "event_date", max_gap_days: int | None = None) -> DataFrame:
    """Long form: every event on every relative day inside the price history."""
    indexed = bar_index(bar_abnormal_returns(bars), by).select(by, "bar_idx", "ar")
    placed = align_events(bars, events, pre, post, by, event_date, max_gap_days)
    return placed.join(indexed, [by, "bar_idx"]).select(*events.columns, "rel_day", "ar")


def _window_cars(bars: DataFrame, windows: Windows, by: str, date: str) -> DataFrame:
    """Per bar taken as day zero, the CAR of each window; NULL unless complete."""
    def add(df: DataFrame, w) -> DataFrame:
        cols = []
        for a, b in windows:
            frame = w.rowsBetween(a, b)
            full = F.count("ar").over(frame) == b - a + 1
            cols.append(F.when(full, F.sum("ar").over(frame)).alias(car_name(a, b)))
        return df.select(by, date, "bar_idx", *cols)

    before = max(0, -min(a for a, _ in windows))
    after = max(0, max(b for _, b in windows))
    indexed = bar_index(bar_abnormal_returns(bars, by, date), by, date)
    return with_neighbours(indexed, [by], [date], before, after, add, cell_for(bars, date))


def car_name(a: int, b: int) -> str:
    return f"car_{a}_{b}".replace("-", "m")


def event_cars(bars: DataFrame, events: DataFrame, windows: Windows, by: str = "symbol",
               event_date: str = "event_date", date: str = "date", max_gap_days: int | None = None) -> DataFrame:
    """Events that fall into the price history with one CAR column per window."""
    windows = list(dict.fromkeys(windows))
    cars = _window_cars(bars, windows, by, date)
    names = [car_name(a, b) for a, b in windows]
    days = event_days(cars, events, by, event_date, date, max_gap_days, names)
    return events.join(days.select(by, event_date, *names), [by, event_date]).select(*events.columns, *names)


def caar(bars: DataFrame, events: DataFrame, pre: int = 5, post: int = 60, by: str = "symbol",
         event_date: str = "event_date", date: str = "date", group: Sequence[str] = (),
         max_gap_days: int | None = None) -> DataFrame:
    """Average abnormal return per relative day and its running sum.

    Events are counted per day zero before the window is laid out.
    """
    indexed = bar_index(bar_abnormal_returns(bars, by, date), by, date).select(by, date, "bar_idx", "ar")
    days = event_days(indexed, events, by, event_date, date, max_gap_days)
    counts = (
        events.groupBy(*group, by, event_date).agg(F.count(F.lit(1)).alias("_k")).join(days, [by, event_date])
        .groupBy(*group, by, "t0").agg(F.sum("_k").alias("_k"))
    )
    spread = counts.withColumn("rel_day", F.explode(F.sequence(F.lit(-pre), F.lit(post)))) \
        .withColumn("bar_idx", F.col("t0") + F.col("rel_day"))
    per_day = spread.join(indexed.filter("ar is not null"), [by, "bar_idx"]).groupBy(*group, "rel_day").agg(
        F.sum("_k").alias("n"), (F.sum(F.col("_k") * F.col("ar")) / F.sum("_k")).alias("aar"))
    keys = list(group) or ["_all"]
    rows = per_day if group else per_day.withColumn("_all", F.lit(0))
    # One row per relative day: the window length bounds this.
    total = running(rows, keys, ["rel_day"], {"caar": ("sum", "aar")})
    return total.select(*group, "rel_day", "n", "aar", "caar")


def car_stats(cars: DataFrame, windows: Windows, group: Sequence[str] = ()) -> DataFrame:
    """Count, mean, t-statistic and hit rate of each window's complete CARs."""
    windows = list(dict.fromkeys(windows))
    def part(a: int, b: int) -> list[Column]:
        c, tag = F.col(car_name(a, b)), car_name(a, b)
        return [F.count(c).alias(f"n_{tag}"), F.avg(c).alias(f"m_{tag}"), F.stddev_samp(c).alias(f"s_{tag}"),
                F.count(F.when(c > 0, 1)).alias(f"u_{tag}")]

    raw = cars.groupBy(*group).agg(*[x for a, b in windows for x in part(a, b)])
    zero = F.lit(0.0)
    table = F.array(*[F.struct(
        F.lit(f"[{a},{b}]").alias("window"), F.col(f"n_{t}").alias("n"),
        F.coalesce(f"m_{t}", zero).alias("mean_car_pct"),
        t_stat(F.col(f"m_{t}"), F.col(f"s_{t}"), F.col(f"n_{t}")).alias("t_stat"),
        F.coalesce(ratio(f"u_{t}", f"n_{t}") * 100, zero).alias("hit_rate_pct"),
    ) for a, b in windows for t in [car_name(a, b)]])
    return raw.select(*group, F.inline(table))


def size_buckets(cars: DataFrame, window: tuple[int, int], amount: str = "amount", least: int = 6) -> DataFrame:
    """Statistics by amount tercile; empty below ``least`` events with an amount."""
    finite = cars.select(no_nan(amount).alias(amount), car_name(*window)).filter(F.col(amount).isNotNull())
    rows = reused(finite.withColumn("_all", F.lit(0)))
    enough = rows.groupBy("_all").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= least).select("_all")
    cuts = cut_points(rows, amount, by=["_all"]).join(enough, "_all", "left_semi")  # one row
    bucket = F.when(F.col(amount) <= F.col("q1"), "small").when(F.col(amount) <= F.col("q2"), "mid") \
        .otherwise("large")
    tagged = rows.join(F.broadcast(cuts), "_all")
    return car_stats(tagged.withColumn("bucket", bucket), [window], ["bucket"])


def event_study(bars: DataFrame, events: DataFrame, pre: int = 5, post: int = 60,
                windows: Windows | None = None, max_gap_days: int | None = None) -> dict[str, DataFrame]:
    """Window statistics, average paths and size split of one event table."""
    wanted = list(windows or default_windows(pre, post))
    drift = (1, min(20, post))
    cars = event_cars(bars, events, list(dict.fromkeys([*wanted, drift])), max_gap_days=max_gap_days)
    tables = {
        "cars": cars, "windows": car_stats(cars, wanted),
        "caar": caar(bars, events, pre, post, max_gap_days=max_gap_days),
    }
    if "amount" in events.columns:
        tables["size_buckets"] = size_buckets(cars, drift)
    return tables


def large_events(awards: DataFrame, min_amount: float, cluster_days: int = 7, by: str = "symbol",
                 event_date: str = "event_date", amount: str = "amount", award: str = "award_id") -> DataFrame:
    """Large awards, thinned so that kept events of a symbol lie more than
    ``cluster_days`` apart.

    Only a day's largest award can be kept, so days are reduced on the map side;
    the thinning then walks at most one date per day and symbol.
    """
    big = awards.filter((F.col(amount) >= min_amount) & F.col(by).isNotNull() & F.col(event_date).isNotNull())
    best = big.groupBy(by, F.col(event_date).cast("date").alias(event_date)).agg(
        F.max(F.struct(F.col(amount).alias("a"), F.col(award).alias("w"))).alias("_top"))
    days = best.groupBy(by).agg(F.array_sort(F.collect_list(F.unix_date(event_date))).alias("_days"))
    kept = days.select(by, F.explode(_thinned("_days", cluster_days)).alias("_day")) \
        .select(by, F.date_from_unix_date("_day").alias(event_date))
    return best.join(kept, [by, event_date]).select(
        by, event_date, F.col("_top.a").alias(amount), F.col("_top.w").alias(award))


def _thinned(days: str, gap: int) -> Column:
    """The ascending numbers of an array of which each lies more than ``gap`` behind the one kept before it."""
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, day: Column) -> Column:
        on = F.struct(day.alias("last"), F.concat(acc["kept"], F.array(day)).alias("kept"))
        return F.when(acc["last"].isNull() | (day - acc["last"] > gap), on).otherwise(acc)

    return F.aggregate(days, start, step, lambda acc: acc["kept"])


def surprise_study(bars: DataFrame, events: DataFrame, pre: int = 5, post: int = 60,
                   windows: Windows | None = None, amount: str = "amount") -> dict[str, DataFrame]:
    """The event study for positive, negative and all surprises in one pass."""
    wanted = list(windows or default_windows(pre, post))
    groups = F.array_compact(F.array(
        F.lit("all"), F.when(F.col(amount) > 0, "positive").when(F.col(amount) < 0, "negative")))
    cars = event_cars(bars, events, wanted)
    stats = car_stats(cars.withColumn("group", F.explode(groups)), wanted, ["group"])
    pick = lambda g: F.coalesce(F.max(F.when(F.col("group") == g, F.col("mean_car_pct"))), F.lit(0.0))
    spread = stats.groupBy("window").agg(pick("positive").alias("positive_car"), pick("negative").alias("negative_car")) \
        .withColumn("spread", F.col("positive_car") - F.col("negative_car"))
    paths = caar(bars, events.withColumn("group", F.explode(groups)), pre, post, group=["group"])
    return {"cars": cars, "windows": stats, "spread": spread, "caar": paths}


def dollar_volume(bars: DataFrame, days: int = 63, by: str = "symbol", date: str = "date") -> DataFrame:
    """Trailing calendar mean of close times volume."""
    return rolling_days(bars.withColumn("_dv", F.col("close") * F.col("volume")), "_dv", days, "mean", by, date,
                        "dollar_vol")


def reversal_study(bars: DataFrame, events: DataFrame, windows: Windows = ((1, 20), (1, 60)), days: int = 63,
                   amount: str = "amount", event_date: str = "event_date") -> DataFrame:
    """Clustered t-statistics of betting against the surprise.

    One long table: the window's CAR by sign, the long/short P&L over all events,
    by liquidity tercile and before/after the median event date.
    """
    cars = event_cars(bars, events, windows)
    volume = dollar_volume(bars, days).select("symbol", "date", "dollar_vol")
    cars = asof_values(cars, volume, ["dollar_vol"], "symbol", event_date, "date")
    names = [car_name(a, b) for a, b in windows]
    # The cut points read the table twice each and are then applied to it.
    cars = reused(cars.select(event_date, amount, "dollar_vol", *names, F.unix_date(
        F.col(event_date).cast("date")).cast("double").alias("_day")))
    cuts = exact_quantiles(cars, [], "dollar_vol", {"_q1": 1 / 3, "_q2": 2 / 3}, "nearest")
    middle = exact_quantiles(cars, [], "_day", {"_mid": 0.5})
    # Two one-row tables of cut points.
    one = lambda d: F.broadcast(d.withColumn("_all", F.lit(0)))
    tagged = cars.withColumn("_all", F.lit(0)).join(one(cuts), "_all", "left").join(one(middle), "_all", "left")
    dv = F.col("dollar_vol")
    liquidity = (F.when(dv <= F.col("_q1"), "low_liquidity").when(dv <= F.col("_q2"), "mid_liquidity")
                 .when(dv.isNotNull(), "high_liquidity"))
    half = F.when(F.col("_day") < F.col("_mid"), "first_half").otherwise("second_half")
    sign = F.when(F.col(amount) > 0, "positive").when(F.col(amount) < 0, "negative")

    def row(kind: str, group: Column, window: str, value: Column) -> Column:
        return F.when(group.isNotNull(), F.struct(F.lit(kind).alias("section"), group.alias("group"),
                                                  F.lit(window).alias("window"), value.alias("value")))

    entries = []
    for a, b in windows:
        car, name = F.col(car_name(a, b)), f"[{a},{b}]"
        bet = -F.signum(F.col(amount)) * car
        entries += [row("groups", sign, name, car), row("long_short", F.lit("all"), name, bet),
                    row("oos", half, name, bet)]
        if (a, b) == tuple(windows[-1]):
            entries.append(row("liquidity", liquidity, name, bet))
    long = tagged.select(event_date, F.inline(F.array_compact(F.array(*entries))))
    return clustered_t(long, "value", ["section", "group", "window"], event_date)
