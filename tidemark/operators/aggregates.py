"""Grouped statistics of studies and award tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import ratio
from tidemark.operators.ranking import average_ranks, exact_quantiles
from tidemark.operators.windows import rolling_rows


def daily_totals(df: DataFrame, by: str = "symbol", date: str = "action_date", amount: str = "amount",
                 out: str = "daily_amount") -> DataFrame:
    return df.groupBy(by, date).agg(F.sum(amount).alias(out))


def monthly_award_velocity(df: DataFrame, vendor: str = "vendor", date: str = "start_date") -> DataFrame:
    """Awards per vendor and month with trailing three-row totals."""
    monthly = (
        df.groupBy(vendor, F.trunc(F.col(date).cast("date"), "month").alias("month"))
        .agg(F.sum("amount").alias("monthly_awards"),
             F.countDistinct("award_id").alias("award_count"),
             F.avg("amount").alias("avg_award_size"))
    )
    totals = rolling_rows(monthly, "monthly_awards", 3, "sum", vendor, "month", "trailing_3mo_total")
    return rolling_rows(totals, "award_count", 3, "sum", vendor, "month", "trailing_3mo_count")


def quantile_returns(df: DataFrame, forward: str, period: str = "date") -> DataFrame:
    """Return statistics per quantile and period; the median is exact."""
    keys = ["quantile", period]
    stats = df.groupBy(*keys).agg(
        F.avg(forward).alias("mean_return"),
        F.stddev_samp(forward).alias("std_return"),
        F.count("symbol").alias("n_stocks"),
        F.count(F.when(F.col(forward) > 0, 1)).alias("winners"),
    )
    return stats.join(exact_quantiles(df, keys, forward, {"median_return": 0.5}), keys)


def quantile_summary(df: DataFrame, forward: str) -> DataFrame:
    """Return statistics per quantile over all periods."""
    return df.groupBy("quantile").agg(
        F.avg(forward).alias("avg_return"),
        F.stddev_samp(forward).alias("std_return"),
        F.count(F.when(F.col(forward) > 0, 1)).alias("win_count"),
        F.count(forward).alias("total_count"),
    ).withColumn("hit_rate_pct", ratio("win_count", "total_count") * 100)


def _correlation(x: str, y: str) -> Column:
    # corr() raises on a constant column under ANSI, so the parts are divided here.
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ic_by_period(df: DataFrame, feature: str, forward: str, period: str = "date",
                 by: Sequence[str] = ()) -> DataFrame:
    """Pearson and Spearman correlation per period, undefined periods removed."""
    rows = df.select(*by, period, feature, forward).filter(F.col(feature).isNotNull() & F.col(forward).isNotNull())
    ranked = average_ranks(rows, [*by, period], {"_rx": feature, "_ry": forward})
    ic = ranked.groupBy(*by, period).agg(
        _correlation(feature, forward).alias("pearson_ic"),
        _correlation("_rx", "_ry").alias("spearman_ic"),
    )
    return ic.filter(F.col("pearson_ic").isNotNull())


def ic_summary(ic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, information ratio and t-statistic of the IC; one row per ``by``."""
    raw = ic.groupBy(*by).agg(
        F.avg("pearson_ic").alias("m"), F.stddev_samp("pearson_ic").alias("s"),
        F.avg("spearman_ic").alias("r"), F.count(F.when(F.col("pearson_ic") > 0, 1)).alias("up"),
        F.count("pearson_ic").alias("n"),
    )
    zero = F.lit(0.0)
    ir = F.coalesce(F.when(F.col("s") > 0, F.col("m") / F.col("s")), zero)
    return raw.select(
        *by, F.coalesce("m", zero).alias("pearson_ic_mean"),
        F.coalesce("s", zero).alias("pearson_ic_std"),
        ir.alias("pearson_ic_ir"),
        F.coalesce("r", zero).alias("spearman_ic_mean"),
        F.coalesce(ratio("up", "n") * 100, zero).alias("ic_positive_pct"),
        (ir * F.sqrt("n")).alias("ic_t_stat"),
        F.col("n").alias("n_ic_periods"),
    )


def top_by_year(df: DataFrame, forward: str, q: int = 5, period: str = "date") -> DataFrame:
    """Mean return of the top quantile by calendar year."""
    return (
        df.filter(F.col("quantile") == q).groupBy(F.year(period).alias("year"))
        .agg(F.avg(forward).alias("top_quintile_return"))
    )


def t_stat(mean: Column, sd: Column, n: Column) -> Column:
    """mean / (sd / sqrt(n)); 0 when fewer than two values or no spread."""
    return F.coalesce(F.when((n > 1) & (sd > 0), mean / (sd / F.sqrt(n))), F.lit(0.0))


def clustered_t(df: DataFrame, column: str, by: Sequence[str] = (), date: str = "event_date") -> DataFrame:
    """Event mean, naive t, and a t that counts each event-month once."""
    rows = df.filter(F.col(column).isNotNull())
    month = (F.year(date) * 12 + F.month(date)).alias("_month")
    # Moments of the single events are rebuilt from the month rows, so the table
    # is aggregated once and only month rows travel further.
    monthly = rows.groupBy(*by, month).agg(
        F.count(column).alias("_k"), F.avg(column).alias("_m"), F.var_pop(column).alias("_v"),
    )
    # Months are calendar-bounded, so their pooled mean is a window over them; squares are pooled around it and never subtracted.
    pooled = Window.partitionBy(*by, F.lit(0))
    monthly = monthly.withColumn("_mean", ratio(F.sum(F.col("_k") * F.col("_m")).over(pooled), F.sum("_k").over(pooled)))
    away = F.col("_m") - F.col("_mean")
    stats = monthly.groupBy(*by).agg(
        F.sum("_k").alias("n"), F.count(F.lit(1)).alias("n_months"), F.first("_mean").alias("_mean"),
        F.sum(F.col("_k") * (F.col("_v") + away * away)).alias("_sq"),
        F.avg("_m").alias("_mm"), F.stddev_samp("_m").alias("_ms"),
    )
    sd = F.sqrt(F.try_divide(F.col("_sq"), F.col("n") - 1))
    return stats.select(
        *by, "n", "n_months", F.round("_mean", 3).alias("mean_pct"),
        F.round(t_stat(F.col("_mean"), sd, F.col("n")), 2).alias("naive_t"),
        F.round(t_stat(F.col("_mm"), F.col("_ms"), F.col("n_months")), 2).alias("clustered_t"),
    )


def hhi(df: DataFrame, key: str = "vendor", value: str = "amount", by: Sequence[str] = ()) -> DataFrame:
    """Herfindahl concentration of percentage shares; 0 without a positive total."""
    shares = df.groupBy(*by, key).agg(F.sum(value).alias("_v"))
    total, squares = F.sum("_v"), F.sum(F.col("_v") * F.col("_v"))
    index = F.coalesce(F.when(total > 0, squares / (total * total) * 10000), F.lit(0.0))
    return shares.groupBy(*by).agg(index.alias("award_concentration_hhi"))


def cut_points(df: DataFrame, column: str, probs: dict[str, float] | None = None, by: Sequence[str] = (),
               interpolation: str = "linear", approximate: bool = False) -> DataFrame:
    """Quantile cut points; exact unless ``approximate`` is asked for."""
    wanted = probs or {"q1": 1 / 3, "q2": 2 / 3}
    if approximate:
        return df.groupBy(*by).agg(*[F.percentile_approx(column, p, 10000).alias(n) for n, p in wanted.items()])
    return exact_quantiles(df, by, column, wanted, interpolation)


def group_zscore(df: DataFrame, column: str, by: Sequence[str], out: str = "z",
                 mean_out: str | None = None, sd_out: str | None = None) -> DataFrame:
    """Sample z-score within a group, via a small statistics table joined back."""
    stats = df.groupBy(*by).agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_sd"))
    z = F.coalesce(ratio(F.col(column) - F.col("_mean"), "_sd"), F.lit(0.0))
    extra = [F.col(a).alias(b) for a, b in (("_mean", mean_out), ("_sd", sd_out)) if b]
    return df.join(stats, list(by)).select(*df.columns, *extra, z.alias(out))
