"""Panels and cross-sectional signal studies."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.aggregates import ic_by_period, ic_summary, quantile_returns, quantile_summary, top_by_year
from tidemark.operators.cleaning import contract_intensity
from tidemark.operators.joins import asof_join
from tidemark.operators.windows import (cumulative_drawdown, forward_returns, momentum, quantile_bucket,
                                        sample_periods)
from tidemark.schemas import require_columns
from tidemark.session import reused

PANEL_FEATURES = ("contract_award_velocity_z", "contract_oblig_ttm", "shares_outstanding")


def horizon_of(column: str) -> int:
    """Rows a forward column looks ahead, from its name; 1 when it has none."""
    found = re.search(r"forward_(\d+)d", column)
    return max(1, int(found.group(1))) if found else 1


def assemble_panel(bars: DataFrame, features: DataFrame, horizons: Sequence[int],
                   names: Sequence[str] = PANEL_FEATURES, momentum_rows: int = 63) -> DataFrame:
    """Bars with point-in-time features, forward returns, momentum and intensity."""
    joined = asof_join(bars, features, names)
    panel = momentum(forward_returns(joined, horizons), momentum_rows)
    if {"contract_oblig_ttm", "shares_outstanding"} <= set(names):
        panel = contract_intensity(panel)
    return panel


def study_rows(panel: DataFrame, feature: str, forward: str, q: int = 5, k: int | None = None,
               period: str = "date") -> DataFrame:
    """Sampled, sufficiently wide periods with the quantile of every row."""
    require_columns(panel, ["symbol", period, feature, forward], "panel")
    rows = panel.select("symbol", period, feature, forward).dropna(subset=[feature, forward])
    sampled = sample_periods(rows, k if k is not None else horizon_of(forward), period)
    return quantile_bucket(reused(sampled), feature, q, period, min_names=q)


def spread_by_period(returns: DataFrame, q: int = 5, period: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Top minus bottom quantile mean, for periods that have both."""
    pick = lambda n: F.max(F.when(F.col("quantile") == n, F.col("mean_return")))
    sides = returns.groupBy(*by, period).agg(pick(q).alias("top_mean"), pick(1).alias("bottom_mean"))
    return sides.withColumn("spread", F.col("top_mean") - F.col("bottom_mean")).filter("spread is not null")


def spread_summary(long_short: DataFrame, per_year, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, annualised Sharpe and deepest fall; ``per_year`` may be a column of ``by``."""
    raw = long_short.groupBy(*by).agg(F.avg("spread").alias("m"), F.stddev_samp("spread").alias("s"),
                         F.min("drawdown").alias("d"))
    zero = F.lit(0.0)
    sharpe = F.when(F.col("s") > 0, F.col("m") / F.col("s") * F.sqrt(F.lit(per_year)))
    return raw.select(*by, F.coalesce("m", zero).alias("mean_spread"), F.coalesce("s", zero).alias("std_spread"),
                      F.coalesce(sharpe, zero).alias("sharpe"), F.coalesce("d", zero).alias("max_drawdown_pct"))


def signal_study(panel: DataFrame, feature: str, forward: str, q: int = 5, k: int | None = None,
                 period: str = "date", check: bool = True) -> dict[str, DataFrame]:
    """All tables of one study, lazily; keys name the tables.

    With ``check`` a universe too thin for ``q`` buckets raises ``ValueError``.
    """
    step = k if k is not None else horizon_of(forward)
    rows = reused(study_rows(panel, feature, forward, q, step, period))
    if check and rows.isEmpty():
        raise ValueError(f"no period holds {q} names for {feature} and {forward}")
    per_year = 252.0 / step
    returns = quantile_returns(rows, forward, period)
    long_short = cumulative_drawdown(spread_by_period(returns, q, period), "spread", period,
                                     cum_out="cumulative_spread")
    ic = ic_by_period(rows, feature, forward, period)
    meta = rows.agg(
        F.lit(feature).alias("feature"), F.lit(forward).alias("forward_col"), F.lit(q).alias("n_quantiles"),
        F.lit(step).alias("rebalance_days"), F.round(F.lit(per_year), 2).alias("periods_per_year"),
        F.countDistinct(period).alias("n_periods"), F.countDistinct("symbol").alias("n_symbols"),
        F.count(F.lit(1)).alias("n_observations"), F.min(period).alias("first_period"),
        F.max(period).alias("last_period"))
    return {
        "rows": rows, "meta": meta,
        "quintile_returns": returns, "quintile_summary": quantile_summary(rows, forward),
        "ic_by_period": ic, "ic_summary": ic_summary(ic),
        "long_short": long_short, "spread_summary": spread_summary(long_short, per_year),
        "top_by_year": top_by_year(rows, forward, q, period),
    }
