"""Whole studies: features, panel, every feature and horizon, regressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.operators.aggregates import ic_by_period, ic_summary
from tidemark.operators.joins import asof_join
from tidemark.operators.ordered import cell_for, positions
from tidemark.operators.sets import union_relaxed
from tidemark.operators.windows import cumulative_drawdown, forward_returns, momentum, quantile_bucket
from tidemark.plans.features import award_velocity, fundamental_momentum, size_features, trailing_obligations
from tidemark.plans.regression import fama_macbeth
from tidemark.plans.study import assemble_panel, spread_by_period, spread_summary
from tidemark.session import reused

CONTRACT_MODELS = {
    "velocity_vs_momentum": ("contract_award_velocity_z", "price_momentum"),
    "intensity_vs_momentum": ("contract_intensity", "price_momentum"),
    "all_three": ("contract_award_velocity_z", "contract_intensity", "price_momentum"),
}

TABLES = ("studies", "regressions")


def study_table(panel: DataFrame, features: Sequence[str], horizons: Sequence[int], q: int = 5,
                period: str = "date") -> DataFrame:
    """IC and spread headline of every feature and horizon, one row each.

    All studies run side by side as one job: the panel is laid out long, one row
    per usable (feature, horizon), and every step groups by those two as well.
    """
    key = ["feature", "horizon"]
    target = lambda h: F.col(f"forward_{h}d_return")
    # Periods are chosen first, on one row per period, so that only rows of sampled periods are laid out.
    held = panel.groupBy(period).agg(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(h).alias("horizon"), F.max(F.col(f).isNotNull() & target(h).isNotNull()).alias("usable"))
        for h in horizons for f in features]).alias("_pairs"))
    periods = held.select(period, F.inline("_pairs")).filter("usable").drop("usable")
    placed = positions(periods, key, [period], cell_for(periods, period, "day"), "_i").filter(F.col("_i") % F.col("horizon") == 0)
    chosen = placed.groupBy(period).agg(F.collect_set(F.concat_ws("|", "horizon", "feature")).alias("_chosen"))
    if isinstance(panel.schema[period].dataType, T.DateType):
        chosen = F.broadcast(chosen)  # calendar-bounded: 36 525 dates to a century
    pairs = F.array(*[
        F.when(F.array_contains("_chosen", f"{h}|{f}") & F.col(f).isNotNull() & target(h).isNotNull(),
               F.struct(F.lit(f).alias("feature"), F.lit(h).alias("horizon"), F.col(f).cast("double").alias("x"), target(h).alias("y")))
        for h in horizons for f in features])
    sampled = reused(panel.join(chosen, period).select("symbol", period, F.inline(F.array_compact(pairs))))
    rows = reused(quantile_bucket(sampled, "x", q, period, min_names=q, by=key))
    means = rows.groupBy(*key, period, "quantile").agg(F.avg("y").alias("mean_return"))
    long_short = cumulative_drawdown(spread_by_period(means, q, period, key), "spread", period, key)
    spread = spread_summary(long_short, 252.0 / F.col("horizon"), key)
    found = ic_summary(ic_by_period(rows, "x", "y", period, key), key).join(spread, key, "full")
    # A feature and horizon without a usable period shows as a row of no periods.
    wanted = panel.sparkSession.createDataFrame([(f, h) for h in horizons for f in features], "feature string, horizon int")
    return wanted.join(found, key, "left").fillna(0, ["n_ic_periods"])


def regression_table(panel: DataFrame, models: dict[str, Sequence[str]], horizons: Sequence[int],
                     period: str = "date") -> DataFrame:
    """Fama-MacBeth of every model; the horizons of a model share one job."""
    targets = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"forward_{h}d_return").alias("y"))
                        for h in horizons])
    parts = []
    for name, feats in models.items():
        long = panel.select(period, *feats, F.inline(targets))
        result = fama_macbeth(long, list(feats), "y", period, F.col("horizon"), None, ["horizon"])
        parts.append(result.select(F.lit(name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, parts)


def velocity_panel(transactions: DataFrame, shares: DataFrame, bars: DataFrame, horizons: Sequence[int], *, as_of,
                   momentum_rows: int = 63, **velocity) -> DataFrame:
    """Panel of award velocity, intensity and momentum."""
    features = union_relaxed(
        award_velocity(transactions, as_of=as_of, **velocity),
        trailing_obligations(transactions, as_of=as_of), size_features(shares))
    panel = assemble_panel(bars, features, horizons, momentum_rows=momentum_rows)
    return panel.withColumnRenamed(f"price_momentum_{momentum_rows}d", "price_momentum")


def _tables(panel: DataFrame, tables: Sequence[str], features: Sequence[str], models: dict[str, Sequence[str]],
            horizons: Sequence[int]) -> dict[str, DataFrame]:
    made = {"panel": panel}
    if "studies" in tables:
        made["studies"] = study_table(panel, features, horizons)
    if "regressions" in tables:
        made["regressions"] = regression_table(panel, models, horizons)
    return made


def velocity_study(transactions: DataFrame, shares: DataFrame, bars: DataFrame,
                   horizons: Sequence[int] = (20, 60, 120), *, as_of, momentum_rows: int = 63,
                   cache: bool = True, tables: Sequence[str] = TABLES, **velocity) -> dict[str, DataFrame]:
    """Award-velocity study: the panel is cached once for all its uses; ``tables`` says which to plan beside it."""
    panel = velocity_panel(transactions, shares, bars, horizons, as_of=as_of, momentum_rows=momentum_rows, **velocity)
    panel = reused(panel) if cache else panel
    return _tables(panel, tables, ["contract_award_velocity_z", "price_momentum", "contract_intensity"], CONTRACT_MODELS, horizons)


def fundamental_panel(revenue: DataFrame, bars: DataFrame, horizons: Sequence[int],
                      momentum_rows: int = 63) -> DataFrame:
    joined = asof_join(bars, fundamental_momentum(revenue), ["rev_yoy_growth", "rev_yoy_accel"])
    return momentum(forward_returns(joined, horizons), momentum_rows, out="price_momentum")


def fundamental_study(revenue: DataFrame, bars: DataFrame, horizons: Sequence[int] = (20, 60, 120),
                      momentum_rows: int = 63, cache: bool = True, tables: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """Growth, acceleration and momentum studies with their joint regression; ``tables`` as above."""
    panel = fundamental_panel(revenue, bars, horizons, momentum_rows)
    panel = reused(panel) if cache else panel
    features = ["rev_yoy_accel", "rev_yoy_growth", "price_momentum"]
    return _tables(panel, tables, features, {"fundamental": features}, horizons)
