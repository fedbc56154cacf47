"""Fama-MacBeth regressions from per-period moments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.aggregates import t_stat
from tidemark.operators.ordered import dealt, positions
from tidemark.operators.windows import distinct_periods, sample_within
from tidemark.plans.study import horizon_of
from tidemark.session import reused


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(r: pd.Series, c: pd.Series) -> pd.Series:
    """Minimum-norm slopes of the small correlation systems of a batch of periods."""
    k = len(c.iloc[0]) if len(c) else 0
    systems = np.stack([np.asarray(x, dtype=float).reshape(k, k) for x in r])
    sides = np.stack([np.asarray(x, dtype=float) for x in c])
    slopes = np.einsum("nij,nj->ni", np.linalg.pinv(systems, rcond=1e-12, hermitian=True), sides)
    return pd.Series(list(slopes))


def _slopes(k: int, r: dict[tuple[int, int], Column], c: list[Column]) -> Column:
    """Slope vector; one and two regressors have a closed form that stays in the JVM."""
    if k == 1:
        return F.array(c[0])
    if k == 2:
        rho = r[(0, 1)]
        det = 1 - rho * rho
        collinear = F.abs(det) < 1e-12
        return F.array(
            F.when(collinear, (c[0] + rho * c[1]) / 4).otherwise((c[0] - rho * c[1]) / det),
            F.when(collinear, (c[1] + rho * c[0]) / 4).otherwise((c[1] - rho * c[0]) / det))
    full = [F.lit(1.0) if i == j else r[(min(i, j), max(i, j))] for i in range(k) for j in range(k)]
    return _solve(F.array(*full), F.array(*c))


def period_slopes(data: DataFrame, features: Sequence[str], forward: str, period: str = "date",
                  k: int | Column | None = None, min_obs: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Slopes ``b`` on standardised features and R-squared of each usable period.

    With standardised regressors the intercept is orthogonal, so the slopes solve
    correlation(x) * b = cov(z, y). Those moments are plain mergeable aggregates:
    cross-sections of any size reduce to k(k+3)/2 numbers on the map side.
    """
    n_feat = len(features)
    step = k if k is not None else horizon_of(forward)
    need = min_obs or n_feat + 2
    keys = list(by) or ["_all"]
    rows = data if by else data.withColumn("_all", F.lit(0))
    rows = rows.dropna(subset=[*features, forward]).select(*keys, period, *features, forward)
    if not isinstance(step, int) or step > 1:
        rows = reused(rows)  # read for the list of periods and again for the sample
    sampled = sample_within(rows, step, keys, period)
    pairs = [(i, j) for i in range(n_feat) for j in range(i + 1, n_feat)]
    moments = sampled.groupBy(*keys, period).agg(
        F.count(F.lit(1)).alias("_n"), F.var_pop(forward).alias("_vy"),
        *[F.stddev_pop(f).alias(f"_s{i}") for i, f in enumerate(features)],
        *[F.covar_pop(f, forward).alias(f"_c{i}") for i, f in enumerate(features)],
        *[F.covar_pop(features[i], features[j]).alias(f"_r{i}_{j}") for i, j in pairs])
    usable = F.col("_n") >= need
    for i in range(n_feat):
        usable = usable & (F.col(f"_s{i}") > 0)
    sides = [F.col(f"_c{i}") / F.col(f"_s{i}") for i in range(n_feat)]
    corr = {(i, j): F.col(f"_r{i}_{j}") / (F.col(f"_s{i}") * F.col(f"_s{j}")) for i, j in pairs}
    solved = moments.filter(usable).withColumn("_c", F.array(*sides)).withColumn("b", _slopes(n_feat, corr, sides))
    explained = F.aggregate(F.zip_with("b", "_c", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    r2 = F.when(F.col("_vy") > 0, explained / F.col("_vy")).otherwise(0.0)
    return solved.select(*by, period, F.col("_n").alias("n_obs"), "b", r2.alias("r2"))


def fama_macbeth(data: DataFrame, features: Sequence[str], forward: str = "forward_20d_return",
                 period: str = "date", k: int | Column | None = None, min_obs: int | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """One row per feature (and group): mean slope, deviation, t, periods, mean R-squared."""
    slopes = period_slopes(data, features, forward, period, k, min_obs, by)
    raw = slopes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_periods"), F.coalesce(F.avg("r2"), F.lit(0.0)).alias("avg_r2"),
        *[F.avg(F.col("b")[i]).alias(f"_m{i}") for i in range(len(features))],
        *[F.stddev_samp(F.col("b")[i]).alias(f"_s{i}") for i in range(len(features))])
    zero = F.lit(0.0)
    table = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.coalesce(f"_m{i}", zero).alias("mean"),
                 F.coalesce(f"_s{i}", zero).alias("std")) for i, f in enumerate(features)])
    rows = raw.select(*by, "n_periods", "avg_r2", F.inline(table))
    return rows.select(*by, "feature", "mean", "std",
                       t_stat(F.col("mean"), F.col("std"), F.col("n_periods")).alias("t_stat"),
                       "n_periods", "avg_r2")


def oos_splits(panel: DataFrame, features: Sequence[str], horizons: Sequence[int], period: str = "date",
               k: int | None = None) -> DataFrame:
    """Fama-MacBeth on the full panel, both halves of time and both halves of the universe.

    Each row is labelled with the splits it belongs to and all regressions of a
    horizon run in one aggregation.
    """
    forwards = [f"forward_{h}d_return" for h in horizons]
    rows = reused(panel.dropna(subset=[*features, *forwards]).select("symbol", period, *features, *forwards))
    dates = distinct_periods(rows, period)
    half = dates.agg(F.max("period_index").alias("_last")).select(F.floor((F.col("_last") + 1) / 2).alias("_half"))
    middle = (dates.withColumn("_all", F.lit(0)).join(half.withColumn("_all", F.lit(0)), "_all")
              .select(period, (F.col("period_index") < F.col("_half")).alias("_first")))
    names = rows.select("symbol").distinct().withColumn("_all", F.lit(0))
    sides = positions(dealt(names, ["_all"], ["symbol"]), ["_all"], ["symbol"], F.col("_part"), "_i") \
        .select("symbol", (F.col("_i") % 2 == 0).alias("_even"))
    labels = F.array(
        F.lit("full"),
        F.when(F.col("_first"), "in_sample_first_half").otherwise("oos_second_half"),
        F.when(F.col("_even"), "universe_A").otherwise("universe_B"))
    split = reused(rows.join(middle, period).join(sides, "symbol").withColumn("split", F.explode(labels)))
    parts = [fama_macbeth(split, features, f, period, k, None, ["split"]).withColumn("forward_col", F.lit(f))
             for f in forwards]
    return reduce(DataFrame.unionByName, parts)
