"""Point-in-time features in the feature-store schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import lenient_date, ratio
from tidemark.operators.aggregates import daily_totals
from tidemark.operators.cleaning import dated_rows
from tidemark.operators.sets import first_by
from tidemark.operators.windows import rolling_daily, trailing_zscore
from tidemark.schemas import FEATURE, conform, require_columns


def _feature_rows(df: DataFrame, name: str, value: Column, known: Column, asof: Column, source: str,
                  event_id: Column | None = None) -> DataFrame:
    return conform(df.select(
        "symbol", known.alias("ts_available"), F.lit(name).alias("feature_name"), value.alias("feature_value"),
        F.lit(source).alias("source"), (event_id if event_id is not None else F.lit("")).alias("source_event_id"),
        asof.alias("asof_date")), FEATURE)


def award_velocity(transactions: DataFrame, *, as_of, recent_days: int = 90, baseline_days: int = 730,
                   reporting_lag_days: int = 30, zscore_min_periods: int = 8,
                   feature_name: str = "contract_award_velocity_z") -> DataFrame:
    """Recent obligations relative to their long-run pace, as a trailing z-score.

    Transactions shrink to daily totals on the map side; both calendar windows
    and the z-score then share one shuffle on the symbol.
    """
    rows = dated_rows(transactions, as_of, positive_only=True)
    daily = rolling_daily(daily_totals(rows), "daily_amount",
                          {"_recent": recent_days, "_base": baseline_days}, date="action_date")
    expected = F.col("_base") * (recent_days / baseline_days)
    pace = daily.withColumn("velocity_raw", F.when(expected > 0, F.col("_recent") / expected)) \
        .filter("velocity_raw is not null")
    scored = trailing_zscore(pace, "velocity_raw", "symbol", "action_date", zscore_min_periods, "velocity_z")
    day = F.col("action_date")
    return _feature_rows(scored.filter("velocity_z is not null"), feature_name, F.col("velocity_z"),
                         F.date_add(day, reporting_lag_days), day, "usaspending_tx")


def trailing_obligations(obligations: DataFrame, *, as_of, window_days: int = 365, reporting_lag_days: int = 45,
                         feature_name: str = "contract_oblig_ttm") -> DataFrame:
    """Positive trailing-window obligation totals; returns count negative."""
    daily = rolling_daily(daily_totals(dated_rows(obligations, as_of)), "daily_amount", {"ttm": window_days},
                          date="action_date")
    day = F.col("action_date")
    return _feature_rows(daily.filter("ttm > 0"), feature_name, F.col("ttm"),
                         F.date_add(day, reporting_lag_days), day, "usaspending_tx")


def fundamental_momentum(revenue: DataFrame, feature_growth: str = "rev_yoy_growth",
                         feature_accel: str = "rev_yoy_accel") -> DataFrame:
    """Growth over the same fiscal quarter a year before, and its change, in percent."""
    require_columns(revenue, ["symbol", "start", "end", "val", "fp", "filed"], "revenue")
    dated = revenue.withColumns({c: lenient_date(c) for c in ("start", "end", "filed")})
    dated = dated.dropna(subset=["start", "end", "filed", "val", "fp"])
    quarters = dated.filter(F.datediff("end", "start").between(80, 100) & (F.col("val") > 0))
    first = first_by(quarters.select("symbol", "end", "fp", "val", "filed"), ["symbol", "end"],
                     ["filed", "fp", "val"])
    w = Window.partitionBy("symbol", "fp").orderBy("end")
    grown = first.withColumn("_yoy", ratio("val", F.lag("val", 1).over(w)) - 1)
    grown = grown.withColumn("_accel", F.col("_yoy") - F.lag("_yoy", 1).over(w))
    pair = F.array(F.struct(F.lit(feature_growth).alias("name"), F.col("_yoy").alias("x")),
                   F.struct(F.lit(feature_accel).alias("name"), F.col("_accel").alias("x")))
    stacked = grown.select("symbol", "end", "filed", F.inline(pair)).filter("x is not null")
    return conform(stacked.select(
        "symbol", F.col("filed").alias("ts_available"), F.col("name").alias("feature_name"),
        (F.col("x") * 100).alias("feature_value"), F.lit("sec_xbrl").alias("source"),
        F.col("end").cast("string").alias("source_event_id"), F.col("end").alias("asof_date")), FEATURE)


def size_features(shares: DataFrame, feature_name: str = "shares_outstanding") -> DataFrame:
    """Shares outstanding as a feature known from its filing date."""
    known = F.col("ts_available")
    return _feature_rows(shares, feature_name, F.col("shares"), known, known, "sec_edgar")
