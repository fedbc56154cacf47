"""Alternative-data signals: hiring, contracts, OTC volume, macro, composite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import clip, ratio, signal_label
from tidemark.functions.vocabularies import HIRING_CATEGORIES, SKILL_PATTERNS
from tidemark.operators.aggregates import group_zscore
from tidemark.operators.sets import last_n, latest_by
from tidemark.operators.text import skill_tags
from tidemark.operators.windows import difference, pct_change, rolling_rows


def skill_acceleration(jobs: DataFrame, patterns: dict[str, Sequence[str]] = SKILL_PATTERNS,
                       ignore_case: bool = False, text: str = "description", date: str = "post_date") -> DataFrame:
    """Monthly mentions and postings per skill, their change and three-row mean."""
    tags = skill_tags(jobs.select(date, text), patterns, ignore_case, text).filter("count > 0")
    monthly = tags.groupBy("skill_category", F.trunc(F.col(date).cast("date"), "month").alias("month")).agg(
        F.sum("count").alias("total_mentions"), F.count(F.lit(1)).alias("posting_count"))
    moved = pct_change(monthly, "total_mentions", 1, "skill_category", "month", "mom_change_pct")
    return rolling_rows(moved, "posting_count", 3, "mean", "skill_category", "month", "rolling_3mo_avg")


def hiring_index(trends: DataFrame, k: int = 6, categories: Sequence[str] = HIRING_CATEGORIES) -> DataFrame:
    """One row: mention-weighted index and momentum over each skill's last k months."""
    recent = last_n(trends.filter(F.col("skill_category").isin(list(categories))), ["skill_category"], ["month"], k)
    per = recent.groupBy("skill_category").agg(
        F.sum("total_mentions").alias("m"), F.avg("mom_change_pct").alias("a"))
    total = F.sum("m")
    return per.agg(
        ratio(F.sum(F.col("m") * F.col("m")), total).alias("ai_hiring_index"),
        ratio(F.sum(F.col("a") * F.col("m")), total).alias("ai_hiring_momentum"))


def contract_surprise(df: DataFrame, days: int = 90, *, as_of, by: Sequence[str] = (), vendor: str = "vendor",
                      agency: str = "agency", amount: str = "amount", date: str = "start_date") -> DataFrame:
    """Recent awards against the pro-rata pace of the history before them."""
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), days)
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    rows = rows.withColumn("_day", F.col(date).cast("date"))
    recent, past = F.col("_day") >= cutoff, F.col("_day") < cutoff
    # Vendors first: the concentration needs their totals, everything else adds up.
    vendors = rows.groupBy(*keys, vendor).agg(
        F.sum(F.when(recent, F.col(amount))).alias("r"), F.count(F.when(recent, F.col(amount))).alias("k"),
        F.sum(F.when(past, F.col(amount))).alias("h"),
        F.min(F.when(past, F.col("_day"))).alias("lo"), F.max(F.when(past, F.col("_day"))).alias("hi"))
    agencies = rows.filter(recent).groupBy(*keys).agg(F.countDistinct(agency).alias("unique_agencies"))
    zero = F.lit(0.0)
    total = vendors.groupBy(*keys).agg(
        F.coalesce(F.sum("r"), zero).alias("r"), F.sum("k").alias("k"), F.coalesce(F.sum("h"), zero).alias("h"),
        F.datediff(F.max("hi"), F.min("lo")).alias("span"), F.sum(F.col("r") * F.col("r")).alias("sq"))
    expected = F.coalesce(F.when(F.col("span") > 0, F.col("h") / F.col("span") * days), zero)
    return total.join(agencies, keys, "left").withColumn("_e", expected).select(
        *by, F.col("r").alias("recent_90d_awards"), F.col("_e").alias("expected_90d_awards"),
        F.when(F.col("_e") > 0, (F.col("r") - F.col("_e")) / F.col("_e")).otherwise(zero)
        .alias("contract_surprise_ratio"),
        F.coalesce(F.when(F.col("r") > 0, F.col("sq") / (F.col("r") * F.col("r")) * 10000), zero)
        .alias("award_concentration_hhi"),
        F.coalesce("unique_agencies", F.lit(0)).alias("unique_agencies"),
        F.coalesce(ratio("r", "k"), zero).alias("avg_award_size"))


# Component weights of the composite (fixed values).
WEIGHTS = {"filing_risk": 0.25, "ai_hiring": 0.25, "contract_awards": 0.25, "evasiveness": 0.15,
           "price_momentum": 0.10}


def price_overlay(bars: DataFrame, date: str = "date") -> DataFrame:
    """Latest close against its 20-row mean, for symbols with more than 20 closes."""
    recent = last_n(bars.select("symbol", date, "close"), ["symbol"], [date], 21)
    rank = recent.groupBy("symbol").agg(
        F.count("close").alias("_k"), F.max_by("close", date).alias("_last"), F.sum("close").alias("_sum"),
        F.min_by("close", date).alias("_oldest"))
    mean = (F.col("_sum") - F.col("_oldest")) / 20
    return rank.filter("_k > 20").select("symbol", ((ratio("_last", mean) - 1) * 100).alias("price_mom"))


def composite_signal(symbols: DataFrame, filing: DataFrame | None = None, hiring: DataFrame | None = None,
                     contract: DataFrame | None = None, evasive: DataFrame | None = None,
                     bars: DataFrame | None = None) -> DataFrame:
    """Weighted mean of the components each symbol has, and its label.

    Every component is a frame with one row per ``symbol``; a symbol missing from
    one simply lacks that component and its weight.
    """
    result = symbols.select("symbol").distinct()
    parts: dict[str, Column] = {}

    def attach(frame: DataFrame, columns: Sequence[str], name: str, score: Column) -> None:
        nonlocal result
        side = frame.select("symbol", *[F.col(c).alias(f"_{name}_{c}") for c in columns],
                            F.lit(True).alias(f"_{name}"))
        result = result.join(side, "symbol", "left")
        parts[name] = F.when(F.col(f"_{name}"), score)

    if filing is not None:
        risk = F.least(F.coalesce("_filing_risk_severity_score", F.lit(0)), F.lit(30)) / 10
        change = F.coalesce("_filing_risk_pct_changed", F.lit(0.0)) / 10
        attach(filing, ["severity_score", "pct_changed"], "filing_risk", -(risk * 0.7 + change * 0.3))
    if hiring is not None:
        attach(hiring, ["ai_hiring_momentum"], "ai_hiring",
               clip(F.coalesce("_ai_hiring_ai_hiring_momentum", F.lit(0.0)) * 5, -3.0, 3.0))
    if contract is not None:
        attach(contract, ["contract_surprise_ratio"], "contract_awards",
               clip(F.coalesce("_contract_awards_contract_surprise_ratio", F.lit(0.0)) * 2, -3.0, 3.0))
    if evasive is not None:
        attach(evasive, ["evasiveness_score"], "evasiveness",
               clip(-F.coalesce("_evasiveness_evasiveness_score", F.lit(0.0)) / 5, -3.0, 3.0))
    if bars is not None:
        attach(price_overlay(bars), ["price_mom"], "price_momentum",
               clip(F.col("_price_momentum_price_mom"), -3.0, 3.0))
    zero = F.lit(0.0)
    score = sum((F.coalesce(p * WEIGHTS[n], zero) for n, p in parts.items()), zero)
    weight = sum((F.when(p.isNotNull(), WEIGHTS[n]).otherwise(0.0) for n, p in parts.items()), zero)
    missing = {n: F.lit(None).cast("double") for n in WEIGHTS}
    scored = result.select("symbol", *[{**missing, **parts}[n].alias(n) for n in WEIGHTS],
                           score.alias("_score"), weight.alias("_weight"))
    final = scored.withColumn("composite_score", F.when(F.col("_weight") > 0, F.col("_score") / F.col("_weight"))
                              .otherwise(zero))
    return final.withColumn("interpretation", signal_label("composite_score")).drop("_score", "_weight")


def volume_spikes(df: DataFrame, z: float = 3.0, ticker: str = "ticker", volume: str = "share_volume") -> DataFrame:
    """Weeks whose volume lies more than z deviations above the ticker's mean."""
    scored = group_zscore(df, volume, [ticker], "volume_z_score", "avg_volume", "std_volume")
    return scored.filter(F.col("volume_z_score") > z).orderBy(F.col("volume_z_score").desc())


def latest_by_series(macro: DataFrame) -> DataFrame:
    """Latest observation of every series."""
    return latest_by(macro.filter(F.col("value").isNotNull()), "series_id", "date", ["value"])


def series_spread(macro: DataFrame, a: str, b: str, out: str = "spread") -> DataFrame:
    """Latest value of one series minus the latest value of another."""
    latest = latest_by_series(macro.filter(F.col("series_id").isin(a, b)))
    pick = lambda s: F.max(F.when(F.col("series_id") == s, F.col("value")))
    return latest.agg((pick(a) - pick(b)).alias(out))


def series_trend(macro: DataFrame, year_lag: int = 4) -> DataFrame:
    """Change over a year of rows (fraction) and against the previous row."""
    yearly = pct_change(macro, "value", year_lag, "series_id", "date", "yoy_change_pct")
    return difference(yearly, "value", 1, "series_id", "date", "qoq_change")


def macro_regime(macro: DataFrame, prices: str = "CPIAUCSL", unemployment: str = "UNRATE", equity: str = "SP500",
                 year_lag: int = 12) -> DataFrame:
    """Score and label from inflation (yearly percent change) and unemployment."""
    used = macro.filter(F.col("series_id").isin(prices, unemployment, equity) & F.col("value").isNotNull())
    yearly = pct_change(used, "value", year_lag, "series_id", "date", "_yoy")
    latest = latest_by(yearly, "series_id", "date", ["value", "_yoy"])

    def pick(series: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("series_id") == series, F.col(column))), F.lit(0.0))

    row = latest.agg((pick(prices, "_yoy") * 100).alias("inflation_cpi"),
                     pick(unemployment, "value").alias("unemployment"), pick(equity, "value").alias("sp500_latest"))
    p, u = F.col("inflation_cpi"), F.col("unemployment")
    from_prices = (F.when(p > 4.0, -2.0).when(p > 3.0, -1.0).when((p > 1.5) & (p < 2.5), 1.0).otherwise(0.0))
    from_jobs = (F.when(u > 6.0, -1.5).when(u.between(4.0, 5.0), 0.5).when(u < 3.5, 1.0).otherwise(0.0))
    s = F.col("macro_score")
    regime = (F.when(s > 1.0, "RISK_ON").when(s > 0.25, "GOLDILOCKS").when(s < -1.0, "RISK_OFF")
              .when(s < -0.25, "STAGFLATION_LEANING").otherwise("NEUTRAL"))
    return row.withColumn("macro_score", clip(from_prices + from_jobs, -3.0, 3.0)).withColumn("regime", regime)
