"""Bar quality rules and cleaning, per symbol and in time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.columns import lenient_date, ratio
from tidemark.operators.ordered import cell_for, with_neighbours
from tidemark.schemas import require_columns

PRICES = ("open", "high", "low", "close")


def rule_violations() -> Column:
    """Names of the single-row rules a bar breaks."""
    rules = {
        "negative_ohlc": F.least(*[F.col(c) for c in PRICES]) < 0,
        "high_below_low": F.col("high") < F.col("low"),
        "high_below_open": F.col("high") < F.col("open"),
        "high_below_close": F.col("high") < F.col("close"),
        "low_above_open": F.col("low") > F.col("open"),
        "low_above_close": F.col("low") > F.col("close"),
        "negative_volume": F.col("volume") < 0,
    }
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def validate_bars(df: DataFrame, mode: str = "fail", by: str = "symbol", date: str = "date") -> DataFrame:
    """Check the eight bar rules.

    ``report`` returns the bad rows with their ``violations``; ``drop`` returns
    the good rows; ``fail`` raises ``ValueError`` if any row is bad and returns
    the input. Every copy of a repeated (symbol, date) counts as bad.
    """
    require_columns(df, [by, date, *PRICES, "volume"], "bars")
    repeated = (
        df.groupBy(by, date).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
        .select(by, date, F.lit(True).alias("_repeated"))
    )
    checked = df.join(repeated, [by, date], "left").select(*df.columns, F.concat(
        rule_violations(),
        F.when(F.col("_repeated"), F.array(F.lit("duplicate_timestamp"))).otherwise(F.array().cast("array<string>")),
    ).alias("violations"))
    bad = F.size("violations") > 0
    if mode == "report":
        return checked.filter(bad)
    if mode == "drop":
        return checked.filter(~bad).drop("violations")
    if mode != "fail":
        raise ValueError(f"unknown mode {mode!r}")
    first = checked.filter(bad).limit(1).collect()
    if first:
        row = first[0]
        raise ValueError(f"bar {row[by]} {row[date]} breaks {list(row['violations'])}")
    return df


def _carry_limited(df: DataFrame, columns: Sequence[str], by: str, ts: str, limit: int) -> DataFrame:
    """Fill NULLs from at most ``limit`` rows back."""
    def add(d: DataFrame, w) -> DataFrame:
        near = w.rowsBetween(-limit, 0)
        return d.withColumns({c: F.last(c, ignorenulls=True).over(near) for c in columns})

    return with_neighbours(df, [by], [ts], limit, 0, add, cell_for(df, ts))


def clean_ohlcv(df: DataFrame, by: str = "symbol", limit: int = 3) -> DataFrame:
    """Uniform ``ts`` column, short gaps filled, NULL closes dropped, ISO weekday added."""
    for c in df.columns:
        if c.lower() in ("date", "timestamp", "datetime"):
            df = df.withColumnRenamed(c, "ts")
    filled = _carry_limited(df, [c for c in PRICES if c in df.columns], by, "ts", limit)
    return (
        filled.withColumn("volume", F.coalesce("volume", F.lit(0)))
        .filter(F.col("close").isNotNull())
        .withColumn("day_of_week", F.weekday("ts") + 1)
    )


def return_outliers(df: DataFrame, k: float = 10, by: str = "symbol", date: str = "date",
                    close: str = "close") -> DataFrame:
    """Returns more than k sample deviations away from their symbol's mean."""
    def add(d: DataFrame, w) -> DataFrame:
        return d.withColumn("ret", ratio(close, F.lag(close, 1).over(w)) - 1)

    moves = with_neighbours(df.select(by, date, close), [by], [date], 1, 0, add, cell_for(df, date))
    stats = moves.groupBy(by).agg(F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("sd_ret"))
    far = F.abs(F.col("ret") - F.col("mean_ret")) > F.col("sd_ret") * k
    return moves.join(stats, by).filter((F.col("sd_ret") > 0) & far)


def align_to_calendar(df: DataFrame, fill: bool = True, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """One row per weekday from a symbol's first to last bar.

    Prices carry forward, volume is 0 on added days, weekend bars drop out.
    Symbols with a single row are returned unchanged.
    """
    day = F.col(ts).cast("date")
    span = df.groupBy(by).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"), F.count(F.lit(1)).alias("_k"))
    spine = (
        span.filter("_k > 1")
        .select(by, F.explode(F.sequence("_lo", "_hi")).alias("_day"))
        .filter(F.weekday("_day") < 5)
        .select(by, F.col("_day").cast(df.schema[ts].dataType).alias(ts))
    )
    single = df.join(span.filter("_k = 1").select(by), by, "left_semi")
    placed = spine.join(df, [by, ts], "left").select(*df.columns)
    if fill:
        w = Window.partitionBy(by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumns({
            **{c: F.last(c, ignorenulls=True).over(w) for c in PRICES},
            "volume": F.coalesce("volume", F.lit(0)).cast(df.schema["volume"].dataType),
        })
    return placed.unionByName(single)


def detect_splits(df: DataFrame, threshold: float = 0.40, by: str = "symbol", date: str = "date",
                  close: str = "close") -> DataFrame:
    """Closes below ``threshold`` times the previous close, with the implied split."""
    def add(d: DataFrame, w) -> DataFrame:
        prev = F.lag(close, 1).over(w)
        return d.withColumn("_ratio", F.when(prev > 0, F.col(close) / prev).when(prev.isNotNull(), F.lit(1.0)))

    moves = with_neighbours(df.select(by, date, close), [by], [date], 1, 0, add, cell_for(df, date))
    suspected = F.bround(F.try_divide(F.lit(1.0), F.col("_ratio"))).cast("long")
    return moves.filter(F.col("_ratio") < threshold).select(
        by, date,
        F.concat(F.lit("1:"), F.coalesce(suspected.cast("string"), F.lit("inf"))).alias("ratio_suspected"),
        ((1 - F.col("_ratio")) * 100).alias("price_drop_pct"),
    )


def normalize_volume(df: DataFrame, by: Sequence[str] = ("symbol",), column: str = "volume",
                     out: str = "volume_z") -> DataFrame:
    """Sample z-score of the volume; the plain deviation where it has no spread."""
    stats = df.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    gap = F.col(column) - F.col("_m")
    z = F.when(F.col("_s") > 0, gap / F.col("_s")).otherwise(gap)
    return df.join(stats, list(by)).select(*df.columns, z.alias(out))


def dated_rows(df: DataFrame, as_of, date: str = "action_date", by: str = "symbol", amount: str = "amount",
               positive_only: bool = False) -> DataFrame:
    """Rows with a key, a readable date not after ``as_of`` and an amount."""
    day = lenient_date(date) if isinstance(df.schema[date].dataType, T.StringType) else F.col(date).cast("date")
    rows = df.withColumn(date, day).dropna(subset=[by, date, amount])
    rows = rows.filter(F.col(date) <= F.to_date(F.lit(as_of)))
    return rows.filter(F.col(amount) > 0) if positive_only else rows


def map_vendor(df: DataFrame, mapping: DataFrame, vendor: str = "vendor", symbol: str = "symbol") -> DataFrame:
    """Attach the symbol of a vendor; unmapped rows are dropped.

    The join strategy is left to the optimizer, which broadcasts the mapping
    only when its measured size allows it.
    """
    pairs = mapping.select(vendor, symbol).filter(F.col(symbol).isNotNull()).distinct()
    return df.join(pairs, vendor)


def contract_intensity(panel: DataFrame, close: str = "close", shares: str = "shares_outstanding",
                       obligations: str = "contract_oblig_ttm") -> DataFrame:
    """Market value and trailing obligations relative to it."""
    return panel.withColumn("market_cap", F.col(close) * F.col(shares)).withColumn(
        "contract_intensity", F.when(F.col("market_cap") > 0, F.col(obligations) / F.col("market_cap")))


def search_awards(df: DataFrame, keywords: Sequence[str], start: str, end: str, text: str = "description",
                  date: str = "start_date", amount: str = "award_amount") -> DataFrame:
    """Awards of a period, once per keyword their description contains."""
    tags = F.array(*[F.lit(k) for k in keywords])
    hits = F.filter(tags, lambda k: F.contains(F.lower(F.col(text)), F.lower(k)))
    dated = df.filter(F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return dated.withColumn("keyword", F.explode(hits)).orderBy(F.col(amount).desc())
