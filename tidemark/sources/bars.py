"""Bar files: CSV scans, universe folders, exports and run sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.schemas import BAR, conform, require_columns

CSV_COLUMNS = ["symbol", "timestamp", "open", "high", "low", "close", "volume"]


def _headers(spark: SparkSession, path: str, names: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by header, a header being a line that holds exactly ``names`` in any order; a file without one is an error."""
    told = F.transform(F.split("value", ","), lambda c: F.trim(c))
    wanted = F.array(*[F.lit(n) for n in sorted(names)])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.when(F.sort_array(told) == wanted, told).alias("header"))
    found = lines.groupBy("file").agg(F.collect_set("header").alias("headers")).collect()
    out: dict[tuple[str, ...], list[str]] = {}
    for row in found:
        if len(row["headers"]) != 1:
            raise ValueError(f"CSV header must hold exactly {names}: {row['file']}")
        out.setdefault(tuple(row["headers"][0]), []).append(row["file"])
    if not out:
        raise ValueError(f"{path} is empty")
    return out


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV files whose headers hold exactly the seven columns, each file in an order of its own.

    Values are read as text by name and cast strictly, so a bad date or number
    fails the job instead of turning into NULL. Blank lines are skipped.
    """
    parts = []
    for header, files in sorted(_headers(spark, path, CSV_COLUMNS).items()):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        parts.append(spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
                     .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(files))
    rows = reduce(DataFrame.unionByName, parts)
    day = F.when(F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date("timestamp", "yyyy-MM-dd")) \
        .otherwise(F.raise_error(F.concat(F.lit("bad date: "), F.coalesce("timestamp", F.lit("NULL")))).cast("date"))
    return rows.select(
        F.trim("symbol").alias("symbol"), day.alias("date"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("long").alias("volume"))


def read_price_dir(spark: SparkSession, folder: str, pattern: str = "*_1d.csv") -> DataFrame:
    """All per-symbol CSVs of a folder; the symbol is the file stem before ``_``."""
    schema = T.StructType([
        T.StructField("ts", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
        T.StructField("volume", T.DoubleType())])
    files = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST") \
        .option("pathGlobFilter", pattern).csv(folder)
    symbol = F.regexp_extract(F.col("_metadata.file_name"), r"^([^_]+)_", 1)
    named = files.select(symbol.alias("symbol"), F.to_date("ts").alias("date"), "open", "high", "low", "close", "volume")
    return conform(named, BAR)


def to_simulation_format(df: DataFrame, ts: str = "date") -> DataFrame:
    """ts as text, whole volumes, symbol last."""
    require_columns(df, ["symbol", ts, "open", "high", "low", "close", "volume"])
    return df.select(F.col(ts).cast("string").alias("ts"), "open", "high", "low", "close",
                     F.col("volume").cast("long").alias("volume"), "symbol")


def write_bars(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per symbol, as zstd Parquet or CSV with header."""
    out = to_simulation_format(df) if "ts" not in df.columns else df
    # Rebalancing gathers a symbol's rows, so that no task opens a file for every
    # symbol, and splits the oversized ones.
    spread = out.hint("rebalance", F.col("symbol"))
    writer = spread.write.mode(mode).partitionBy("symbol")
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def bars_in_range(df: DataFrame, start, end, date: str = "date") -> DataFrame:
    """Bars with start <= date <= end; the filter reaches the scan."""
    kind = df.schema[date].dataType
    return df.filter(F.col(date).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def time_bounds(df: DataFrame, date: str = "date") -> DataFrame:
    """Earliest and latest time in epoch nanoseconds; 0 when there are no bars."""
    nanos = lambda c: F.coalesce(F.unix_micros(c.cast("timestamp")) * 1000, F.lit(0))
    return df.agg(nanos(F.min(date)).alias("earliest"), nanos(F.max(date)).alias("latest"))


def write_run(fills: DataFrame, equity: DataFrame, metrics: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Trades and equity as CSV, metrics as JSON."""
    trades = fills.withColumnRenamed("ts", "timestamp")
    order = ["order_id", "symbol", "side", "price", "quantity", "timestamp", "commission", "slippage_bps"]
    require_columns(trades, order, "fills")
    trades.select(*order).write.mode(mode).option("header", True).csv(f"{folder}/trades")
    time = next(c for c in ("timestamp", "ts", "date") if c in equity.columns)
    equity.select(F.col(time).alias("timestamp"), "equity").write.mode(mode).option("header", True) \
        .csv(f"{folder}/equity")
    metrics.write.mode(mode).json(f"{folder}/metrics")


def save_study(study: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> str:
    """Write a study's tables and a short Markdown summary; returns the summary.

    Only one-row tables and the per-quantile summary (as many rows as buckets)
    reach the driver.
    """
    for key, name in (("quintile_returns", "quintile_returns"), ("ic_by_period", "ic_by_period")):
        study[key].write.mode(mode).option("header", True).csv(f"{folder}/{name}")
    period = next(c for c in study["long_short"].columns if c not in
                  ("top_mean", "bottom_mean", "spread", "cumulative_spread", "drawdown"))
    study["long_short"].select(period, "spread", "cumulative_spread").write.mode(mode).option("header", True) \
        .csv(f"{folder}/long_short_equity")
    for key in ("meta", "ic_summary", "spread_summary", "quintile_summary", "top_by_year"):
        study[key].write.mode(mode).json(f"{folder}/{key}")
    spark = study["meta"].sparkSession
    load = lambda key: spark.read.json(f"{folder}/{key}").collect()
    text = _summary(load("meta")[0], load("quintile_summary"), load("ic_summary")[0], load("spread_summary")[0])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/summary_md")
    return text


def _summary(meta, buckets: Sequence, ic, spread) -> str:
    rows = [
        f"| Q{r['quantile']} | {r['avg_return']:.3f}% | {_std(r):.3f}% | {r['hit_rate_pct']:.1f}% | {r['total_count']} |"
        for r in sorted(buckets, key=lambda r: r["quantile"])]
    return "\n".join([
        f"# {meta['feature']} against {meta['forward_col']}", "",
        f"{meta['n_periods']} periods every {meta['rebalance_days']} rows ({meta['periods_per_year']} a year), "
        f"{meta['n_symbols']} symbols, {meta['n_observations']} observations, "
        f"{meta['first_period']} to {meta['last_period']}.", "",
        "| Bucket | Mean | Deviation | Hit rate | Rows |", "|---|--:|--:|--:|--:|", *rows, "",
        f"Top minus bottom: {spread['mean_spread']:.3f}% a period, Sharpe {spread['sharpe']:.2f}, "
        f"deepest fall {spread['max_drawdown_pct']:.1f} points.", "",
        f"Information coefficient: mean {ic['pearson_ic_mean']:.4f}, deviation {ic['pearson_ic_std']:.4f}, "
        f"ratio {ic['pearson_ic_ir']:.3f}, t {ic['ic_t_stat']:.2f} over {ic['n_ic_periods']} periods, "
        f"positive in {ic['ic_positive_pct']:.1f}%.", ""])


def _std(row) -> float:
    return row.asDict().get("std_return") or 0.0
