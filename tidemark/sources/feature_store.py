"""Bitemporal feature table: one Parquet folder per feature name."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.sets import keep_last
from tidemark.schemas import FEATURE, conform, require_columns

KEYS = ["symbol", "ts_available", "feature_name"]


def clean_rows(df: DataFrame) -> DataFrame:
    """Feature rows in schema order and type; rows without key or value dropped."""
    require_columns(df, FEATURE.names, "features")
    return conform(df, FEATURE).dropna(subset=[*KEYS, "feature_value"])


def upsert(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Union of both where the newer batch wins per (symbol, ts_available, feature_name)."""
    rest = [c for c in FEATURE.names if c not in KEYS]
    both = existing.withColumn("_seq", F.lit(0)).unionByName(clean_rows(batch).withColumn("_seq", F.lit(1)))
    return keep_last(both, KEYS, ["_seq", "asof_date", "source_event_id", "source", "feature_value"]) \
        .select(*KEYS, *rest).select(*FEATURE.names)


def point_query(rows: DataFrame, symbol: str, ts, names: Sequence[str] | None = None) -> DataFrame:
    """Latest row of each feature of a symbol known at ``ts``."""
    seen = rows.filter((F.col("symbol") == symbol) & (F.col("ts_available") <= F.lit(ts).cast("timestamp")))
    if names is not None:
        seen = seen.filter(F.col("feature_name").isin(list(names)))
    return keep_last(seen, ["feature_name"], ["ts_available", "asof_date", "source_event_id", "feature_value"]) \
        .select(*FEATURE.names)


def range_query(rows: DataFrame, symbols: Sequence[str], names: Sequence[str], start, end) -> DataFrame:
    """Rows of a symbol and feature set with start <= ts_available <= end, sorted."""
    when = F.col("ts_available").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return rows.filter(F.col("feature_name").isin(list(names)) & F.col("symbol").isin(list(symbols)) & when) \
        .orderBy("symbol", "ts_available")


def summary(rows: DataFrame) -> DataFrame:
    """Rows, symbols and time span per feature."""
    return rows.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"),
        F.min("ts_available").alias("min_ts"), F.max("ts_available").alias("max_ts"))


class FeatureStore:
    """Feature rows under one folder, partitioned by feature name.

    Each ``add`` appends an immutable batch folder; a read keeps the newest batch
    per key. An interrupted job therefore never damages stored rows, and
    ``compact`` folds the batches when there are many.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _write(self, rows: DataFrame, seq: int) -> None:
        path = f"{self.folder}/batch={seq:08d}"
        # Rebalancing gathers a feature's rows and splits the oversized ones.
        rows.hint("rebalance", F.col("feature_name")).sortWithinPartitions("symbol", "ts_available") \
            .write.mode("errorifexists").partitionBy("feature_name").parquet(path)

    def _batches(self) -> list[int]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
        done = [n for n in names if n.startswith("batch=") and
                fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def add(self, df: DataFrame) -> None:
        """Insert rows; a key already stored is replaced, repeats inside ``df`` collapse."""
        rows = clean_rows(df)
        once = keep_last(rows, KEYS, ["asof_date", "source_event_id", "source", "feature_value"])
        batches = self._batches()
        self._write(once.select(*FEATURE.names), (batches[-1] + 1) if batches else 0)

    def read(self, names: Sequence[str] | None = None) -> DataFrame:
        """Current rows; only the folders of the wanted features are scanned."""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], FEATURE)
        schema = T.StructType([*FEATURE.fields, T.StructField("batch", T.IntegerType())])
        rows = self.spark.read.schema(schema).option("basePath", self.folder).parquet(
            *[f"{self.folder}/batch={b:08d}" for b in batches])
        if names is not None:
            rows = rows.filter(F.col("feature_name").isin(list(names)))
        if len(batches) == 1:
            return rows.select(*FEATURE.names)
        return keep_last(rows, KEYS, ["batch"]).select(*FEATURE.names)

    def compact(self, folder: str) -> "FeatureStore":
        """Write the current rows as the single batch of a new store."""
        other = FeatureStore(self.spark, folder)
        other._write(self.read(), 0)
        return other

    def query(self, symbol: str, ts, names: Sequence[str] | None = None) -> DataFrame:
        return point_query(self.read(names), symbol, ts, names)

    def query_range(self, symbols: Sequence[str], names: Sequence[str], start, end) -> DataFrame:
        return range_query(self.read(names), symbols, names, start, end)

    def feature_names(self) -> list[str]:
        """Names of the stored features, from the folders alone."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = {s.getPath().getName() for b in self._batches() for s in fs.listStatus(path(f"{self.folder}/batch={b:08d}"))}
        return sorted(unquote(n.split("=", 1)[1]) for n in names if n.startswith("feature_name="))

    def summary(self) -> DataFrame:
        return summary(self.read())
