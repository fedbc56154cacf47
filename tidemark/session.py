"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        # The streaming jobs keep lists and timers, which only this store has.
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    The cluster's own ``spark.checkpoint.dir`` wins. Only a local session with
    none set gets a scratch folder; on a cluster a missing folder is an error,
    since a machine-local one would not survive a lost executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    sc.setCheckpointDir(named)
    return named


_scopes: list[list[DataFrame]] = []


@contextmanager
def scope():
    """Releases what jobs kept inside it, and nothing else, when it closes.

    ``with scope(): study = signal_study(...); study["meta"].write...`` leaves no cache entry of the study behind, while
    tables the caller has cached stay. Scopes nest; what was kept belongs to the innermost one.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            df.unpersist()


def reused(df: DataFrame) -> DataFrame:
    """Keep an intermediate that several branches of one job read.

    Two-pass operators (ranks, running totals over cells) read their input twice;
    stacked, they would recompute it exponentially often. Kept rows spill to disk
    and are recomputed from lineage when an executor is lost. A ``scope`` releases
    them; outside of one they stay until ``spark.catalog.clearCache()``.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _scopes:
        _scopes[-1].append(kept)
    return kept
