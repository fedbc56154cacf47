"""Streaming indicators, signals and positions on any bar or fill stream.

A row is answered once the watermark, ``delay`` behind the latest time seen, has passed it. Until then rows may come in any
order; what comes later than that is dropped and counted in ``late_dropped`` of its key's next rows. Rows without a time are
left out. A stream that ends holds the rows of its last ``delay``: any later row, of whatever key, lets them go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.streaming.processors import (MICROS, HysteresisProcessor, IndicatorProcessor, OrderedProcessor,
                                           PositionProcessor)

STATE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_TYPES = {"bars_above": T.LongType(), "bars_below": T.LongType(), "action": T.StringType()}


def needs_state_store(spark: SparkSession) -> None:
    """Raises unless the session keeps state in RocksDB, which these jobs need; the setting is the caller's."""
    if spark.conf.get(STATE_SETTING, "") != STATE_STORE:
        raise ValueError(f"set {STATE_SETTING} to {STATE_STORE}")


def _run(sdf: DataFrame, processor: OrderedProcessor, delay: str) -> DataFrame:
    needs_state_store(sdf.sparkSession)
    schema = T.StructType([
        T.StructField(processor.key, T.StringType()), T.StructField(processor.ts, T.TimestampType()),
        *([T.StructField(processor.seq, T.LongType())] if processor.seq else []),
        *[T.StructField(c, _TYPES.get(c, T.DoubleType())) for c in processor.outputs],
        T.StructField("late_dropped", T.LongType())])
    own = [F.col(processor.seq).cast("long").alias(processor.seq)] if processor.seq else []
    # The time goes on as a number, so that rows behind the watermark reach the processor and are counted there.
    needed = sdf.withWatermark(processor.ts, delay).filter(F.col(processor.ts).isNotNull()).select(
        F.col(processor.key).cast("string").alias(processor.key), F.unix_micros(F.col(processor.ts).cast("timestamp")).alias(MICROS), *own,
        *[F.col(c).cast("double").alias(c) for c in processor.columns])
    return needed.groupBy(processor.key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def stream_indicators(sdf: DataFrame, sma: int = 20, ema: int = 20, rsi: int = 14, bollinger: tuple = (20, 2.0),
                      macd: tuple = (12, 26, 9), atr: int = 14, key: str = "symbol", ts: str = "ts",
                      delay: str = "1 day") -> DataFrame:
    """All indicators of a bar stream, one output row per bar."""
    return _run(sdf, IndicatorProcessor(key, ts, sma, ema, rsi, bollinger, macd, atr), delay)


def stream_hysteresis(sdf: DataFrame, lookback_days: int = 63, ema_period: int = 5, upper_threshold: float = 0.02,
                      lower_threshold: float = -0.02, consecutive_bars: int = 2, key: str = "symbol",
                      ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Momentum signals of a bar stream; rows before the lookback is full drop out."""
    out = _run(sdf, HysteresisProcessor(
        key, ts, lookback_days, ema_period, upper_threshold, lower_threshold, consecutive_bars), delay)
    return out.filter("momentum is not null")


def stream_positions(sdf: DataFrame, key: str = "symbol", ts: str = "ts", delay: str = "1 day",
                     seq: str | None = "order_id") -> DataFrame:
    """Quantity, average entry and realised P&L after each fill of a stream.

    Fills of one instant are told apart and ordered by ``seq`` (None: a key has one fill per instant).
    """
    signed = F.when(F.col("side") == "Buy", F.col("quantity")).otherwise(-F.col("quantity")).cast("double")
    return _run(sdf.withColumn("signed", signed), PositionProcessor(key, ts, seq), delay)
