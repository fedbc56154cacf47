"""Positions of rows in groups of any size, by ranges instead of a window over a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.files import written
from tidemark.operators.ordered import join_safe

_IN_PART = (1 << 33) - 1


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], folder: str, out: str = "_pos", n_out: str = "_n") -> DataFrame:
    """``df`` with the 0-based place of every row in its group, in ascending ``order`` (nulls first), and the group's size.

    Rows are dealt by ranges of (by, order) and written to ``folder`` with their place in their task, so that a lost
    executor cannot change ranges. Only one count per task and group is ordered over a group: as many rows as tasks. Nulls
    in ``by`` are a group. Rows equal in ``by`` and ``order`` are ordered arbitrarily but once. Give a narrow table: dealing by ranges reads it twice.
    """
    keys = [*by, *order]
    kept = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), folder)
    parts = kept.withColumn("_part", F.shiftright("_id", 33)).withColumn("_id", F.col("_id").bitwiseAND(F.lit(_IN_PART)))
    counts = parts.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_low"))
    group = Window.partitionBy(*by, F.lit(0))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).alias("_shift"),
                           F.sum("_rows").over(group).alias(n_out))
    return join_safe(parts, starts, [*by, "_part"]).select(*df.columns, (F.col("_id") + F.col("_shift")).alias(out), n_out)
