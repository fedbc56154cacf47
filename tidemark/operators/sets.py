"""Unions, de-duplication and per-group picks.

Picks of one row use ``min_by``/``max_by``: they combine on the map side, so a
key with a huge group of copies ships one row per task instead of all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def _common_type(types: list[T.DataType]) -> T.DataType:
    if all(t == types[0] for t in types):
        return types[0]
    if all(isinstance(t, T.IntegralType) for t in types):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in types):
        return T.TimestampType()
    return T.StringType()


def union_relaxed(*dfs: DataFrame) -> DataFrame:
    """Union by name; absent columns become NULL and types widen."""
    seen: dict[str, list[T.DataType]] = {}
    for df in dfs:
        for f in df.schema:
            if not isinstance(f.dataType, T.NullType):
                seen.setdefault(f.name, []).append(f.dataType)
    goal = {n: _common_type(ts) for n, ts in seen.items()}
    cast = [df.select(*[F.col(c).cast(goal.get(c, T.StringType())).alias(c) for c in df.columns]) for df in dfs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def _stamp(df: DataFrame, order: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])


def _picked(df: DataFrame, keys: Sequence[str], choose, order: Sequence[str | Column]) -> DataFrame:
    """Keys stay outside the chosen row, so that filters on them reach the scan."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), _stamp(df, order)).alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.{c}") for c in df.columns])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the greatest by ``order``, which should be total."""
    return _picked(df, keys, F.max_by, order)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the least by ``order``, which should be total."""
    return _picked(df, keys, F.min_by, order)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key by ``order``.

    Spark limits each task to n rows per key before the shuffle, so a hot key
    ships at most n rows per task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The latest n rows of each key."""
    return top_n(df, by, [F.col(o).desc() for o in order], n)


def latest_by(df: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """Latest row of each key, projected on the order column and ``values``."""
    rows = df.filter(F.col(order).isNotNull())
    stamp = F.struct(F.col(order), *[F.col(v) for v in values])
    best = rows.groupBy(key).agg(F.max(stamp).alias("_row"))
    return best.select(key, F.col(f"_row.{order}").alias(order), *[F.col(f"_row.{v}").alias(v) for v in values])
