"""Ranks and exact quantiles inside groups of any size.

Ranks go by ranges of (group, value, tie). Average ranks and quantiles shuffle on
(group, value cell), where only one count per cell is ordered over a whole group;
equal values collapse first, and quantiles touch just the cells that hold the wanted
ranks. So neither a huge group nor a hot value gathers in one task. A NULL among
the grouping columns is a group like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import value_cell
from tidemark.operators.ordered import join_safe
from tidemark.session import reused


def _cell_starts(keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return (
        keyed.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_size"))
        .select(*by, "_cell", "_size",
                (F.sum("_size").over(upto) - F.col("_size")).alias("_start"),
                F.sum("_size").over(whole).alias("_n"))
    )


_IN_PART = (1 << 33) - 1


def ordinal_rank(df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str],
                 out: str = "_rank", n_out: str = "_n") -> DataFrame:
    """1-based ascending rank with ties broken by ``tie``, and the group size.

    Rows are dealt by ranges of (group, value, tie), with bounds that Spark draws from the rows themselves, so neither a
    large group nor a value that a whole group shares meets in one task. Only a count per group and task is ordered over
    a group. The dealt rows are kept, since bounds must not change between counting and ranking. A NULL in ``by`` is a
    group like others; rows without a value have no rank and are left out; rows equal in ``tie`` too are ordered arbitrarily.
    """
    keys = [*by, value, *tie]
    dealt = df.filter(F.col(value).isNotNull()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = reused(dealt.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_IN_PART)))
    counts = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_low"))
    group = Window.partitionBy(*by, F.lit(0))
    past = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_part", (F.coalesce(F.sum("_size").over(past), F.lit(0)) - F.col("_low") + 1).alias("_shift"),
                           F.sum("_size").over(group).alias(n_out))
    return join_safe(rows, starts, [*by, "_part"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out), n_out)


def average_ranks(df: DataFrame, by: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """1-based ascending ranks where equal values share their mean rank.

    ``columns`` maps output names to value columns. Equal values collapse to one
    row on the map side before anything is ordered. Rows without a value have no
    rank and are left out.
    """
    out = df
    for name, value in columns.items():
        ties = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_size")).withColumn("_cell", value_cell(value))
        starts = (
            ties.groupBy(*by, "_cell").agg(F.sum("_size").alias("_total"))
            .select(*by, "_cell", F.coalesce(F.sum("_total").over(
                Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0)).alias("_start"))
        )
        upto = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        ranked = join_safe(ties.withColumn("_upto", F.sum("_size").over(upto)), starts, [*by, "_cell"], "inner").select(
            *by, value, (F.col("_start") + F.col("_upto") - (F.col("_size") - 1) / F.lit(2.0)).alias(name))
        out = join_safe(out, ranked, [*by, value], "inner")
    return out.select(*df.columns, *columns)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
                    interpolation: str = "linear") -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probs``.

    ``interpolation`` is ``linear`` (between the two closest ranks) or
    ``nearest``. An empty ``by`` gives one row for the whole table.
    """
    keys = list(by) or ["_all"]
    rows = df.filter(F.col(value).isNotNull())
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    keyed = rows.select(*keys, F.col(value).cast("double").alias("_v"), value_cell(value).alias("_cell"))
    starts = _cell_starts(keyed, keys)

    def target(p: float) -> Column:
        h = (F.col("_n") - 1) * F.lit(float(p))
        return F.floor(h + 0.5) if interpolation == "nearest" else h

    ends = [e for p in probs.values() for e in (F.floor(target(p)), F.ceil(target(p)))]
    inside = [(F.col("_start") <= e) & (e < F.col("_start") + F.col("_size")) for e in ends]
    wanted = inside[0]
    for cond in inside[1:]:
        wanted = wanted | cond
    # At most two cells per group and probability survive this filter.
    cells = starts.filter(wanted)
    upto = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ladder = (
        keyed.join(cells.select(*keys, "_cell", "_start", "_n"), [*keys, "_cell"])
        .groupBy(*keys, "_cell", "_start", "_n", "_v").agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_hi", F.col("_start") + F.sum("_copies").over(upto))
        .withColumn("_lo", F.col("_hi") - F.col("_copies"))
    )

    def at(e: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= e) & (e < F.col("_hi")), F.col("_v")))

    picks = []
    for name, p in probs.items():
        h = target(p)
        low, high = at(F.floor(h)), at(F.ceil(h))
        share = F.max(h - F.floor(h))
        picks.append((low + (high - low) * share).alias(name))
    result = ladder.groupBy(*keys).agg(*picks)
    return result if by else result.drop("_all")
