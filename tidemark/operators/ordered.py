"""Ordered per-key work that never needs a whole key in one task.

A window over a key sorts all of that key's rows in one task. That is fine when
the key is bounded by the calendar (one row per key and DATE: a century is
36 525 rows) and fatal when one key holds a third of a tick table. Every helper
here therefore has two plans with the same result:

* ``cell is None``: one window over the key (calendar-bounded order column);
* ``cell`` given: rows are shuffled on (key, cell), where the cell is a coarse,
  monotone image of the order column such as its minute. Only one small row per
  cell (counts, totals, last values) is ever ordered over a whole key, and the
  result is carried back into the cells by an equi-join.

Both plans are lazy and deterministic, so a lost executor only recomputes.
NULL keys form a key of their own and NULL times come first, in both plans.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from tidemark.session import reused

DAY_BOUNDED = (T.DateType,)


def cell_for(df: DataFrame, order: str, unit: str = "minute") -> Column | None:
    """No cell for a DATE order column, a time cell for a timestamp."""
    if isinstance(df.schema[order].dataType, DAY_BOUNDED):
        return None
    return F.date_trunc(unit, F.col(order))


def join_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` in which NULL matches NULL; the right side brings its other columns."""
    other = {k: f"_right_{k}" for k in keys}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(r)) for k, r in other.items()])
    return left.join(right.withColumnsRenamed(other), same, how).drop(*other.values())


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "_part") -> DataFrame:
    """``df`` with a cell that never decreases along the order of a key and holds a bounded share of the table.

    For tables whose order column says nothing about how many rows share a value, such as fills on a DATE: rows are dealt by ranges
    of (key, order), with bounds that Spark draws from the rows, and the range's number is the cell. The dealt rows are
    kept, since bounds must not change between two reads. Give an ``order`` that tells rows of a key apart.
    """
    return reused(df.repartitionByRange(*by, *order).withColumn(out, F.spark_partition_id()))


def _cells_before(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)


def positions(df: DataFrame, by: Sequence[str], order: Sequence, cell: Column | None = None,
              out: str = "_pos") -> DataFrame:
    """Dense 0-based index of every row within its key."""
    if cell is None:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return df.withColumn(out, rank.cast("long") - 1)
    keyed = df.withColumn("_cell", cell)
    starts = (
        keyed.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_size"))
        .select(*by, "_cell", F.coalesce(F.sum("_size").over(_cells_before(by)), F.lit(0)).alias("_start"))
    )
    local = Window.partitionBy(*by, "_cell").orderBy(*order)
    return (
        join_safe(keyed.withColumn("_rn", F.row_number().over(local)), starts, [*by, "_cell"])
        .withColumn(out, F.col("_start") + F.col("_rn") - 1)
        .select(*df.columns, out)
    )


def in_blocks(df: DataFrame, by: Sequence[str], before: int, after: int, size: int,
              add: Callable[[DataFrame, WindowSpec], DataFrame], pos: str = "_pos") -> DataFrame:
    """Run a bounded-frame window over blocks of ``size`` consecutive positions.

    Rows near a block edge are copied into the neighbouring block (at most
    ``before`` and ``after`` of them), so each frame is complete; the copies are
    dropped afterwards.
    """
    if size < max(before, after):
        raise ValueError("block size must cover the frame")
    own = F.floor(F.col(pos) / F.lit(size)).cast("long")
    offset = F.col(pos) % F.lit(size)
    homes = F.array_compact(F.array(
        own,
        F.when(offset >= size - before, own + 1) if before else F.lit(None).cast("long"),
        F.when((offset < after) & (own > 0), own - 1) if after else F.lit(None).cast("long"),
    ))
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(homes))
    done = add(spread, Window.partitionBy(*by, "_block").orderBy(pos))
    return done.filter(F.col("_block") == F.col("_own")).drop("_own", "_block")


def with_neighbours(df: DataFrame, by: Sequence[str], order: Sequence, before: int, after: int,
                    add: Callable[[DataFrame, WindowSpec], DataFrame],
                    cell: Column | None = None) -> DataFrame:
    """Apply ``add(df, window)`` where the frame reaches a bounded number of rows."""
    if cell is None:
        return add(df, Window.partitionBy(*by).orderBy(*order))
    indexed = positions(df, by, order, cell)
    size = max(8192, 8 * (before + after))
    return in_blocks(indexed, by, before, after, size, add).drop("_pos")


def running(df: DataFrame, by: Sequence[str], order: Sequence, aggs: dict[str, tuple[str, str]],
            cell: Column | None = None) -> DataFrame:
    """Aggregates from the key's first row up to and including the current row.

    ``aggs`` maps an output name to ``(kind, column)`` with kind one of ``sum``,
    ``count``, ``max``, ``min`` or ``last`` (last non-null value).
    """
    plain = {
        "sum": F.sum, "count": F.count, "max": F.max, "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    if cell is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[plain[k](c).over(w).alias(n) for n, (k, c) in aggs.items()])
    keyed = df.withColumn("_cell", cell)
    stamp = F.struct(*order)

    def total(kind: str, c: str) -> Column:
        if kind == "last":
            return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), stamp))
        return plain[kind](c)

    over_cells = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": plain["last"]}
    before = _cells_before(by)
    carried = (
        keyed.groupBy(*by, "_cell").agg(*[total(k, c).alias(f"_t_{n}") for n, (k, c) in aggs.items()])
        .select(*by, "_cell", *[over_cells[k](f"_t_{n}").over(before).alias(f"_c_{n}")
                                for n, (k, _) in aggs.items()])
    )
    local = Window.partitionBy(*by, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def merge(n: str, kind: str, c: str) -> Column:
        here, carry = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind == "max":
            return F.greatest(here, carry)
        if kind == "min":
            return F.least(here, carry)
        if kind == "last":
            return F.coalesce(here, carry)
        if kind == "count":
            return here + F.coalesce(carry, F.lit(0))
        return F.coalesce(here + carry, here, carry)

    here = keyed.select("*", *[plain[k](c).over(local).alias(f"_l_{n}") for n, (k, c) in aggs.items()])
    return (join_safe(here, carried, [*by, "_cell"])
            .select(*df.columns, *[merge(n, k, c).alias(n) for n, (k, c) in aggs.items()]))


def running_moments(df: DataFrame, by: Sequence[str], order: Sequence, column: str, cell: Column | None = None,
                    count: str = "_k", mean: str = "_mean", squares: str = "_m2") -> DataFrame:
    """Count, mean and sum of squared deviations from the key's first row up to and including the current one.

    With cells, the triples (n, mean, squares) of whole cells are merged in order: merging a cell into what lies before it adds its
    own squares and ``d * d * n1 * n2 / (n1 + n2)``, d being the distance of the means. All terms are at least 0, so a
    running sum of them loses no digits, and each depends on the past only: a later row never changes an earlier result.
    """
    x = F.col(column).cast("double")

    def triple(w: WindowSpec | None, name: str) -> list[Column]:
        n, m, v = F.count(x), F.avg(x), F.var_pop(x)
        if w is not None:
            n, m, v = n.over(w), m.over(w), v.over(w)
        return [n.alias(f"{name}k"), m.alias(f"{name}m"), (v * n).alias(f"{name}q")]

    upto = (Window.partitionBy(*by) if cell is None else Window.partitionBy(*by, "_cell")).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if cell is None:
        return df.select("*", *triple(upto, "_")).select(*df.columns, F.col("_k").alias(count), F.col("_m").alias(mean), F.col("_q").alias(squares))
    keyed = df.withColumn("_cell", cell)
    line = Window.partitionBy(*by).orderBy("_cell")
    past, sofar = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0)
    cells = keyed.groupBy(*by, "_cell").agg(*triple(None, "_"))
    # Means are summed as distances from the first one, which all rows behind it may know.
    cells = cells.withColumn("_zero", F.first("_m", ignorenulls=True).over(sofar)).withColumn("_d", (F.col("_m") - F.col("_zero")) * F.col("_k"))
    before = cells.select("*", F.coalesce(F.sum("_k").over(past), F.lit(0)).alias("_ck"), F.sum("_d").over(past).alias("_cd"))
    before = before.withColumn("_cm", F.when(F.col("_ck") > 0, F.col("_zero") + F.coalesce("_cd", F.lit(0.0)) / F.greatest("_ck", F.lit(1))))
    gap = F.col("_m") - F.col("_cm")
    grown = F.col("_q") + F.coalesce(gap * gap * (F.col("_k") * F.col("_ck") / F.greatest(F.col("_k") + F.col("_ck"), F.lit(1))), F.lit(0.0))
    carried = before.select(*by, "_cell", "_ck", "_cm", F.sum(grown).over(past).alias("_cq"))
    here = join_safe(keyed.select("*", *triple(upto, "_l")), carried, [*by, "_cell"])
    own, far = F.col("_lk"), F.col("_ck")
    d = F.col("_lm") - F.col("_cm")
    both = (own > 0) & (far > 0)
    total = F.greatest(own + far, F.lit(1))
    return here.select(
        *df.columns, (own + far).alias(count),
        F.when(both, F.col("_cm") + d * (own / total)).otherwise(F.coalesce("_lm", "_cm")).alias(mean),
        F.when(both, F.coalesce("_cq", F.lit(0.0)) + F.col("_lq") + d * d * (own * far / total)).otherwise(F.coalesce("_lq", "_cq")).alias(squares))


# A term decayed below this share of its weight no longer changes a double.
NEGLIGIBLE = 1e-20


def decay_scan(df: DataFrame, by: Sequence[str], specs: dict[str, tuple[Column, float]],
               pos: str = "_pos") -> DataFrame:
    """``s[t] = a * s[t-1] + b[t]`` for a constant ``0 <= a < 1``, starting from 0.

    Unrolled, ``s[t]`` is a sum of ``b`` weighted by powers of ``a``; weights
    below 1e-20 are lost to double rounding anyway, so a block needs only a
    bounded stretch of its predecessor and one running sum per block gives the
    result. Expects dense positions per key.
    """
    out = df
    pending = dict(specs)
    for name, (b, a) in list(pending.items()):
        if a < 1e-9:
            out = out.withColumn(name, b)
            del pending[name]
    while pending:
        # Group recurrences whose powers stay in range within a common block.
        slowest = max(pending.values(), key=lambda s: s[1])[1]
        halo = max(1, math.ceil(math.log(NEGLIGIBLE) / math.log(slowest)))
        size = 4 * halo
        batch = {n: s for n, s in pending.items() if -math.log(s[1]) * (size + halo) < 600}
        first = f"_base{len(pending)}"

        def add(d: DataFrame, w: WindowSpec, batch=batch, size=size, halo=halo, first=first) -> DataFrame:
            # Exponent counted from the start of the copied stretch.
            d = d.withColumn(first, (F.col(pos) - F.col("_block") * size + halo).cast("double"))
            up_to = w.rowsBetween(Window.unboundedPreceding, 0)
            for n, (b, a) in batch.items():
                power = F.pow(F.lit(a), F.col(first))
                d = d.withColumn(n, F.sum(b / power).over(up_to) * power)
            return d.drop(first)

        out = in_blocks(out, by, halo, 0, size, add, pos)
        for n in batch:
            del pending[n]
    return out


def affine_scan(df: DataFrame, by: Sequence[str], a: str, b: str, out: str, pos: str = "_pos",
                size: int = 512, levels: int = 3, before: str | None = None) -> DataFrame:
    """``s[t] = a[t] * s[t-1] + b[t]`` with a coefficient per row, starting from 0.

    Affine maps compose, so a block of rows collapses to one ``(a, b)`` pair.
    The pairs are scanned the same way one level up (each level is ``size`` times
    smaller), and every block is then replayed from its incoming state. ``before``
    names an extra output with the state ahead of each row. No task sees more than one block at any level but the last, which holds one row per
    ``size ** levels`` input rows of a key.
    """
    block = f"_block{levels}"
    blocked = df.withColumn(block, F.floor(F.col(pos) / F.lit(size)).cast("long"))
    steps = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(a).alias("a"), F.col(b).alias("b"))))
    composed = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
        lambda acc, s: F.struct((acc["a"] * s["a"]).alias("a"), (acc["b"] * s["a"] + s["b"]).alias("b")),
    )
    pairs = (
        blocked.groupBy(*by, block).agg(composed.alias("_ab"))
        .select(*by, block, F.col("_ab.a").alias("_a"), F.col("_ab.b").alias("_b"))
    )
    if levels > 1:
        states = affine_scan(pairs, by, "_a", "_b", "_state", block, size, levels - 1)
    else:
        states = _replay(pairs.withColumn("_in", F.lit(0.0)), by, "_a", "_b", "_state", block)
    incoming = states.select(*by, (F.col(block) + 1).alias(block), F.col("_state").alias("_in"))
    ready = join_safe(blocked, incoming, [*by, block]).withColumn("_in", F.coalesce("_in", F.lit(0.0)))
    outputs = [out, before] if before else [out]
    return _replay(ready, [*by, block], a, b, out, pos, before).select(*df.columns, *outputs)


def _replay(df: DataFrame, keys: Sequence[str], a: str, b: str, out: str, pos: str,
            before: str | None = None) -> DataFrame:
    """Walk one block in order from its incoming state ``_in``; the block is an array while that lasts."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).cast("long").alias("p"), F.struct(*df.columns).alias("row"))))
    packed = df.groupBy(*keys).agg(rows.alias("_rows"), F.first("_in").alias("_start"))
    none = F.array().cast("array<double>")

    def step(acc: Column, r: Column) -> Column:
        state = r["row"][a] * acc["state"] + r["row"][b]
        return F.struct(state.alias("state"), F.concat(acc["past"], F.array(acc["state"])).alias("past"),
                        F.concat(acc["states"], F.array(state)).alias("states"))

    walked = F.aggregate("_rows", F.struct(F.col("_start").cast("double").alias("state"), none.alias("past"), none.alias("states")), step)
    zipped = F.arrays_zip(F.col("_rows.row").alias("row"), F.col("_w.past").alias("past"), F.col("_w.states").alias("state"))
    flat = packed.withColumn("_w", walked).select(F.inline(zipped))
    added = [F.col("state").alias(out), *([F.col("past").alias(before)] if before else [])]
    return flat.select("row.*", *added)
