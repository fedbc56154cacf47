"""Exact top-k inner products over an impact-ordered index, a score at a time.

Vectors are rounded to integers. A posting says that vector v has value x in dimension d; its impact is |x|. Postings
of a shard lie in segments by descending quantised impact. A block of queries takes segment after segment and adds
q_d * x to its accumulators; what a vector may still gain or lose is bounded by the segment's largest remaining impact times
the |q_d| of the dimensions it has not been seen in. Bounds are looked at after every segment: a vector whose upper bound is
below a score that k others are known to reach cannot be a result. Once that leaves few possible results, or all segments
are through, those are scored exactly.

Shards form ranges and blocks of queries form groups; a task searches one range for one group and hands the scores it has
reached on from shard to shard. The first range is searched first and gives every other one a score to begin with.

Equal vectors share a score, so each distinct vector is indexed once; its k + 1 smallest ids suffice for any result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.files import shared_folder, written

SHARD, QUERIES = 4096, 1024
LEVELS = 16
RANGES, RANGE = 4096, 64  # a range is one shard up to so many ranges, then more, up to so many shards
GROUP = 32           # blocks of queries that a task takes
TASKS = 20_000
UNKNOWN = np.iinfo(np.int64).min
FEW = 6              # possible results for each wanted one at which exact scoring begins


def rounded(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, vec) with vec = floor(scale * x) of every component x as double.

    Null ids, null or empty vectors and those with null or non-finite components take no part.
    """
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & whole)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("vec"))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, behind a byte that tells how many."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1)


class Shard:
    """An index of up to SHARD vectors: postings (row, dim, value) by descending level of impact, and the vectors themselves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        row, dim = np.nonzero(x)
        impact = np.abs(x[row, dim])
        top = int(impact.max(initial=1))
        # Quantised impact: equal steps from the largest down.
        level = LEVELS - 1 - np.minimum(impact * LEVELS // (top + 1), LEVELS - 1)
        order = np.argsort(level, kind="stable")
        self.row, self.dim, self.value = row[order], dim[order], x[row, dim][order]
        self.edge = np.searchsorted(level[order], np.arange(LEVELS + 1))
        self.largest = np.array([impact[order][a:].max(initial=0) for a in self.edge])

    def pack(self) -> list[bytes]:
        return [_packed(a) for a in (self.ids, self.x.ravel(), self.row, self.dim, self.value, self.edge, self.largest)]

    @classmethod
    def unpack(cls, n: int, raw: list[bytes]) -> Shard:
        out = cls.__new__(cls)
        out.ids, out.x, out.row, out.dim, out.value, out.edge, out.largest = map(_unpacked, raw)
        out.ids, out.x, out.largest = out.ids.astype(np.int64), out.x.reshape(n, -1), out.largest.astype(np.int64)
        return out

    def possible(self, queries: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
        """(query, vector): which vectors may be among the k best of the shard with a score of at least ``least``."""
        n, dims = self.x.shape
        wide = max(dims, queries.shape[1])
        q = np.pad(queries, ((0, 0), (0, wide - queries.shape[1]))).T
        size = wide * float(self.largest[0]) * float(np.abs(q).max(initial=0))
        # Sums must be exact: single precision up to 2^24, double up to 2^53, else integers.
        kind = np.float32 if size < 2 ** 23 else np.float64 if size < 2 ** 52 else np.int64
        q = np.ascontiguousarray(q).astype(kind)
        weight = np.abs(q)
        # Rounding keeps the order of numbers, and sums are not rounded: none that reaches the bound falls below its image.
        floor, given = least.astype(kind), bool((least != UNKNOWN).all())
        total = np.zeros((n, q.shape[1]), kind)
        unseen = (self.x != 0).astype(kind) @ weight[:dims]
        for level in range(LEVELS):
            a, b = self.edge[level], self.edge[level + 1]
            rest = self.largest[level + 1]
            if a == b and rest:
                continue
            rows, r = np.unique(self.row[a:b], return_inverse=True)
            used, d = np.unique(self.dim[a:b], return_inverse=True)
            segment = np.zeros((len(rows), len(used)), kind)
            segment[r, d] = self.value[a:b]
            total[rows] += segment @ q[used]
            unseen[rows] -= (segment != 0).astype(kind) @ weight[used]
            slack = unseen * kind(rest)
            if not given:
                floor = np.maximum(floor, np.partition(np.ascontiguousarray((total - slack).T), n - k, axis=1)[:, n - k])
            may = total + slack >= floor
            if rest == 0 or np.count_nonzero(may) <= FEW * k * len(queries):
                break
        return np.ascontiguousarray(may.T)

    def search(self, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k best (ids, scores), best first, ties to the smaller id; only scores from ``least`` on."""
        least = np.full(len(queries), UNKNOWN) if least is None else least
        k, common, out = min(k, len(self.ids)), min(self.x.shape[1], queries.shape[1]), []
        may, x, exact = self.possible(queries, k, least), self.x[:, :common], queries[:, :common].astype(np.int64)
        for i, bound in enumerate(least.tolist()):
            at = np.flatnonzero(may[i])
            score = x[at] @ exact[i]
            best = np.lexsort((self.ids[at], -score))[:k]
            best = best[score[best] >= bound]
            out.append((self.ids[at[best]], score[best]))
        return out


def _best(shards: list[Shard], queries: np.ndarray, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """What ``search`` gives over all ``shards``; each takes over the scores that those before it have reached."""
    least, found = least.copy(), [(np.zeros(0, np.int64),) * 2] * len(queries)
    for shard in shards:
        for i, (ids, score) in enumerate(shard.search(queries, k, least)):
            if len(ids):
                ids, score = np.concatenate([found[i][0], ids]), np.concatenate([found[i][1], score])
                best = np.lexsort((ids, -score))[:k]
                found[i] = ids[best], score[best]
                if len(best) == k:
                    least[i] = max(least[i], score[best[-1]])
    return found


def build_index(vectors: DataFrame) -> DataFrame:
    """(n, parts, place): the impact-ordered index of distinct vectors (vec_id, vec), a shard per row; shards of a task share a place."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, _ in _packets(batches, SHARD):
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([Shard(ids, x).pack()], pa.list_(pa.binary()))], ["n", "parts"])

    return vectors.mapInArrow(build, "n long, parts array<binary>").withColumn("place", F.spark_partition_id())


def query_blocks(queries: DataFrame) -> DataFrame:
    """(n, parts, place): blocks of (class, vec, least), in the form of the index."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, least in _packets(batches, QUERIES):
            parts = [ids.tobytes(), _packed(x.ravel()), least.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([parts], pa.list_(pa.binary()))], ["n", "parts"])

    return queries.mapInArrow(block, "n long, parts array<binary>").withColumn("place", F.spark_partition_id())


def _packets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, third column or UNKNOWN) of up to ``size`` rows; shorter vectors get zeros behind."""
    ids, rows, least = [], [], []

    def joined():
        width = max(len(r) for r in rows)
        x = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            x[i, :len(r)] = r
        return np.array(ids, np.int64), x, np.array(least, np.int64)

    for batch in batches:
        lists = batch.column(1)
        flat, edge = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum([len(v) for v in lists])])
        third = batch.column(2).fill_null(int(UNKNOWN)).to_pylist() if batch.num_columns > 2 else [int(UNKNOWN)] * batch.num_rows
        for i, vec_id in enumerate(batch.column(0).to_pylist()):
            ids.append(vec_id)
            rows.append(flat[edge[i]:edge[i + 1]])
            least.append(third[i])
            if len(ids) == size:
                yield joined()
                ids, rows, least = [], [], []
    if ids:
        yield joined()


def _meetings(index: DataFrame, blocks: DataFrame, groups: int, ranges: tuple[int, int], k: int) -> DataFrame:
    """(class, near, score): up to k best of every class in each range from ``ranges[0]`` up to ``ranges[1]``.

    A block of queries goes once to each range and a shard once to each group. Of a range and group shards come first and are
    held, blocks go by.
    """
    first, end = ranges
    every = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    shards = index.filter(F.col("range").between(first, end - 1)).select("range", every(0, groups).alias("group"), F.lit(0).alias("kind"), "n", "parts")
    asked = blocks.select(every(first, end).alias("range"), "group", F.lit(1).alias("kind"), "n", "parts")
    cells = shards.unionByName(asked).repartition(min((end - first) * groups, TASKS), "range", "group").sortWithinPartitions("range", "group", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for *own, kind, n, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if own != cell:
                    cell, held = own, []
                raw = parts.as_py()
                if kind == 0:
                    held.append(Shard.unpack(n, raw))
                    continue
                ids, least = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[2], np.int64)
                found = _best(held, _unpacked(raw[1]).reshape(n, -1).astype(np.int64), k, least)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])),
                    pa.array(np.concatenate([f[1] for f in found]))], ["class", "near", "score"])

    return cells.mapInArrow(search, "class long, near long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows by inner product for each row of (vec_id, vec) with ``is_query``.

    Ties go to the smaller vec_id. Fewer than k candidates give fewer rows. Vectors of different lengths meet in their common
    components. Rows that repeat an id and a vector count once; equal vectors of other ids are candidates like any other.
    Nothing is left out: the index holds every vector, and only bounds prune. Scores are exact in 64 bits, so components must
    stay below 2^28.
    """
    folder = shared_folder(vectors.sparkSession, "topk")
    rows = vectors.select("vec_id", "vec").distinct()
    # The k + 1 smallest ids of equal vectors; the limit is applied before rows are dealt, so a common vector stays small.
    by = Window.partitionBy("vec").orderBy("vec_id")
    members = rows.select("vec_id", "vec", F.row_number().over(by).alias("n")).filter(F.col("n") <= k + 1)
    members = written(members, f"{folder}/members")
    own = members.filter("n = 1").select("vec_id", "vec")
    count = own.count()
    shards = max(1, -(-count // SHARD))
    wide = min(max(1, -(-shards // RANGES)), RANGE)
    index = build_index(own.repartition(shards)).withColumn("range", F.floor(F.col("place") / wide).cast("int"))
    index = written(index, f"{folder}/index")
    ranges = 1 + (index.agg(F.max("range")).first()[0] or 0)
    # A query stands for all rows of its vector.
    asked = rows.filter(is_query)
    first = members.filter("n = 1").select(F.col("vec_id").alias("class"), "vec")
    asked = written(asked.join(first, "vec").select(F.col("vec_id").alias("query_id"), "class", "vec"), f"{folder}/asked")
    kinds = asked.select("class", "vec").dropDuplicates(["class"])
    blocks = max(1, -(-kinds.count() // QUERIES))
    groups = -(-blocks // GROUP)

    def met(queries: DataFrame, first: int, end: int, name: str) -> DataFrame:
        dealt = query_blocks(queries.repartition(blocks)).withColumn("group", F.floor(F.col("place") / GROUP).cast("int"))
        return _meetings(index, written(dealt, f"{folder}/{name}_blocks"), groups, (first, end), k + 1)

    # Every query meets every shard, those of the first range first: what is reached there bounds all others.
    scored = written(met(kinds, 0, 1, "first"), f"{folder}/first")
    if ranges > 1:
        least = scored.groupBy("class").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > k).drop("n")
        scored = scored.unionByName(met(kinds.join(least, "class", "left").select("class", "vec", "least"), 1, ranges, "other"))
    best = Window.partitionBy("class").orderBy(F.desc("score"), "near")
    near = scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    # From distinct vectors to their rows, then to the queries of each vector.
    whose = members.select(F.first("vec_id").over(by).alias("near"), "vec_id")
    each = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    spread = near.join(whose, "near").withColumn("n", F.row_number().over(each)).filter(F.col("n") <= k + 1).select("class", "vec_id", "score")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.select("query_id", "class").join(spread, "class").filter("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
