"""Near-duplicate documents by Jaccard similarity of word shingles, with Bayesian pruning of candidates.

Documents with the same words in the same order form a class; one signature of 128 min-hash values stands for it. Classes
that agree in all values of a band are candidates. A candidate pair's values are compared a few at a time and the pair is
dropped once the posterior probability that its similarity reaches the threshold falls below a tolerance. What is left
links classes into groups, and inside each group the pairs left are verified on their exact shingle sets.

No pair ever becomes a row: members of a bucket or group are packed into blocks, blocks are compared inside a task, and
what leaves it is a count for each class and a star of edges for each connected part. Large buckets and groups are cut
into blocks that meet pairwise, so every pair is looked at in a task of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.components import components
from tidemark.llm.files import shared_folder, written
from tidemark.llm.text import Words, mix, runs, shingles, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, PER_BAND = 32, 4
HASHES = BANDS * PER_BAND
STEP = 16             # values compared before the posterior is looked at again
TOLERANCE = 1e-6
BLOCK = 1024          # signatures that meet in one task
VERIFY_BLOCK = 512    # shingle sets that meet in one task

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
_FACTORS = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = _SEEDS.astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """By number of steps: the fewest equal values for which a pair stays.

    With a uniform prior, m of n equal values leave P(similarity >= t) = sum over j <= m of C(n+1, j) t^j (1-t)^(n+1-j).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out.append(m)
                break
        else:
            out.append(n)
    return np.array(out)


def signatures(value: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n by HASHES 16-bit min-hash values; zeros for documents without shingles. ``doc`` ascends."""
    out = np.zeros((n, HASHES), np.uint16)
    if len(value):
        small = (value >> np.uint64(32)).astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                least = np.minimum.reduceat((small ^ _SHIFTS[k]) * _FACTORS[k], at)
                out[doc[at], k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def text_class(w: Words) -> np.ndarray:
    """64-bit hash of each document's word sequence."""
    n = len(w.first) - 1
    out = np.zeros(n, np.uint64)
    some = np.flatnonzero(np.diff(w.first))
    if len(some):
        with np.errstate(over="ignore"):
            place = (np.arange(len(w.hash)) - w.first[w.doc]).astype(np.uint64)
            out[some] = mix(np.add.reduceat(mix(w.hash + mix(place)), w.first[some]) + np.diff(w.first)[some].astype(np.uint64))
    return out


def surviving(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (rows of a by rows of b) outlast the incremental comparison."""
    alive = np.ones((len(a), len(b)), bool)
    equal = np.zeros((len(a), len(b)), np.int16)
    for s, need in enumerate(least):
        cut = slice(s * STEP, (s + 1) * STEP)
        i, j = np.nonzero(alive)
        if len(i) * 4 < alive.size:
            # Few are left: compare those alone, in bounded pieces.
            for at in range(0, len(i), 1 << 16):
                p, q = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
                equal[p, q] += (a[p, cut] == b[q, cut]).sum(1, dtype=np.int16)
        else:
            for k in range(cut.start, cut.stop):
                equal += a[:, k, None] == b[None, :, k]
        alive &= equal >= need
        if not alive.any():
            break
    return alive


def star_edges(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each linked member to the smallest of its connected part. Rows are ``left`` members, columns ``right``."""
    ids, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    row, col = np.nonzero(linked)
    if not len(row):
        return []
    x, y = where[row], where[len(left) + col]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    used = np.unique(np.concatenate([x, y]))
    used = used[label[used] != used]
    return list(zip(ids[used].tolist(), ids[label[used]].tolist()))


def _met(blocks: DataFrame, keys: list[str], members: str) -> DataFrame:
    """Rows (left, right) of blocks that meet: every block with itself (right null) and each two blocks of a key once.

    ``blocks`` has the keys, ``blocks`` (their number), ``block`` and the packed members. Keys of one block pass as they are.
    """
    one = blocks.filter("blocks = 1").select(F.col(members).alias("left"), F.lit(None).cast(blocks.schema[members].dataType).alias("right"))
    many = (blocks.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .groupBy(*keys, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
            .agg(F.sort_array(F.collect_list(F.struct("block", F.col(members).alias("m")))).alias("two"))
            .select(F.col("two")[0]["m"].alias("left"), F.when(F.size("two") > 1, F.get(F.col("two"), F.lit(1))["m"]).alias("right")))
    # Meetings of full blocks are the heavy ones: one task each.
    return one.unionByName(many.repartition(F.xxhash64(F.col("left")[0], F.col("right")[0])))


def _bands(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, HASHES)


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, class, bands): key hashes the text; class and bands are null without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("class", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "text"):
            w = words(part.column(2))
            value, doc, _ = shingles(w, SHINGLE)
            sig = signatures(value, doc, part.num_rows).view(np.int64)
            some = np.diff(w.first) > 0
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some) * BANDS]).astype(np.int32)),
                                             pa.array(sig[some].ravel()), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text_class(w).view(np.int64), mask=~some), bands], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, key long, class long, bands array<bigint>")


def candidate_edges(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Star edges (a, b) of the classes that candidate pairs left by the pruning connect. ``classes`` has class, bands."""
    spread = classes.select("class", F.posexplode("bands").alias("band", "value"))
    bucket = ["band", "value"]
    sizes = (spread.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("sum"),
                                         F.min("class").alias("lo"), F.max("class").alias("hi")).filter("n > 1"))
    # Buckets of the same members, as near copies have in most bands, are looked at once.
    sizes = (sizes.groupBy("n", "sum", "lo", "hi").agg(F.min(F.struct(*bucket)).alias("b"))
             .select("b.*", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    members = (spread.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
               .join(classes, "class"))
    packed = members.groupBy(*bucket, "blocks", "block").agg(F.collect_list(F.struct("class", "bands")).alias("members"))
    need = least_matches(threshold, tolerance)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: set[tuple[int, int]] = set()
            for left, right in zip(batch.column(0), batch.column(1)):
                a = left.values
                ids, sig = a.field(0).to_numpy(), _bands(a.field(1))
                if right.is_valid:
                    b = right.values
                    edges.update(star_edges(surviving(sig, _bands(b.field(1)), need), ids, b.field(0).to_numpy()))
                elif len(ids) == 2:
                    if surviving(sig[:1], sig[1:], need)[0, 0]:
                        edges.add((int(ids.max()), int(ids.min())))
                else:
                    edges.update(star_edges(np.triu(surviving(sig, sig, need), 1), ids, ids))
            pairs = np.array(sorted(edges), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return _met(packed, bucket, "members").mapInArrow(compare, "a long, b long").distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the wanted pairs (rows of left, rows of right) of sets given as sorted arrays."""
    value = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    known, where, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times > 1
    width = int(shared.sum())
    if len(pairs) * 4e-5 < len(left) * len(right) * width * 1e-10 or width == 0:
        return np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in pairs], np.int64).reshape(-1)
    column = (np.cumsum(shared) - 1)[where]
    keep = shared[where]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, width, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        held = np.zeros((len(left) + len(right), min(4096, width - at)), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        total += held[:len(left)] @ held[len(left):].T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def verified(docs: DataFrame, wanted: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per class of ``wanted`` (doc_id, key, class, size, component) and meeting of blocks: (class, links, other).

    ``links`` counts documents of other classes of the component whose exact similarity reaches the threshold;
    ``other`` is a class it is connected to by such links, or itself.
    """
    need = least_matches(threshold, tolerance)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("text"))
    rows = (wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
            .select("class", "size", "component", "blocks", "text"))
    shape = pa.schema([("class", pa.int64()), ("size", pa.int64()), ("component", pa.int64()), ("blocks", pa.int32()),
                       ("bands", pa.list_(pa.int64())), ("grams", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "text"):
            w = words(part.column(4))
            value, doc, _ = shingles(w, SHINGLE)
            sig = signatures(value, doc, part.num_rows).view(np.int64)
            edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
            sets = [np.unique(value[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(list(sig), pa.list_(pa.int64())), pa.array(sets, pa.binary())], schema=shape)

    # Repeated rows bring one class several times: any of them will do.
    sets = (rows.mapInArrow(read, "class long, size long, component long, blocks int, bands array<bigint>, grams binary")
            .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")))
    packed = sets.groupBy("component", "blocks", "block").agg(F.collect_list(F.struct("class", "size", "bands", "grams")).alias("members"))

    def load(scalar):
        members = scalar.values
        ids, at = np.unique(members.field(0).to_numpy(), return_index=True)
        sets = members.field(3)
        return ids, members.field(1).to_numpy()[at], _bands(members.field(2))[at], [np.frombuffer(sets[i].as_py(), np.uint64) for i in at.tolist()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                ids, size, sig, sets = load(left)
                ids2, size2, sig2, sets2 = load(right) if right.is_valid else (ids, size, sig, sets)
                alive = surviving(sig, sig2, need)
                if not right.is_valid:
                    alive = np.triu(alive, 1)
                pairs = np.argwhere(alive)
                linked = np.zeros(alive.shape, bool)
                if len(pairs):
                    both = _overlaps(sets, sets2, pairs)
                    n, n2 = np.array([len(s) for s in sets]), np.array([len(s) for s in sets2])
                    union = n[pairs[:, 0]] + n2[pairs[:, 1]] - both
                    good = pairs[both >= threshold * union - 1e-9]
                    linked[good[:, 0], good[:, 1]] = True
                out: dict[int, list[int]] = {int(c): [0, int(c)] for c in np.concatenate([ids, ids2])}
                for c, k in zip(ids.tolist(), (linked @ size2).tolist()):
                    out[c][0] += k
                for c, k in zip(ids2.tolist(), (size @ linked).tolist()):
                    out[c][0] += k
                for a, b in star_edges(linked, ids, ids2):
                    out[a][1] = b
                yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array([v[0] for v in out.values()], pa.int64()),
                                                  pa.array([v[1] for v in out.values()], pa.int64())], ["class", "links", "other"])

    return _met(packed, ["component"], "members").mapInArrow(compare, "class long, links long, other long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, key (hash of the text), class_id, n_links, first.

    ``n_links`` counts the other documents whose shingle sets reach ``threshold``; ``class_id`` is the smallest doc_id of
    all documents reachable over such links; ``first`` marks the row of the class to keep: the smallest (doc_id, key),
    null ids last. Texts of one to four words have one shingle of all their words. Null, empty and wordless texts are
    linked to nothing: class_id is their own id and first is true. Repeated rows are copies of each other; rows that
    agree in id and text are both first if one is. A class of rows without ids has no class_id. Other columns are ignored.
    """
    folder = shared_folder(docs.sparkSession, "jaccard")
    signed = written(_signed(docs, id_col, text_col), f"{folder}/signed")
    own = signed.filter(F.col("class").isNotNull())
    # A class is represented by one of its rows; equal classes have equal bands.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    classes = written(own.groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("row"), F.first("bands").alias("bands")),
                      f"{folder}/classes")
    edges = written(candidate_edges(classes.select("class", "bands"), threshold, tolerance), f"{folder}/edges")
    groups = components(edges)
    parts = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / VERIFY_BLOCK).cast("int").alias("blocks"))
    wanted = (classes.select("class", "size", "row.doc_id", "row.key").join(groups.withColumnRenamed("id", "class"), "class")
              .join(parts, "component"))
    found = written(verified(docs, wanted, threshold, tolerance, id_col, text_col), f"{folder}/verified")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    linked = components(found.filter("other <> class").select(F.col("class").alias("a"), F.col("other").alias("b")))
    placed = (classes.select("class", "size", "row").join(links, "class", "left").join(linked.withColumnRenamed("id", "class"), "class", "left")
              .select("class", "size", "row", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("component")))
    placed = written(placed, f"{folder}/placed")
    heads = placed.groupBy("component").agg(F.min("row").alias("head"))
    known = placed.join(heads, "component").select("class", (F.col("size") - 1 + F.col("links")).alias("n_links"), "head")
    joined = signed.select("doc_id", "key", "class").join(known, "class", "left")
    alone = F.col("class").isNull()
    return joined.select(
        "doc_id", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("key") == F.col("head.key")))).alias("first"))
