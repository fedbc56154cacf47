"""Sharding by vector bin packing: bytes, tokens and rows of all shards are balanced together.

Equal texts form a group. A group with more than a share of 1 / (shards * PIECES) of all bytes, tokens or rows is cut into
pieces by its rows' ids, so that no text, however often copied, outgrows a shard; all others stay whole and are dealt over
BUNDLES * shards bundles by their hash. Pieces and bundles are the items to pack. There are at most (6 * PIECES + BUNDLES) * shards
of them whatever the size of the table, so their sums may pass through the driver; nothing else does. Items are placed by
descending largest share, each in the shard whose residual capacity has the greatest dot product with it. Then items are moved or swapped between
the fullest and the emptiest shard as long as that evens out bytes. A row finds its shard by its text's hash and its id alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.files import shared_folder, written

SHARDS = 40
PIECES, BUNDLES = 4, 200
ROW_BYTES = 16       # what a row takes besides its text
CELL_BYTES = 64 << 20
TURNS = 5000         # moves and swaps that even out bytes, at most


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def separators(text: Column) -> Column:
    """Spaces and line ends and one more: an estimate of tokens that takes no tokenizer."""
    left = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.coalesce(F.octet_length(text) - F.octet_length(left), F.lit(0)).cast("long") + 1


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every item; a row of ``items`` is its share of each total."""
    need = items * shards
    free, out = np.ones((shards, items.shape[1])), np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -need.max(axis=1, initial=0))):
        out[i] = np.argmax(free @ need[i])
        free[out[i]] -= need[i]
    return out


def even_out(size: np.ndarray, shard: np.ndarray, shards: int, turns: int = TURNS) -> np.ndarray:
    """Moves an item of the fullest shard to the emptiest one, or swaps two, while their difference shrinks.

    A shard that can give nothing more, such as one with a single huge item, is left aside.
    """
    shard = shard.copy()
    load = np.bincount(shard, size, shards)
    done = np.zeros(shards, bool)
    for _ in range(turns):
        high, low = int(np.where(done, -1, load).argmax()), int(load.argmin())
        own, other = np.flatnonzero(shard == high), np.flatnonzero(shard == low)
        gap = load[high] - load[low]
        # What goes over is best half the gap; an item of size 0 stands for a plain move.
        back = np.concatenate([[0], size[other]])
        order = np.argsort(back, kind="stable")
        want = size[own] - gap / 2
        at = np.searchsorted(back[order], want)
        pairs = np.concatenate([np.stack([np.arange(len(own)), order[np.clip(at + d, 0, len(back) - 1)]]) for d in (-1, 0)], axis=1)
        moved = size[own[pairs[0]]] - back[pairs[1]]
        best = int(np.abs(moved - gap / 2).argmin()) if len(moved) else -1
        if best < 0 or not 0 < moved[best] < gap:
            done[high] = True
            if done.all():
                break
            continue
        shard[own[pairs[0, best]]] = low
        if pairs[1, best]:
            shard[other[pairs[1, best] - 1]] = high
        load[high] -= moved[best]
        load[low] += moved[best]
    return shard


def write_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """Writes ``docs`` as ``shards`` folders below the shared folder and returns the table read back from them.

    Its columns are ``doc``, a struct of all columns given, ``slot``, a row's place in its shard from 0 on without gaps, and ``shard``.
    A shard is packed by bytes (the text's UTF-8 bytes, none for null, and 16), tokens (``tokens``, else separators) and rows.
    Equal texts, told by 64-bit hashes, lie in one shard unless they make a hot group; null counts as a text of its
    own kind, an empty text as another. Repeated rows all stay; copies of a hot text that also share their id share a piece. Shards may be empty
    where there are fewer items than shards; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "shards")
    text = F.col(f"doc.{text_col}")
    given = docs.select(F.struct("*").alias("doc"), *([] if tokens is None else [tokens.alias("_tokens")]))
    rows = given.select("doc", F.xxhash64(text, text.isNull()).alias("key"), F.xxhash64(F.col(f"doc.{id_col}"), F.lit(1)).alias("mark"),
                        size_of(text).alias("bytes"), (separators(text) if tokens is None else F.coalesce("_tokens", F.lit(0)).cast("long")).alias("tokens"))
    narrow = written(rows.drop("doc"), f"{folder}/sizes")
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = [max(x or 0, 1) for x in narrow.agg(*sums).first()]
    share = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(("bytes", "tokens", "rows"), total)])
    hot = narrow.groupBy("key").agg(*sums).withColumn("share", share).filter(F.col("share") * shards * PIECES > 1).select("key", "share").collect()
    bundles, first, known = shards * BUNDLES, shards * BUNDLES, []
    for r in sorted(hot):
        pieces = int(np.ceil(r.share * shards * PIECES))
        known.append((r.key, pieces, first))
        first += pieces
    # At most 3 * shards * PIECES groups are hot.
    groups = F.broadcast(spark.createDataFrame(known, "key long, pieces long, first long"))

    def with_item(df: DataFrame) -> DataFrame:
        plain = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(bundles))
        return df.join(groups, "key", "left").withColumn("item", F.coalesce(F.col("first") + F.pmod("mark", "pieces"), plain).cast("long")).drop("pieces", "first")

    items = with_item(narrow).groupBy("item").agg(*sums).orderBy("item").collect()
    sizes = np.array([[r.bytes, r.tokens, r.rows] for r in items], np.float64).reshape(-1, 3)
    chosen = even_out(sizes[:, 0], place(sizes / np.array(total, np.float64), shards), shards)
    homes = F.broadcast(spark.createDataFrame([(r.item, int(s)) for r, s in zip(items, chosen)], "item long, shard int"))
    # A shard is written by tasks of about CELL_BYTES, dealt by hashes, so a repeated task deals alike. Slots follow cells.
    cells = max(1, -(-total[0] // (CELL_BYTES * shards)))

    def with_cell(df: DataFrame) -> DataFrame:
        return with_item(df).join(homes, "item").withColumn("cell", F.pmod(F.xxhash64("key", "mark"), F.lit(cells)).cast("int"))

    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (with_cell(narrow).groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    place_in = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "mark"))
    dealt = with_cell(rows).join(starts, ["shard", "cell"]).select("doc", (F.col("start") + place_in - 1).alias("slot"), "shard")
    dealt.write.partitionBy("shard").parquet(f"{folder}/shards")
    return spark.read.schema(dealt.schema).parquet(f"{folder}/shards")
