"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.llm.text import mix, shingles, words

#: Labelled rows of label 0 and of label 1 that a fit reads at most, characters of both together, and of a single text.
PER_CLASS = (2000, 600)
MAX_CHARS = 8_000_000
MAX_TEXT = 200_000


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str = "doc_id", text_col: str = "text",
           per_class: tuple[int, int] = PER_CLASS, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """(text, label) of labelled rows for which ``learn`` holds, the same ones in every run.

    Each label has a share of ``max_chars`` in proportion to its ``per_class`` rows. Of each, rows are taken by their id hashes,
    smallest first, as far as their number and share go; texts over ``MAX_TEXT`` characters or over the share are passed over,
    and a text that no longer fits leaves room to the shorter ones behind it. Null labels and null or empty texts teach nothing.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & learn).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # Chosen by lengths, before any text is moved; a text is named by its id and hash.
    sizes = texts.select("_id", F.length("_text").alias("_chars"), F.xxhash64("_text").alias("_key"))
    picked = []
    for label, rows in enumerate(per_class):
        room = max_chars * rows // sum(per_class)
        fit = sizes.filter(F.col("_chars").between(1, min(MAX_TEXT, room)))
        first = (known.filter(F.col("_label") == label).join(fit, "_id").withColumn("_at", F.xxhash64("_id"))
                 .orderBy("_at", "_id", "_key").limit(rows).collect())
        for r in first:
            if r._chars <= room:
                room -= r._chars
                picked.append((r._id, r._key, label, len(picked)))
    if not picked:
        return []
    shape = StructType([StructField("_id", known.schema["_id"].dataType), StructField("_key", LongType()), StructField("_label", IntegerType()),
                        StructField("_n", IntegerType())])
    chosen = docs.sparkSession.createDataFrame(picked, shape)
    found = texts.withColumn("_key", F.xxhash64("_text")).join(F.broadcast(chosen), ["_id", "_key"]).select("_n", "_text", "_label").distinct().collect()
    return [(r._text, r._label) for r in sorted(found, key=lambda r: (r._n, r._text))]


def distinct(rows: list[tuple[str, int]], bands: int = 8, each: int = 2) -> list[tuple[str, int]]:
    """The rows without those that share a pair of min-hashes of word shingles with an earlier one of the same label.

    A group of near copies counts once, so that what its members share is no evidence by itself.
    """
    least = np.full((bands * each, len(rows)), np.iinfo(np.uint64).max, np.uint64)
    wordless = np.zeros(len(rows), bool)
    for at in range(0, len(rows), 100):
        w = words(pa.array([t for t, _ in rows[at:at + 100]], pa.large_string()))
        wordless[at:at + 100] = np.diff(w.first) == 0
        value, doc, _ = shingles(w, 5)
        for k in range(bands * each):
            np.minimum.at(least[k], at + doc, mix(value + np.uint64(k + 1)))
    seen: set[tuple] = set()
    out = []
    for d, row in enumerate(rows):
        keys = {(row[1], b, *least[b * each:(b + 1) * each, d].tolist()) for b in range(bands)}
        if seen.isdisjoint(keys) or wordless[d]:
            out.append(row)
            seen |= keys
    return out
