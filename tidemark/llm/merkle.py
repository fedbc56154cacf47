"""Merkle manifests: a hash for every row, a tree of arity 16 for every group, and one over the groups' roots.

The place of a row in its group, written in digits to the base 16, is its way down the tree. Rows of ``16 ** DIGITS`` places
meet in one task as a block; there the digits are grouped away one after the other, each time nesting the children as an
array of structs, until the block is one row that holds its subtree. The blocks' hashes are the leaves of the tree above, which
is built the same way. Proofs come out of a block by transforming each array into (child, what its siblings hash to on either
side) and exploding it; no row is joined with another for that. Only a block, one row in 4 096, is joined with its way further up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.files import shared_folder, written
from tidemark.llm.numbered import numbered
from tidemark.operators.ordered import join_safe

ARITY, DIGITS = 16, 3
BLOCK = ARITY ** DIGITS


def hashed(c: Column | str) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(c, 256)


def leaf(columns: Sequence[Column | str]) -> Column:
    """Hash of a row: of each value its UTF-8 byte count, a colon and the value; ``-`` for a null."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return hashed(F.concat(*parts))


def fold(path: Column | str, start: Column | str) -> Column:
    """The root that ``start`` and the siblings of a path lead to."""
    return F.aggregate(path, F.col(start) if isinstance(start, str) else start, lambda h, s: hashed(F.concat(s["left"], h, s["right"])))


def proof_digest(path: Column | str) -> Column:
    """Hash of all siblings of a path, from the leaf to the root and from left to right."""
    return hashed(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def _step(children: str, at: Column) -> Column:
    digests = F.col(f"{children}.digest")
    return F.struct(F.array_join(F.slice(digests, F.lit(1), at), "").alias("left"),
                    F.array_join(F.slice(digests, at + 2, F.lit(ARITY)), "").alias("right"))


_EMPTY = "array<struct<left:string,right:string>>"


def grow(nodes: DataFrame, by: Sequence[str], folder: str) -> tuple[list[DataFrame], DataFrame]:
    """Trees over ``nodes`` (by, _pos, _n, digest and more), one for each group: tables of nested blocks from the lowest up, and (by, root).

    The height of a tree is that at which one node remains; a group of one node has no level. Every level hashes runs of 16, the last of
    which may be shorter.
    """
    more = [c for c in nodes.columns if c not in (*by, "_pos", "_n", "digest")]
    keys = [f"_d{k}" for k in range(1, DIGITS + 1)]
    digits = [F.floor(F.col("_pos") / F.lit(ARITY ** k)).cast("long").alias(d) for k, d in enumerate(keys, 1)]
    level = nodes.select(*by, "_n", *digits, F.struct(F.col("_pos").alias("at"), "digest", *more).alias("_child"))
    # A block is met in one task; no grouping below deals rows again.
    level = level.repartition(*by, keys[-1])
    for k in range(DIGITS):
        met = level.groupBy(*by, "_n", *keys[k:]).agg(F.array_sort(F.collect_list("_child")).alias("_children"))
        joined = hashed(F.array_join("_children.digest", ""))
        digest = F.when(F.col("_n") > ARITY ** k, joined).otherwise(F.col("_children")[0]["digest"])
        node = F.struct(F.col(keys[k]).alias("at"), digest.alias("digest"), F.col("_children").alias("children"))
        level = met.select(*by, "_n", *keys[k:], node.alias("_child"))
    blocks = written(level.withColumnRenamed(keys[-1], "_block"), f"{folder}/blocks")
    heads = blocks.select(*by, F.col("_block").alias("_pos"), F.ceil(F.col("_n") / F.lit(BLOCK)).cast("long").alias("_n"), F.col("_child.digest").alias("digest"))
    if heads.filter("_n > 1").limit(1).count():
        above, roots = grow(heads, by, f"{folder}/above")
        return [blocks, *above], roots
    return [blocks], heads.select(*by, F.col("digest").alias("root"))


def proofs(blocks: list[DataFrame], by: Sequence[str], ways: DataFrame) -> DataFrame:
    """The nodes ``blocks`` were grown from, with ``path``: an array of (left, right) from the node to the root.

    ``ways`` (by, path and more) has one row for each group: what its paths go on with behind the group's root, and columns to hand on.
    """
    extra = [c for c in ways.columns if c not in (*by, "path")]
    for table in reversed(blocks):
        keys = [*by, "_block"] if "_block" in ways.columns else list(by)
        rows = join_safe(table, ways, keys).select(*by, *extra, "_n", F.col("path").alias("_path"), F.col("_child.children").alias("_c"))
        for k in reversed(range(DIGITS)):
            beside = F.when(F.col("_n") > ARITY ** k, F.array(_step("_c", F.col("_i")))).otherwise(F.array().cast(_EMPTY))
            one = rows.select(*by, *extra, "_n", "_path", "_c", F.posexplode("_c").alias("_i", "_one"))
            rows = one.select(*by, *extra, "_n", F.concat(beside, "_path").alias("_path"), F.col("_one.children").alias("_c") if k else F.col("_one"))
        ways = rows.select(*by, *extra, F.col("_path").alias("path"), F.col("_one.at").alias("_block"), *[
            F.col(f"_one.{c}") for c in rows.schema["_one"].dataType.names if c != "at" and (table is blocks[0])])
    return ways.withColumnRenamed("_block", "_pos")


def manifest(docs: DataFrame, columns: Sequence[str], by: str, order: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """Per row its ``by`` and ``order`` values, leaf, subroot, root and path; with ``changed`` also ``changed_leaf``.

    ``columns`` go into the leaf, in that order. Leaves of a group ascend by ``order`` (null first, then by leaf); groups
    ascend by ``by`` (null first, UTF-8 bytes), and their roots are the leaves of the tree above. ``changed`` maps columns to
    what a changed copy holds instead; its leaf stands beside the path of the original. Rows may repeat; each has a leaf.
    Other columns are ignored, an empty table gives no rows.
    """
    folder = shared_folder(docs.sparkSession, "merkle")
    leaves = [leaf(columns).alias("digest")]
    if changed:
        leaves.append(leaf([changed.get(c, F.col(c)) for c in columns]).alias("changed_leaf"))
    narrow = written(docs.select(F.col(by).alias("_by"), F.col(order).alias("_order"), *leaves), f"{folder}/leaves")
    blocks, subroots = grow(numbered(narrow, ["_by"], ["_order", "digest"], f"{folder}/places"), ["_by"], f"{folder}/trees")
    groups = written(subroots.select(F.lit(0).alias("_all"), "_by", F.col("root").alias("digest")), f"{folder}/groups")
    above, root = grow(numbered(groups, ["_all"], ["_by"], f"{folder}/group_places"), ["_all"], f"{folder}/top")
    ways = proofs(above, ["_all"], root.withColumn("path", F.array().cast(_EMPTY)))
    rows = proofs(blocks, ["_by"], ways.select("_by", F.col("digest").alias("subroot"), "root", "path"))
    return rows.select(F.col("_by").alias(by), F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path",
                       *(["changed_leaf"] if changed else []))
