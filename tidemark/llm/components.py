"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.files import shared_folder, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b), the component being its smallest node.

    Large and small stars in turn: each node hands its larger neighbours, then itself and its smaller ones, to the
    smallest node it knows. The number of edges never grows, nodes with many neighbours are only joined with their one
    minimum, and every round is written to the shared folder, so a lost executor costs part of a round. Nothing is
    collected but whether a round has left chains. Self loops make a node its own component; nulls are left out.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark, "components")
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    known = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/0")
    alone = known.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    links = known.filter("a <> b")
    for turn in range(1, limit + 1):
        sides = _both(links)
        least = sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = sides.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        links = written(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
                        .filter("a <> b").distinct(), f"{folder}/{turn}")
        # Done when no node is both the end and the start of an edge, and none has two ends.
        chains = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        if not chains and not links.groupBy("a").count().filter("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    stars = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    linked = stars.union(roots)
    return linked.union(alone.join(linked.select("id"), "id", "left_anti"))
