"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_path, scratch_path, stored, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of the component of each node of ``edges`` (u, v; two longs).

    Each round joins every node's least neighbour to its edges, so that a star
    of any size is an aggregation and a join that can be split, never one list.
    Rounds grow with the logarithm of the nodes. Only a count and a checksum
    come to the driver. A round's edges are deleted when the next ones stand.

    Defined results: repeated edges and those of a node with itself or with null
    add nothing, and a node that has no other edge has no row; an empty table
    gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    path = scratch_path(spark, "edges")
    e, last = written(e, path), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        old, path = path, scratch_path(spark, "edges")
        e = written(small.filter("u <> v").distinct(), path)
        drop_path(spark, old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = stored(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "roots")
    drop_path(spark, path)
    return out
