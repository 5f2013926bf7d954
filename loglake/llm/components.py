"""Connected components by alternating large-star and small-star, on edges held in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.shared import discard, store


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over directed edges (u, v). Large: each larger neighbour of u goes to the least of u and its neighbours; small: so do u and the smaller.

    Neighbourhoods are never collected: the least neighbour is an aggregate and joins back to the edges, where adaptive execution splits a hub.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its least node. No edges give no rows.

    Each round is written to the shared folder, so that a lost executor costs one round at most; the round before is then deleted.
    """
    spark = edges.sparkSession
    path = store(edges.select("u", "v").filter("u != v").distinct(), "edges")
    last = None
    for _ in range(rounds):
        now = spark.read.schema("u {0}, v {0}".format(edges.schema["u"].dataType.simpleString())).parquet(path)
        step = star(star(now, large=True), large=False)
        new = store(step, "edges")
        after = spark.read.schema(now.schema).parquet(new)
        said = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(spark, path)
        path = new
        if last == (said["n"], said["h"]):
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select("v", F.col("v").alias("w"))).distinct()
        last = (said["n"], said["h"])
    raise RuntimeError(f"components did not settle in {rounds} rounds")
