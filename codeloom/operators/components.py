"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every endpoint; a component is named by its smallest id.

    Alternates large-star and small-star steps, each an aggregation and a join on the vertex, until the edges no longer
    change; every round is checkpointed to the shared folder. A hub's edges are spread by adaptive skew joins. Null
    endpoints are dropped; loops make a component of one; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    ids = clean.select("u").union(clean.select("v")).distinct()
    current = clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = None
    while True:  # the number of rounds grows with the logarithm of the longest path
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("x"), "m", "u")
        current = small.select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        sums = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (sums["n"], sums["h"]) == state:
            break
        state = (sums["n"], sums["h"])
    roots = current.groupBy("u").agg(F.min("v").alias("component"))
    return ids.join(roots, "u", "left").select(F.col("u").alias("id"), F.coalesce("component", "u").alias("component"))
