"""Connected components on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, drop_shuffles, materialize


#: A node of more than this share of all edges is a hub: there are 2 / HUB of them at most.
HUB, LEAST_HUB = 1 / 50_000, 200


def _joined(edges: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """``edges`` (u, v) with u's row of ``least`` (u, m, n: its edges), a written table. Edges of the hubs, which are
    few by their definition, meet a broadcast table where they lie; the others are joined by a
    shuffle in which no node has more than ``limit`` rows."""
    if least.where(F.col("n") > limit).isEmpty():
        return edges.join(least.select("u", "m"), "u").select("u", "v", "m")
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", F.col("m").alias("hub_m")))  # 2 / HUB rows at most
    marked = edges.join(hubs, "u", "left")
    own = marked.where("hub_m is null").select("u", "v").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return own.select("u", "v", "m").unionByName(marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node and component (its least reachable node) for every node of ``edges`` (a, b).

    Alternates the large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond"): each round links every node to the
    least neighbour of its neighbourhood, until all edges are stars. Edge lists
    never grow, a hub's edges stay spread over all tasks, and each half of a round is written to
    the shared folder, as are its least neighbours, so that no plan holds another step's: the driver
    keeps few stages at a time, whatever their number of tasks. Rounds grow with the logarithm of the longest path; an edge list
    that doesn't settle in ``rounds`` of them is an error.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "stars")
    mark = _mark(now)
    if mark[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        limit = max(LEAST_HUB, int(mark[0] * HUB))
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "stars-near")
        large = materialize(_joined(both.where("v > u"), near, limit).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars-large")
        discard(near, now)
        near = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "stars-near")
        small = _joined(large, near, limit).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "stars")
        discard(near, large)
        drop_shuffles(now.sparkSession)
        was, mark = mark, _mark(now)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(stars: DataFrame) -> tuple:
    """Count and order-free digest of the edges, to see whether a round changed them."""
    row = stars.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]
