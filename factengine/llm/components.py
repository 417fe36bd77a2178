"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from factengine.llm.common import materialise


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the least neighbour ``m`` of their ``u``. The join is on a hash beside ``u``, so that both sides are
    dealt out for the join itself and a hub's edges can be split; on ``u`` alone they would stay as the sums left them."""
    keyed = lambda df: df.withColumn("h", F.xxhash64("u"))
    return keyed(edges).join(keyed(least), ["h", "u"]).drop("h")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = _with_least(down, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` as a written table, with their number and the sum of their hashes, counted while they are written."""
    seen = Observation()
    table = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")), "edges")
    return table, (seen.get["n"], seen.get["mark"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges(u, v)``; the component is its least node.

    Each round is two hash aggregations and two joins; its result is a written table, so the lineage stays short. Hubs
    are aggregated with partial sums on the map side, and adaptive skew joins split them. An empty input gives no rows.
    """
    edges, state = _stored(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if not state[0]:
            break
        before = state
        edges, state = _stored(_small_star(_large_star(edges)))
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
