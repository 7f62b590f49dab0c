"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.operators.joins import attach
from inkspark.plans.lineage import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b", salts: int = 16, most_rounds: int = 60, hot: int = 10_000) -> DataFrame:
    """(node, component) of every node of an undirected graph; a component is named by its least node.

    Alternating large-star and small-star steps: each round is a pre-aggregated minimum per node and a join with it, and the
    number of rounds is logarithmic in practice, whatever the diameter. The edges of a hub of more than ``hot`` are joined with
    its minimum in ``salts`` tasks. Each round is a table in the shared folder, and the one before is removed. Null ends are no
    ends; loops keep a node. An empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = first = cut(e.distinct())
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def with_least(x: DataFrame, most: int) -> DataFrame:
        least = x.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        return attach(x, least, "u", ["v"], "n", most, salts=salts, hot=hot).select("u", "v", "m")

    state, n = None, 2 * first.count()
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        x = with_least(large, n)
        small = x.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        before, e = e, cut(small.select("e.u", "e.v").where("u <> v").distinct())
        drop(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state, n = now, 2 * now[0]
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    least = e.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(least, nodes.node == least.u, "left").select("node", F.coalesce("v", "node").alias("component"))
