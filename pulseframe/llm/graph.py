"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.session import ensure_checkpoint_dir


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and all its v. Partial minima are taken before the shuffle, so a node with
    very many edges costs one row per task; the join back is one that Spark splits where it is skewed."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
    return edges.join(least, edges["u"] == least["at"]).drop("at")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _least(down)
    own = found.select("u", F.col("m").alias("v"))
    return own.unionByName(found.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; ``edges`` has two columns of one type, the component is its least node.

    Each round is checkpointed in the shared folder. It ends when a round changes nothing, after O(log^2) rounds at most;
    stars, as duplicate groups mostly are, take two.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    a, b = edges.columns
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    mark = None
    for _ in range(rounds):
        now = _small_star(_large_star(now)).checkpoint()
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
