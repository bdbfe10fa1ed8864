"""Connected components of an edge list, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.runtime import cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
        least.select("a", F.col("m").alias("b"))
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every end of an edge; the component is its least node.

    Alternates large-star and small-star until the edges form stars. Each round is
    written to the shared checkpoint folder, so lost executors cost no more than a round;
    only two numbers a round reach the driver. Null ends and self-loops link nothing
    (a self-loop's node is its own component); repeated edges count once; an empty edge
    list gives an empty result.
    """
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stars = cut(given.where("a <> b").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        stars = cut(_small_star(_large_star(stars)).where("a <> b").distinct())
        now = stars.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
    return nodes.join(stars, nodes["node"] == stars["a"], "left").select(
        "node", F.coalesce(F.col("b"), F.col("node")).alias("component")
    )
