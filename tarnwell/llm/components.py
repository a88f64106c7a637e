"""Connected components of a large graph by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import durable, phase


def state(edges: DataFrame) -> Row:
    """(odd, n, most) of edges (a, b), a > b: whether any does not lead straight to a root, how many there are, and the most of one node.

    All lead straight to roots if no node has two upward edges, or one and is an end of another.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    odd = F.coalesce(F.max(F.expr("up > 1 OR up = 1 AND n > 1")), F.lit(False))
    return nodes.agg(odd.alias("odd"), F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()


#: A node of more edges than HOT_EDGES, and than twice all edges over HOT_NODES, is hot, so at most HOT_NODES are.
HOT_EDGES, HOT_NODES = 1000, 50_000


def with_value(edges: DataFrame, values: DataFrame, hot: int) -> DataFrame:
    """(a, b, m): each edge with the value of its node a. ``values`` has node, m and n, the node's edges.

    Edges of nodes with more than ``hot`` edges stay where they are and meet their few values by broadcast;
    the rest are shuffled by node, so no task gets more than ``hot`` edges of one node.
    """
    many = F.broadcast(values.where(F.col("n") > hot).select("node", "m"))
    rest = edges.join(many, F.col("a") == F.col("node"), "left_anti").join(values.where(F.col("n") <= hot).select("node", "m"), F.col("a") == F.col("node"))
    return edges.join(many, F.col("a") == F.col("node")).select("a", "b", "m").union(rest.select("a", "b", "m"))


def hot_from(n: int) -> int:
    """From how many edges a node of a graph with n edges is hot."""
    return max(HOT_EDGES, 2 * n // HOT_NODES)


def with_least(edges: DataFrame, hot: int, any_hot: bool) -> DataFrame:
    """(a, b, m): each edge with the least b of its node a, in one shuffle by node.

    With ``any_hot`` the nodes of more than ``hot`` edges get their values by broadcast, and their edges are spread over several
    groups of a window; others are one group of at most ``hot`` rows. A window spills, so a group need not fit in memory.
    """
    if not any_hot:
        return edges.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
    many = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("known"), F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    marked = edges.join(F.broadcast(many), F.col("a") == F.col("node"), "left")
    part = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / hot)))
    least = F.coalesce("known", F.min("b").over(Window.partitionBy("a", "part")))
    return marked.withColumn("part", part).select("a", "b", least.alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of its component, for each node of an edge but the roots themselves.

    Large-star and small-star steps alternate until all edges lead straight to a root; each step keeps the components,
    makes one edge of each, and the steps needed grow with the logarithm of the diameter. A round takes three shuffles: one
    by node for each step, and one that drops repeated edges.
    Each round is checkpointed; all but the last go at the end. Only one row of counts reaches the driver. No edges: no rows.
    """
    with phase(edges.sparkSession):
        now = durable(_settled(edges, a, b), stay=True)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _settled(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The edges (a, b) from each node to its root."""
    now = durable(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    while (at := state(now)).odd:
        hot = hot_from(at.n)
        any_hot = at.most > hot
        both = now.union(now.select("b", "a"))
        # Every larger neighbour is led to the least one; the node itself may be that.
        large = with_least(both, hot, any_hot).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        if any_hot:
            large = durable(large)  # its hot nodes are counted first
        # No node has more edges now than before. Each edge leads its far end to the least one, and that edge leads the node itself.
        small = with_least(large, hot, any_hot).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = durable(small.distinct())
    return now
