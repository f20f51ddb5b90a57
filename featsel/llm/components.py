"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsel.llm.common import Scratch, written

#: Rows (two numbers each, some 16 MB) that are sent to all tasks at the most.
SENT = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges -> (node, component): the smallest node of each component, for every
    node that has an edge to another node.

    Contraction: in each round every node joins the node of least random rank among itself and
    its neighbours, and the edges are redrawn between those. The rank is a hash that changes with
    the round, so that a constant share of the nodes goes in each round whatever the shape (long
    chains and stars alike), and no neighbour list is ever gathered. A null or an edge from a node
    to itself links nothing; without edges the result is empty.
    """
    scratch = Scratch(edges.sparkSession)
    edges = written(edges.select("u", "v").where("u <> v").distinct(), scratch)
    none, steps = edges.select(F.col("u").alias("node"), F.col("v").alias("component")), []
    first = 0
    while n := edges.count():
        first = first or n
        files = max(4, n // 50_000)  # the edges only get fewer
        both = edges.select("u", "v").union(edges.select("v", "u"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("r"), F.col(c).alias("x"))
        to = both.groupBy("u").agg(F.min(rank("v")).alias("low"))
        step = written(to.select(F.col("u").alias("node"), F.least("low", rank("u"))["x"].alias("into")).coalesce(files), scratch)
        steps.append(step)
        # as many nodes as there are ends of edges, at the most: a table of proven size is sent to all tasks
        sent = F.broadcast(step) if 2 * n <= SENT else step
        to_u = sent.select(F.col("node").alias("u"), F.col("into").alias("a"))
        to_v = sent.select(F.col("node").alias("v"), F.col("into").alias("b"))
        edges = written(
            edges.join(to_u, "u").join(to_v, "v").where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().coalesce(files), scratch
        )
    if not steps:
        return none
    labels = steps[-1].select("node", F.col("into").alias("label"))
    for step in reversed(steps[:-1]):
        after = labels.select(F.col("node").alias("into"), "label")
        labels = step.join(F.broadcast(after) if 2 * first <= SENT else after, "into", "left").select("node", F.coalesce("label", "into").alias("label"))
    labels = written(labels.coalesce(max(4, first // 50_000)))
    scratch.drop()
    least = labels.groupBy("label").agg(F.min(F.least("node", "label")).alias("component"))
    return labels.join(F.broadcast(least) if 2 * first <= SENT else least, "label").select("node", "component")
