"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcmetrics.llm.store import BROADCAST_BYTES, stored

#: Bytes of a node and its least neighbour, and rows of them that one task writes at least.
_ROW_BYTES, TASK_ROWS = 16, 1 << 16


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` rows in no more tasks than they are worth: a task costs the driver more
    memory than a few rows cost the task."""
    return rows.coalesce(max(2 * rows.sparkSession.sparkContext.defaultParallelism, most // TASK_ROWS))


def _with_least(edges: DataFrame, least: DataFrame, nodes: int) -> DataFrame:
    """Adds ``m`` of ``least(a, m)``, which has up to ``nodes`` rows."""
    return edges.join(F.broadcast(least) if nodes * _ROW_BYTES <= BROADCAST_BYTES else least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the least node reachable.
    Loops and repeated edges are allowed; no edges give no rows. The result is stored.

    Each round moves links towards the least node and is stored. It ends when all links are
    stars around their least node, that is, when no node with a lesser neighbour has another
    one, after a number of rounds that grows with the logarithm of the nodes."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct())
    links = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree"))
        around = around.select("a", F.least("low", "a").alias("m"), F.expr("low < a AND degree > 1").alias("open"))
        around = stored(_dealt(around, 2 * links))
        nodes, unsettled = around.agg(F.count("*"), F.count_if("open")).first()
        if not unsettled:
            return around.select(F.col("a").alias("node"), F.col("m").alias("root"))
        # large star: greater neighbours to the least one
        large = _with_least(both.filter("b > a"), around.drop("open"), nodes).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its lesser neighbours, which all links of ``large`` lead to, to the least one
        small = _with_least(large, _dealt(large.groupBy("a").agg(F.min("b").alias("m")), nodes), nodes)
        small = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        links += nodes  # at most: a node's lesser neighbours keep their links, and it has one itself
        edges = stored(_dealt(small.filter("a <> b").distinct(), links))
