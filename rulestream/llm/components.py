"""Connected components of an edge table, by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulestream.llm.common import cut


#: A round's tables are dealt over so many tasks that each has about this many of the first edges.
ROWS_PER_TASK = 200_000


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): equal roots for nodes that are connected.

    In a round every node hooks onto its smallest neighbour, hooks are followed to their ends (each
    step doubles the distance), and the edges are contracted to these ends. Only nodes without a
    smaller neighbour remain, at most half of those that still had edges, so rounds grow with the
    logarithm of the largest component; a star takes one. What a step leaves is cut into the shared
    checkpoint folder. A node with very many neighbours is pre-aggregated in the hooking and split
    by the adaptive join in the contraction.
    """
    left = cut(_clean(edges))
    tasks = max(1, -(-left.count() // ROWS_PER_TASK))
    found: DataFrame | None = None
    while True:
        hooks = left.select(F.col("a").alias("v"), F.col("a").alias("p")).union(left.select(F.col("b").alias("v"), F.col("a").alias("p")))
        ends = _followed(hooks.groupBy("v").agg(F.min("p").alias("p")), tasks)
        up = ends.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        if found is None:
            found = ends.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            found = cut(_small(found.join(up, found["root"] == up["_v"], "left").select("node", F.coalesce("_p", "root").alias("root")), tasks))
        moved = left.join(ends.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(ends.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        left = cut(_small(_clean(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), tasks))
        if left.isEmpty():
            return found


def _small(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` in no more tasks than its rows are worth: a round over few edges shouldn't cost hundreds of tasks."""
    return df.coalesce(tasks)


def _followed(hooks: DataFrame, tasks: int) -> DataFrame:
    """(v, p) with every hook replaced by where its chain of hooks ends."""
    while True:
        onward = hooks.select(F.col("v").alias("_v"), F.col("p").alias("q"))
        further = cut(_small(hooks.join(onward, hooks["p"] == onward["_v"]).select("v", "p", "q"), tasks))
        hooks = further.select("v", F.col("q").alias("p"))
        if further.where("p <> q").isEmpty():
            return hooks
