"""Connected components of an edge table, by least labels and pointer jumps, with every round on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, stage


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(a, b) of longs -> (node, root): each node of an edge with the least node of its component.

    A round takes the least label among neighbours, hooks each root to the least label seen by its tree, and jumps
    once through the labels; rounds needed grow with the logarithm of a component's width. All exchanges carry
    pairs of longs, sums and minima are partial before the shuffle, and joins may be split where a node is hot. Labels that
    still move after ``rounds``, far beyond what any logarithm asks for, are an error, never a result.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.distinct(), "component-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "component-labels")
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        lower = labels.join(seen, "node").select("node", "root", F.least("root", "least").alias("least"))
        # A root takes the least label that any node under it has seen, so whole trees move at once.
        hooks = lower.groupBy(F.col("root").alias("node")).agg(F.min("least").alias("hook"))
        hooked = lower.join(hooks, "node", "left").select("node", "root", F.least("least", F.coalesce("hook", "least")).alias("new"))
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("further"))
        moved = stage(
            hooked.join(jump, "new", "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("further", "new")).alias("root")),
            "component-labels", done=[labels],
        )
        labels = moved.select("node", "root")
        labels.staged_at = moved.staged_at
        if moved.where("old <> root").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"components have not converged in {rounds} rounds")
