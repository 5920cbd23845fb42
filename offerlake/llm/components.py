"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.tables import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """Give every node of the edges (`a`, `b`) the root of its component: `node`, `label`.

    Equal nodes have equal labels, and a label is one of the component's own nodes. Each
    round hangs every node below its least neighbour, jumps from there once more, and
    contracts the graph: only edges between different roots are left, each of them once.
    A node's neighbours are only counted into a minimum, never gathered, and a cluster of
    many edges is down to a few after the first round.
    """
    rest = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while rest.limit(1).count():
        both = rest.select("a", "b").union(rest.select("b", "a"))
        hung = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        above = hung.select(F.col("node").alias("up"), F.col("up").alias("top"))
        root = checkpointed(hung.join(above, "up").select("node", F.col("top").alias("root")))
        named = (F.col("node").alias("a"), F.col("root").alias("root_a")), (F.col("node").alias("b"), F.col("root").alias("root_b"))
        moved = rest.join(root.select(*named[0]), "a").join(root.select(*named[1]), "b").where("root_a <> root_b")
        rest = checkpointed(moved.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        if labels is None:
            labels = root.select("node", F.col("root").alias("label"))
        else:
            up = root.select(F.col("node").alias("label"), F.col("root").alias("next"))
            labels = labels.join(up, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        labels = checkpointed(labels)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    return labels
