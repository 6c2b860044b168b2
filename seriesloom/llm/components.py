"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.store import stored


def connected_components(links: DataFrame) -> DataFrame:
    """Label the nodes of ``links`` (a long, b long): node, label; one label per component.

    The graph is contracted round by round: every node moves to the one of itself and its neighbours
    that comes first in an order drawn anew each round, links between merged nodes vanish, and the
    moves are applied to the labels. A star is gone in one or two rounds and a long chain shrinks by a
    constant share per round, so the number of rounds grows with the logarithm of the node count.
    Links of a hot node are combined before the shuffle. The label is some node of the component.
    """
    links = links.select("a", "b").where("a <> b").distinct()
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = stored(nodes.withColumn("label", F.col("node")), "labels", narrow=True)
    links = stored(links, "links", narrow=True)
    turn = 0
    while not links.isEmpty():
        turn += 1
        both = links.union(links.select("b", "a")).toDF("node", "other")
        ranked = F.struct(F.xxhash64(F.lit(turn), F.col("other")).alias("rank"), F.col("other").alias("to"))
        best = both.groupBy("node").agg(F.min(ranked).alias("best"))
        own = F.struct(F.xxhash64(F.lit(turn), F.col("node")).alias("rank"), F.col("node").alias("to"))
        moves = stored(best.select("node", F.least("best", own)["to"].alias("to")), "moves", narrow=True)
        labels = stored(
            labels.join(moves.toDF("label", "to"), "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")
            ),
            "labels",
            narrow=True,
        )
        links = stored(
            links.join(moves.toDF("a", "to_a"), "a")
            .join(moves.toDF("b", "to_b"), "b")
            .where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct(),
            "links",
            narrow=True,
        )
    return labels
