"""Connected components by alternating hooking and jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix.session import cut, discard


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node is linked to, itself where it has no link.

    Each round every node takes the smallest label among its own and its neighbours' (hooking),
    and then the label of its label (jumping), so that rounds grow with the logarithm of the
    longest path. Labels are minima, combined before the shuffle: a hub that links to a third
    of all nodes sends one row per task. Links with a null end are ignored.
    """
    links = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.col(src).alias("u"), F.col(dst).alias("v"))
    links = cut(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = cut(links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("label")))
    held = state
    for _ in range(max_rounds):
        heard = links.join(state, links["v"] == state["n"]).groupBy("u").agg(F.min("label").alias("heard"))
        hooked = state.join(heard, state["n"] == heard["u"]).select("n", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        up = state.select(F.col("n").alias("p"), F.col("label").alias("up"))
        moved = cut(hooked.join(up, hooked["label"] == up["p"], "left").select("n", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        still = moved.where("label <> old").isEmpty()
        discard(held)
        held, state = moved, moved.select("n", "label")
        if still:
            break
    return nodes.select(F.col(node)).distinct().join(state, F.col(node) == F.col("n"), "left").select(F.col(node), F.coalesce("label", F.col(node)).alias("component"))
