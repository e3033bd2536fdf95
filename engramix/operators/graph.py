"""Graph algorithms over an edge table (src, dst, etype, weight): all by joins and aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix.operators.components import components
from engramix.session import cut, discard


def directed(edges: DataFrame, direction: str = "out", etypes: list[str] | None = None) -> DataFrame:
    """(src, dst, etype, weight) seen along a direction: out, in or both."""
    kept = edges.where(F.col("etype").isin(*etypes)) if etypes is not None else edges
    turned = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "etype", "weight")
    return kept.select("src", "dst", "etype", "weight") if direction == "out" else turned if direction == "in" else kept.select("src", "dst", "etype", "weight").unionByName(turned)


def traverse(edges: DataFrame, starts: DataFrame, max_depth: int, direction: str = "out", etypes: list[str] | None = None) -> DataFrame:
    """(start, node, depth): nodes within ``max_depth`` hops of each start, with the least number of hops; the start itself isn't listed."""
    links = directed(edges, direction, etypes).select("src", "dst").distinct()
    frontier = starts.select(F.col("start"), F.col("start").alias("node"))
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        reached = frontier.join(links, frontier["node"] == links["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen, ["start", "node"], "left_anti"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
    return seen.where("depth > 0")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int, direction: str = "out", etypes: list[str] | None = None) -> DataFrame:
    """(start, goal, length) of each pair whose goal is reached; 0 where both are the same."""
    found = traverse(edges, pairs.select("start").distinct(), max_depth, direction, etypes)
    near = pairs.where("start = goal").select("start", "goal", F.lit(0).alias("length"))
    reached = found.select("start", F.col("node").alias("goal"), F.col("depth").alias("length"))
    return pairs.where("start <> goal").join(reached, ["start", "goal"]).unionByName(near)


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6, type_weights: dict[str, float] | None = None) -> DataFrame:
    """(node, score): random walk that returns to the seeds.

    An edge weighs its weight (1 if null) times that of its type; edges of weight 0 are dropped, parallel ones add up,
    and what reaches a node without outgoing edges is lost. Ends when no score moves by ``tolerance``.
    """
    weight = F.coalesce("weight", F.lit(1.0))
    if type_weights is not None:
        weight = weight * F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in type_weights.items() for x in p]), F.col("etype")), F.lit(1.0))
    summed = edges.select("src", "dst", weight.alias("w")).where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    totals = summed.groupBy("src").agg(F.sum("w").alias("total"))
    step = cut(summed.join(totals, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    seeds = seeds.select(F.col("node")).distinct()
    n = seeds.count()
    if not n:
        return seeds.withColumn("score", F.lit(0.0))
    start = cut(seeds.withColumn("score", F.lit(1.0 / n)))
    score = start
    for round_ in range(rounds):
        moved = score.join(step, score["node"] == step["src"]).select(F.col("dst").alias("node"), (F.col("score") * F.col("p") * damping).alias("s"))
        home = start.select("node", (F.col("score") * (1 - damping)).alias("s"))
        fresh = cut(moved.unionByName(home).groupBy("node").agg(F.sum("s").alias("score")))
        settled = False
        if tolerance and round_ % 5 == 4:
            moved_by = fresh.join(score.withColumnRenamed("score", "old"), "node", "full").select(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
            settled = moved_by is not None and moved_by < tolerance
        if score is not start:
            discard(score)
        score = fresh
        if settled:
            break
    return score


def activation(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int, type_weights: dict[str, float]) -> DataFrame:
    """(query, node, score): personalised PageRank for many queries at once, each from its own ``seeds`` (query, node), over edges in both directions.

    Steps are joins on the node; what a query holds is combined before each shuffle.
    """
    both = directed(edges, "both")
    weight = F.coalesce("weight", F.lit(1.0)) * F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in type_weights.items() for x in p]), F.col("etype")), F.lit(1.0))
    summed = both.select("src", "dst", weight.alias("w")).where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    totals = summed.groupBy("src").agg(F.sum("w").alias("total"))
    step = cut(summed.join(totals, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    sizes = seeds.select("query", "node").distinct().groupBy("query").agg(F.count("*").alias("n"))
    start = cut(seeds.select("query", "node").distinct().join(sizes, "query").select("query", "node", (1.0 / F.col("n")).alias("score")))
    score = start
    for _ in range(rounds):
        moved = score.join(step, score["node"] == step["src"]).select("query", F.col("dst").alias("node"), (F.col("score") * F.col("p") * damping).alias("s"))
        home = start.select("query", "node", (F.col("score") * (1 - damping)).alias("s"))
        fresh = cut(moved.unionByName(home).groupBy("query", "node").agg(F.sum("s").alias("score")))
        if score is not start:
            discard(score)
        score = fresh
    return score


def cooccurrence(mentions: DataFrame, source: str, entity: str, most: int = 200) -> DataFrame:
    """(a, b, weight), a < b: in how many sources two entities stand together.

    A source with more than ``most`` entities is split by hash into blocks of about that size; each block
    meets each other under a key of its own, so that no task holds all pairs of a source. Weights are combined before the shuffle.
    """
    pairs = mentions.where(F.col(source).isNotNull() & F.col(entity).isNotNull()).select(F.col(source).alias("s"), F.col(entity).alias("e")).distinct()
    listed = pairs.groupBy("s").agg(F.ceil(F.count("*") / most).alias("blocks"))
    placed = pairs.join(listed, "s").withColumn("at", F.pmod(F.xxhash64("e"), "blocks"))
    left = placed.select("s", "e", F.col("at").alias("i"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j"))
    right = placed.select("s", F.col("e").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), "at")).alias("i"), F.col("at").alias("j"))
    met = left.join(right, ["s", "i", "j"]).where("i < j or e < b")
    return met.groupBy(F.least("e", "b").alias("a"), F.greatest("e", "b").alias("b")).agg(F.count("*").alias("weight"))


def label_propagation(edges: DataFrame, rounds: int = 20, largest: int = 50_000) -> DataFrame:
    """(node, label): communities of a weighted undirected graph (a, b, weight).

    Nodes take turns in order, each taking the label with the greatest weight among its neighbours, on ties the
    smallest; ends when a whole pass changes nothing, at the latest after ``rounds``. Components of up to ``largest`` nodes are
    settled by one task each; larger ones by joins, with the same labels: a pass is repeated for all nodes at once, with the
    fresh labels of smaller neighbours, until they stand still, which only the sequential result does.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("weight").cast("double").alias("w")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), F.col("weight").cast("double").alias("w"))))
    parts = cut(components(both.select(F.col("u").alias("id")), both.select(F.col("u").alias("src"), F.col("v").alias("dst"))))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    kind = both.schema["u"].dataType.simpleString()

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(group["u"]))
        at = {n: i for i, n in enumerate(nodes)}
        near: list[list[tuple[int, float]]] = [[] for _ in nodes]
        for u, v, w in zip(group["u"], group["v"], group["w"]):
            near[at[u]].append((at[v], w))
        label = list(range(len(nodes)))
        for _ in range(rounds):
            changed = False
            for i, links in enumerate(near):
                tally: dict[int, float] = {}
                for j, w in links:
                    tally[label[j]] = tally.get(label[j], 0.0) + w
                if tally:
                    best = min(tally, key=lambda k: (-tally[k], k))
                    changed |= best != label[i]
                    label[i] = best
            if not changed:
                break
        return pd.DataFrame({"node": nodes, "label": [nodes[k] for k in label]})

    tagged = both.join(parts, both["u"] == parts["id"]).join(sizes, "component")
    small = tagged.where(F.col("n") <= largest).groupBy("component").applyInPandas(settle, f"node {kind}, label {kind}")
    big = tagged.where(F.col("n") > largest).select("u", "v", "w")
    if big.isEmpty():
        return small
    state = cut(big.select(F.col("u").alias("node"), F.col("u").alias("old"), F.col("u").alias("label")).distinct())
    for _ in range(rounds):
        while True:
            seen = F.when(F.col("v") < F.col("u"), F.col("label")).otherwise(F.col("old"))
            tally = big.join(state, big["v"] == state["node"]).select("u", seen.alias("label"), "w").groupBy("u", "label").agg(F.sum("w").alias("w"))
            best = tally.groupBy("u").agg(F.min(F.struct(-F.col("w"), F.col("label"))).alias("m")).select(F.col("u").alias("node"), F.col("m.label").alias("fresh"))
            state = cut(state.join(best, "node").select("node", "old", F.col("fresh").alias("label"), (F.col("fresh") != F.col("label")).alias("moved")))
            if state.where("moved").isEmpty():
                break
        passed = state.where("label != old").isEmpty()
        state = state.select("node", F.col("label").alias("old"), "label")
        if passed:
            break
    return small.unionByName(state.select("node", "label"))


def descendants(parents: DataFrame, child: str, parent: str, most: int = 5) -> DataFrame:
    """(root, node, depth): every node under each node, up to ``most`` levels, itself at depth 0."""
    links = parents.where(F.col(parent).isNotNull()).select(F.col(parent).alias("p"), F.col(child).alias("c")).distinct()
    level = parents.select(F.col(child).alias("root"), F.col(child).alias("node")).distinct()
    out = level.withColumn("depth", F.lit(0))
    for depth in range(1, most + 1):
        reached = level.join(links, level["node"] == links["p"]).select("root", F.col("c").alias("node")).distinct()
        level = cut(reached.join(out, ["root", "node"], "left_anti"))
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
    return out
