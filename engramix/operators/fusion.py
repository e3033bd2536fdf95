"""Rank fusion, rescaling, diversification and packing of scored rows."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.functions.text import word_set

# Weights of the tiers and the tier of each kind.
TIERS = {"semantic": 1.0, "procedural": 0.9, "episodic": 0.7, "knowledge": 0.5, "provenance": 0.4}
KINDS = {"fact": "semantic", "topic": "semantic", "procedure": "procedural", "episode": "episodic", "observation": "knowledge", "chunk": "knowledge", "artifact": "knowledge", "entity": "knowledge", "message": "provenance", "action": "provenance", "session": "provenance"}


def tier_of(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.lower(label))


def tier_weight(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), tier_of(label))


def rrf(ranked: DataFrame, per: list[str], lists: str, item: str, score: str = "score", k: float = 60.0, base: int = 1, weight: str | None = None) -> DataFrame:
    """(per, item, fused): sum over the lists of weight / (k + rank), where ranks begin at ``base`` (0 or 1).

    Within a list, higher scores come first and equal ones by item; null and NaN scores take no part.
    """
    rank = F.row_number().over(W.partitionBy(*per, lists).orderBy(F.round(score, 9).desc(), item)) - 1 + base
    usable = ranked.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    share = (F.col(weight) if weight else F.lit(1.0)) / (k + rank)
    return usable.withColumn("__share", share).groupBy(*per, item).agg(F.sum("__share").alias("fused"))


def minmax(scored: DataFrame, per: list[str], score: str = "score", epsilon: float = 1e-12) -> DataFrame:
    """``scored`` with ``normal``: (s - min) / (max - min) within a group, s itself where all are equal.

    Extremes are aggregated before the shuffle, so a hot group isn't gathered.
    """
    ends = scored.groupBy(*per).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    spread = F.col("__hi") - F.col("__lo")
    return scored.join(ends, per).withColumn("normal", F.when(spread > epsilon, (F.col(score) - F.col("__lo")) / spread).otherwise(F.col(score))).drop("__lo", "__hi")


def maxsim_band(scored: DataFrame, per: list[str], late: str, ceiling: float = 1.0, floor: float = 0.5) -> DataFrame:
    """``scored`` with ``banded``: items with a late-interaction score fill [floor, ceiling], the others stay below the floor in their order."""
    tops = scored.groupBy(*per).agg(F.max(late).alias("__top"), F.max("score").alias("__best"))
    banded = F.when(F.col(late).isNotNull() & (F.col("__top") > 0), floor + (ceiling - floor) * F.col(late) / F.col("__top")).otherwise(floor * 0.999 * F.col("score") / F.nullif(F.col("__best"), F.lit(0.0)))
    return scored.join(tops, per).withColumn("banded", F.coalesce(banded, F.lit(0.0))).drop("__top", "__best")


def mmr(items: DataFrame, per: str, item: str, content: str, score: str = "score", trade: float = 0.7, duplicate: float = 0.85, limit: int = 50, pool: int = 500) -> DataFrame:
    """(per, item, position): greedy maximal marginal relevance by Jaccard overlap of word sets.

    An item whose overlap with a chosen one exceeds ``duplicate`` is dropped; equal gains keep the order of
    scores. Candidates are read in that order, ``pool`` at a time, and further ones whenever one of them could still
    win or too few are left; no more of a group is held than that takes.
    """
    ordered = items.select(F.col(per).alias("per"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"), word_set(F.coalesce(F.col(content), F.lit(""))).alias("words"))
    ordered = ordered.repartition("per").sortWithinPartitions("per", F.round("score", 9).desc(), "item")

    def rows(batches):
        for batch in batches:
            for p, i, s, w in zip(batch["per"], batch["item"], batch["score"], batch["words"]):
                yield None if pd.isna(p) else p, i, s, frozenset(w)

    def overlap(a: frozenset, b: frozenset) -> float:
        union = len(a | b)
        return len(a & b) / union if union else 0.0

    def pick(group):
        """Items in order of choice; ``alive`` are [item, score, words, rank, greatest overlap], and ``last`` the least score read."""
        chosen: list = []
        taken: list[frozenset] = []
        alive: list[list] = []
        read, last, more = 0, float("inf"), True
        while len(chosen) < limit:
            best = max(alive, key=lambda x: (trade * x[1] - (1 - trade) * x[4], -x[3]), default=None)
            while more and (best is None or not trade * best[1] - (1 - trade) * best[4] > trade * (last + 1e-9)):
                part = list(itertools.islice(group, pool))
                more = len(part) == pool
                for _, i, s, w in part:
                    near = max((overlap(w, c) for c in taken), default=0.0)
                    if near <= duplicate:
                        alive.append([i, s, w, read, near])
                    read, last = read + 1, s
                best = max(alive, key=lambda x: (trade * x[1] - (1 - trade) * x[4], -x[3]), default=None)
            if best is None:
                break
            chosen.append(best[0])
            taken.append(best[2])
            keep = []
            for x in alive:
                if x is not best:
                    x[4] = max(x[4], overlap(best[2], x[2]))
                    if x[4] <= duplicate:
                        keep.append(x)
            alive = keep
        return chosen

    def run(batches):
        for p, group in itertools.groupby(rows(batches), key=lambda x: x[0]):
            chosen = pick(group)
            yield pd.DataFrame({"per": [p] * len(chosen), "item": chosen, "position": range(1, len(chosen) + 1)})

    kinds = {n: items.schema[c].dataType.simpleString() for n, c in (("per", per), ("item", item))}
    return ordered.mapInPandas(run, f"per {kinds['per']}, item {kinds['item']}, position int").toDF(per, item, "position")


def pack(items: DataFrame, per: str, item: str, tokens: str, score: str = "score", limit: int = 20, budget: int = 2000) -> DataFrame:
    """(per, item, tokens): the ``limit`` best items of each group, less those that overflow the budget when their turn comes.

    An oversized item is skipped and later ones still fit, so this is a fold, not a running sum.
    """
    best = items.withColumn("__rank", F.row_number().over(W.partitionBy(per).orderBy(F.round(score, 9).desc(), item))).where(F.col("__rank") <= limit)
    listed = best.groupBy(per).agg(F.array_sort(F.collect_list(F.struct("__rank", F.col(item).alias("item"), F.col(tokens).cast("long").alias("t")))).alias("all"))
    kind = f"struct<left:bigint,kept:array<struct<item:{items.schema[item].dataType.simpleString()},t:bigint>>>"
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().alias("kept")).cast(kind)
    step = lambda acc, x: F.when(x["t"] <= acc["left"], F.struct((acc["left"] - x["t"]).alias("left"), F.concat(acc["kept"], F.array(F.struct(x["item"].alias("item"), x["t"].alias("t")))).alias("kept")).cast(kind)).otherwise(acc)
    return listed.select(per, F.explode(F.aggregate("all", start, step)["kept"]).alias("k")).select(per, F.col("k.item").alias(item), F.col("k.t").alias("tokens"))


def coverage(items: DataFrame, per: str, tier: str, score: str = "score", facets: int = 3) -> DataFrame:
    """(per, coverage): 0.4 of the facets found, 0.3 of the mean score and 0.3 of the distinct tiers of five."""
    found = F.least(F.count("*") / F.lit(float(facets)), F.lit(1.0))
    mean = F.least(F.greatest(F.avg(score), F.lit(0.0)), F.lit(1.0))
    return items.groupBy(per).agg((0.4 * found + 0.3 * mean + 0.3 * F.count_distinct(tier) / 5).alias("coverage"))
