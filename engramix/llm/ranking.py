"""One ranking from several scores on unlike scales.

Each channel's score becomes its empirical percentile among the items of the query
(ties share the mean of their ranks), the percentile becomes a normal score, and items
are ordered by a weighted mean of these: no channel counts more because of its range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.session import cut

# Coefficients of Acklam's rational approximation of the inverse normal distribution.
TAIL_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416)
MID_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
MID_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
BREAK = 0.02425

#: Channels in which less is better.
DESCENDING = ("l2_distance",)
#: Normal score of an item that a channel misses: at most this, and never above the lowest that the channel can give.
FLOOR = -3.0
#: Rows of one channel of one query that a task ranks by itself; larger groups are ranked bucket by bucket.
GROUP = 200_000


def _poly(coefficients, x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution, for 0 < p < 1 (error below 2e-9)."""

    def tail(q: Column) -> Column:
        r = F.sqrt(-2 * F.ln(q))
        return _poly(TAIL_C, r) / (_poly(TAIL_D, r) * r + 1)

    q = p - 0.5
    mid = _poly(MID_A, q * q) * q / (_poly(MID_B, q * q) * q * q + 1)
    return F.when(p < BREAK, tail(p)).when(p > 1 - BREAK, -tail(1 - p)).otherwise(mid)


def lowest(n: Column, floor: float = FLOOR) -> Column:
    """The floor under a group of ``n`` items: ``floor``, or the normal score of the last of them where that is lower."""
    return F.least(F.lit(floor), inverse_normal(0.5 / n))


def normal_scores(scores: DataFrame, group: list[str], value: str) -> DataFrame:
    """``scores`` with ``z``, the normal score of ``value`` among the rows of its ``group``, and ``n``, how many these are.

    ``value`` must be neither null nor NaN. Groups of up to GROUP rows are ranked by one task each. Of larger ones equal values
    are counted first and ranked as one row each, in buckets at approximate quantiles with the sizes of the lower ones added, so that
    no task sorts a whole group, even if one holds a third of all rows or all its values are equal. The ranks are the same either way.
    """
    sizes = scores.groupBy(*group).agg(F.count("*").alias("n"))
    big = sizes.where(F.col("n") > GROUP)
    most = big.agg(F.max("n")).first()[0]
    whole = W.partitionBy(*group)
    ties = whole.orderBy(value).rangeBetween(W.currentRow, W.currentRow)
    percentile = lambda df, rank: df.withColumn("z", inverse_normal((rank - 0.5) / F.col("n")))
    few = scores if most is None else scores.join(F.broadcast(big.drop("n")), group, "left_anti")
    ranked = percentile(few.withColumn("n", F.count("*").over(whole)), F.rank().over(whole.orderBy(value)) + (F.count("*").over(ties) - 1) / 2)
    if most is None:
        return ranked
    # At most rows / GROUP groups are large, so their list and their boundaries are small.
    splits = [i / k for k in [max(2, -(-2 * most // GROUP))] for i in range(1, k)]
    many = scores.join(F.broadcast(big), group)
    values = many.groupBy(*group, "n", value).agg(F.count("*").alias("__c"))
    cuts = many.groupBy(*group).agg(F.percentile_approx(value, splits, 1000).alias("__cuts"))
    placed = values.join(F.broadcast(cuts), group).withColumn("__bucket", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    lower = whole.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    below = placed.groupBy(*group, "__bucket").agg(F.sum("__c").alias("__size")).withColumn("__below", F.coalesce(F.sum("__size").over(lower), F.lit(0))).drop("__size")
    inside = W.partitionBy(*group, "__bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    first = F.col("__below") + F.coalesce(F.sum("__c").over(inside), F.lit(0))
    scored = percentile(placed.join(below, [*group, "__bucket"]), first + (F.col("__c") + 1) / 2).select(*group, value, "n", "z")
    return ranked.unionByName(scores.join(scored, [*group, value]).select(*ranked.columns))


def fuse(scored: DataFrame, targets: DataFrame, recalled: DataFrame | None = None, floor: float = FLOOR, top: int | None = None) -> DataFrame:
    """(query_id, node_id, position, fused): one ranking of the nodes of each query.

    fused = tier weight times the mean, over all channels of the query, of z above the channel's floor (``lowest``); a channel
    that misses the node adds 0, so a node has to stand well with many channels. Scores of
    ``recalled`` (query_id, node_id, score) form one more channel. Null and NaN scores and rows
    without query, node or channel count as missing; of a hit found twice in a channel the better
    score counts; labels are compared in lower case; a label without a target weighs nothing; of
    several labels of a node the heaviest counts. Equal results are ordered by node id. ``top``
    keeps the first positions of each query. Columns other than those named are not read.
    """
    usable = F.col("score").isNotNull() & ~F.isnan("score") & F.col("query_id").isNotNull() & F.col("node_id").isNotNull()
    better = F.when(F.lower("channel").isin(*DESCENDING), -F.col("score")).otherwise(F.col("score"))
    hits = scored.where(usable & F.col("channel").isNotNull()).select("query_id", "node_id", F.lower("channel").alias("channel"), better.alias("score"))
    if recalled is not None:
        hits = hits.unionByName(recalled.where(usable).select("query_id", "node_id", F.lit("(recalled)").alias("channel"), "score"))
    hits = cut(hits.groupBy("query_id", "channel", "node_id").agg(F.max("score").alias("score")))
    z = normal_scores(hits, ["query_id", "channel"], "score")
    weights = targets.groupBy(F.lower("node_type").alias("label")).agg(F.max("tier_weight").alias("weight"))
    labels = scored.where("query_id is not null and node_id is not null").select("query_id", "node_id", F.lower(F.trim("label")).alias("label")).distinct()
    weighed = labels.join(weights, "label", "left").groupBy("query_id", "node_id").agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"))
    channels = hits.groupBy("query_id").agg(F.count_distinct("channel").alias("channels"))
    sums = z.groupBy("query_id", "node_id").agg(F.sum(F.col("z") - lowest(F.col("n"), floor)).alias("sum"))
    fused = sums.join(weighed, ["query_id", "node_id"]).join(channels, "query_id").select("query_id", "node_id", (F.col("weight") * F.col("sum") / F.col("channels")).alias("fused"))
    position = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("fused", 9).desc(), "node_id"))
    ranked = fused.withColumn("position", position)
    return ranked.where(F.col("position") <= top) if top else ranked
