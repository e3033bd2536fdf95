"""Measures of answers and rankings, over tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def answer_tokens(text: Column) -> Column:
    """Lower-case words without punctuation and articles."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin("a", "an", "the", "and"))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the bags of words of two texts; 0 where either has none."""
    p, g = answer_tokens(prediction), answer_tokens(gold)
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(F.transform(F.array_distinct(p), lambda w: F.least(count(p, w), count(g, w))), F.lit(0), lambda s, x: s + x)
    return F.when(common > 0, 2.0 * common / (F.size(p) + F.size(g))).otherwise(0.0)


def multi_hop_f1(prediction: Column, gold: Column) -> Column:
    """Mean F1 over the parts of the gold answer between commas."""
    parts = F.filter(F.transform(F.split(gold, ","), F.trim), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.aggregate(F.transform(parts, lambda x: token_f1(prediction, x)), F.lit(0.0), lambda s, x: s + x) / F.size(parts)).otherwise(0.0)


def contains_answer(context: Column, gold: Column) -> Column:
    """Whether the normalised gold answer stands in the normalised context."""
    g = F.array_join(answer_tokens(gold), " ")
    return F.when(g == "", False).otherwise(F.contains(F.concat(F.lit(" "), F.array_join(answer_tokens(context), " "), F.lit(" ")), g))


def ranking_measures(ranked: DataFrame, relevant: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """(query, recall, ndcg, mrr, hit) at ``k`` of every query that has a relevant item; ranks begin at 1.

    Gains are 1; an item that a ranking repeats counts each time for NDCG, once for recall.
    """
    wanted = relevant.select(query, item).distinct()
    sizes = wanted.groupBy(query).agg(F.count("*").alias("n"))
    hits = ranked.where(F.col(rank) <= k).join(wanted, [query, item])
    found = hits.groupBy(query).agg(F.count_distinct(item).alias("found"), F.sum(1.0 / F.log2(F.col(rank) + 1.0)).alias("dcg"), F.min(rank).alias("first"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), lambda i: 1.0 / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    joined = sizes.join(found, query, "left")
    zero = F.lit(0.0)
    return joined.select(query, F.coalesce(F.col("found") / F.col("n"), zero).alias("recall"), F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"), F.coalesce(1.0 / F.col("first"), zero).alias("mrr"), F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit"))


def summary(measures: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means of the measures by rollup of ``by``, with the number of rows."""
    return measures.rollup(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def upper_median(rows: DataFrame, column: str) -> Column:
    """The middle value of a column, the upper one of two, as a scalar: found by counting values, so no task holds them all."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    n = counted.agg(F.coalesce(F.sum("c"), F.lit(0))).scalar()
    ordered = counted.withColumn("upto", F.sum("c").over(W.orderBy("v")))
    return ordered.where(F.col("upto") > F.floor(n / 2)).agg(F.min("v")).scalar()


def recall_summary(ranks: DataFrame, rank: str, tokens: str) -> DataFrame:
    """One row: queries, hit_1, hit_5, mrr and the upper median of tokens; a null rank is a miss."""
    share = lambda k: F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0))
    counted = ranks.agg(F.count("*").alias("queries"), share(1).alias("hit_1"), share(5).alias("hit_5"), F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"))
    return counted.withColumn("tokens_p50", upper_median(ranks, tokens))


def contains_at(ranked: DataFrame, gold: DataFrame, query: str, content: str, answer: str, rank: str, ks: tuple[int, ...]) -> DataFrame:
    """(query, at_k for each k): whether the answer stands in one of the first k contents; every query of ``gold`` has a row."""
    first = ranked.join(gold, query).where(contains_answer(F.col(content), F.col(answer))).groupBy(query).agg(F.min(rank).alias("__first"))
    joined = gold.join(first, query, "left")
    return joined.select(query, *[F.coalesce(F.col("__first") <= k, F.lit(False)).alias(f"at_{k}") for k in ks])


def moving_average(rows: DataFrame, per: str, at: str, tie: str, value: str, share: float) -> DataFrame:
    """(per, ema): the exponential moving average after the last row of each group; it begins at 0.

    A sum of weighted values, so rows are combined before the shuffle that adds them up; only their places are counted in order.
    """
    back = W.partitionBy(per).orderBy(F.col(at).desc(), F.col(tie).desc())
    placed = rows.withColumn("__back", F.row_number().over(back) - 1)
    return placed.groupBy(per).agg(F.sum(F.col(value) * share * F.pow(F.lit(1 - share), F.col("__back"))).alias("ema"))


def judged(reply: Column) -> Column:
    """1 for a reply of a judge that says CORRECT, 0 for one that says WRONG or neither; the last of both words counts."""
    words = F.regexp_extract_all(F.upper(reply), F.lit(r"\b(CORRECT|WRONG|INCORRECT)\b"), F.lit(1))
    return F.when(F.coalesce(F.try_element_at(words, F.lit(-1)) == "CORRECT", F.lit(False)), 1.0).otherwise(0.0)


def evidence_hits(recalled: DataFrame, evidence: DataFrame, query: str, content: str, text: str) -> DataFrame:
    """(query, found, total): how many pieces of evidence stand in what was recalled, by all their words in a row."""
    wanted = evidence.where(F.size(answer_tokens(F.col(text))) > 0).select(query, text).distinct()
    hits = wanted.join(recalled.select(query, content), query).where(contains_answer(F.col(content), F.col(text))).select(query, text).distinct().groupBy(query).agg(F.count("*").alias("found"))
    totals = wanted.groupBy(query).agg(F.count("*").alias("total"))
    return totals.join(hits, query, "left").select(query, F.coalesce("found", F.lit(0)).alias("found"), "total")
