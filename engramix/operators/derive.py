"""Facts from observations, and procedures, patterns, topics and summaries from what was recorded."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.functions.text import canonical_name, fact_id, laplace, object_key, visibility
from engramix.operators.temporal import millis


def votes(observations: DataFrame, subject: str = "subject", predicate: str = "predicate", obj: str = "object", at: str = "observed_at", scope: str = "visibility", count: str | None = None) -> DataFrame:
    """(s, p, scope, o, spelling, n, latest, earliest): observations with a triple, by object key and spelling."""
    n = F.sum(F.greatest(F.coalesce(F.col(count), F.lit(1)), F.lit(1))) if count else F.count("*")
    keyed = observations.where(f"{subject} is not null and {predicate} is not null").select(
        canonical_name(F.col(subject)).alias("s"), F.lower(F.trim(predicate)).alias("p"), F.coalesce(visibility(F.col(scope)), F.lit("")).alias("scope"), object_key(F.col(obj)).alias("o"), F.trim(obj).alias("spelling"), F.col(at).alias("at"), *([F.col(count)] if count else [])
    )
    return keyed.groupBy("s", "p", "scope", "o", "spelling").agg(n.alias("n"), F.max("at").alias("latest"), F.min("at").alias("earliest"))


def canonical_objects(voted: DataFrame) -> DataFrame:
    """(s, p, scope, object, votes, share_against, first_observed): the object of each triple.

    The key with most votes wins, then its commonest spelling; ties go to the later, then to the smaller text. Aggregates only:
    a subject with a third of all votes is combined before the shuffle.
    """
    def by(*names: str) -> list[Column]:
        return [F.col(n) for n in names]

    spelled = voted.where("o is not null and o <> ''")
    keys = spelled.groupBy("s", "p", "scope", "o").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"), F.min(F.struct((-F.col("n")).alias("a"), (-millis(F.col("latest"))).alias("b"), F.col("spelling"))).alias("best"))
    best = keys.groupBy("s", "p", "scope").agg(F.min(F.struct((-F.col("n")).alias("a"), (-millis(F.col("latest"))).alias("b"), F.col("o"), F.col("best.spelling").alias("spelling"), F.col("n"))).alias("w"), F.sum("n").alias("total"))
    firsts = voted.groupBy("s", "p", "scope").agg(F.min("earliest").alias("first_observed"), F.sum("n").alias("observation_count"))
    joined = firsts.join(best, ["s", "p", "scope"], "left")
    against = F.when(F.col("total") > 0, 1 - F.col("w.n") / F.col("total"))
    return joined.select(*by("s", "p", "scope"), F.col("w.spelling").alias("object"), F.coalesce("total", F.lit(0)).alias("votes"), against.alias("share_against"), "first_observed", "observation_count")


def facts(objects: DataFrame, contradiction: float = 0.40) -> DataFrame:
    """Facts with id, confidence by count, and whether other objects hold more than ``contradiction`` of the votes."""
    return objects.select(
        fact_id(F.col("s"), F.col("p"), F.col("object"), F.col("scope")).alias("fact_id"), F.col("s").alias("subject"), F.col("p").alias("predicate"), "object", "scope", "observation_count", laplace(F.col("observation_count")).alias("confidence"), "first_observed", F.coalesce(F.col("share_against") > contradiction, F.lit(False)).alias("contradicted")
    )


def cluster_objects(rows: DataFrame, per: list[str], key: str, vector: str, threshold: float = 0.88) -> DataFrame:
    """(per, key, cluster): greedy clusters of the distinct keys of a group by cosine to running-mean centroids.

    Keys are taken in order; one without vector stands alone. Groups of any size are read in order, batch
    by batch, so a task holds the centroids of a group but not its rows.
    """
    distinct = rows.where(F.col(key).isNotNull()).groupBy(*per, key).agg(F.first(vector, ignorenulls=True).alias("vector"))
    ordered = distinct.repartition(*per).sortWithinPartitions(*per, key)

    def run(batches):
        group, made, centres = None, 0, {}
        for batch in batches:
            out = []
            for *of, v in zip(*(batch[c] for c in per), batch["vector"]):
                of = tuple(None if pd.isna(c) else c for c in of)
                if of != group:
                    group, made, centres = of, 0, {}  # centres by dimension: matrix, norms, members and clusters
                x = None if v is None or not len(v) else np.asarray(v, dtype=np.float64)
                norm = 0.0 if x is None else np.linalg.norm(x)
                if not norm:
                    out.append(made)
                    made += 1
                    continue
                c, norms, n, ids = centres.setdefault(len(x), (np.zeros((8, len(x))), np.zeros(8), np.zeros(8), []))
                k = len(ids)
                sims = c[:k] @ x / np.where(norms[:k] > 0, norms[:k] * norm, 1.0)
                at = int(np.argmax(sims)) if k else -1
                if k and sims[at] >= threshold:
                    c[at] = (c[at] * n[at] + x) / (n[at] + 1)
                else:
                    at = k
                    if k == len(c):
                        c, norms, n = np.concatenate([c, np.zeros_like(c)]), np.concatenate([norms, np.zeros_like(norms)]), np.concatenate([n, np.zeros_like(n)])
                        centres[len(x)] = c, norms, n, ids
                    c[at] = x
                    ids.append(made)
                    made += 1
                n[at] += 1
                norms[at] = np.linalg.norm(c[at])
                out.append(ids[at])
            yield batch[[*per, key]].assign(cluster=out)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*per, key])
    return ordered.mapInPandas(run, f"{kinds}, cluster long")


def followed_pairs(episodes: DataFrame, agent: str, action: str, ok: Column, at: str, tie: str, max_gap_ms: int = 3_600_000, least: int = 3) -> DataFrame:
    """(agent, first_action, next_action, support): successes that directly followed each other within the gap, at least ``least`` times."""
    w = W.partitionBy(agent).orderBy(at, tie)
    linked = episodes.withColumn("__ok", ok).withColumn("__next", F.lead(action).over(w)).withColumn("__next_ok", F.lead("__ok").over(w)).withColumn("__gap", F.lead(millis(F.col(at))).over(w) - millis(F.col(at)))
    return linked.where(F.col("__ok") & F.col("__next_ok") & (F.col("__gap") <= max_gap_ms)).groupBy(agent, F.col(action).alias("first_action"), F.col("__next").alias("next_action")).agg(F.count("*").alias("support")).where(F.col("support") >= least)


def patterns(episodes: DataFrame, action: str, outcome: str, importance: str, least: int = 3, above: float = 0.3) -> DataFrame:
    """(action, outcome, n, mean_importance) that recur and matter; a null importance counts 0.5, null outcomes are left out."""
    mean = F.avg(F.coalesce(F.col(importance), F.lit(0.5)))
    return episodes.where(F.col(outcome).isNotNull()).groupBy(action, outcome).agg(F.count("*").alias("n"), mean.alias("mean_importance")).where((F.col("n") >= least) & (F.col("mean_importance") > above))


def vector_mean(rows: DataFrame, per: list[str], vector: str, dimension: int) -> DataFrame:
    """(per, mean array<double>): element-wise mean of the vectors of the given dimension, combined before the shuffle."""
    sums = [F.avg(F.col(vector)[i].cast("double")) for i in range(dimension)]
    return rows.where(F.size(vector) == dimension).groupBy(*per).agg(F.array(*sums).alias("mean"))


def first_claims(rows: DataFrame, per: str, claim: str, at: str, tie: str, most: int = 40, chars: int = 2000) -> DataFrame:
    """(per, summary): the first ``most`` distinct claims of each group in order, cut to ``chars``.

    A claim counts once, at its first place; only ``most`` of a group are gathered.
    """
    firsts = rows.where(F.trim(claim) != "").groupBy(per, F.lower(F.trim(claim)).alias("__k")).agg(F.min(F.struct(F.col(at), F.col(tie), F.trim(claim).alias("claim"))).alias("__f"))
    ranked = firsts.withColumn("__n", F.row_number().over(W.partitionBy(per).orderBy(F.col(f"__f.{at}"), F.col(f"__f.{tie}")))).where(F.col("__n") <= most)
    listed = ranked.groupBy(per).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col("__f.claim").alias("claim")))), lambda x: x["claim"]), " ").alias("summary"))
    return listed.select(per, F.left("summary", F.lit(chars)).alias("summary"))
