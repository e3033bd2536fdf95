"""Changes as pure functions: each takes tables and returns the tables after the change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.functions.text import laplace
from engramix.operators.temporal import chain


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` with the non-null values of ``changes`` laid over, and the new rows of ``changes``."""
    old, new = base.alias("o"), changes.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    pick = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in changes.columns else F.col(f"o.{c}") for c in base.columns]
    return old.join(new, on, "full").select(*pick)


def upsert_facts(base: DataFrame, inputs: DataFrame) -> DataFrame:
    """(fact_id, subject, predicate, object, observation_count, first_observed, confidence, created).

    Inputs of one fact add their counts and keep the earliest time and the first spelling; the base fact keeps its spelling.
    """
    order = F.struct("first_observed", "subject", "predicate", F.coalesce("object", F.lit("")).alias("o"))
    summed = inputs.groupBy("fact_id").agg(F.sum("observation_count").alias("n"), F.min("first_observed").alias("first_observed"), F.min_by(F.struct("subject", "predicate", "object"), order).alias("t"))
    old = base.select("fact_id", F.struct("subject", "predicate", "object").alias("b"), F.col("observation_count").alias("bn"), F.col("first_observed").alias("bf"))
    count = F.coalesce("n", F.lit(0)) + F.coalesce("bn", F.lit(0))
    triple = F.coalesce("b", "t")
    return summed.join(old, "fact_id", "full").select("fact_id", triple["subject"].alias("subject"), triple["predicate"].alias("predicate"), triple["object"].alias("object"), count.alias("observation_count"), F.least("first_observed", "bf").alias("first_observed"), laplace(count).alias("confidence"), F.col("bn").isNull().alias("created"))


def delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame, node: str = "nid") -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``gone`` (column node), and edges without those at either end."""
    ids = gone.select(F.col(node).alias("__gone")).distinct()
    left = nodes.join(ids, nodes[node] == ids["__gone"], "left_anti")
    kept = edges.join(ids, edges["src"] == ids["__gone"], "left_anti")
    return left, kept.join(ids, kept["dst"] == ids["__gone"], "left_anti")


def splice(messages: DataFrame, gone: DataFrame, per: list[str], at: str, tie: str) -> DataFrame:
    """The message chain after ``gone`` (column ``tie``) are removed: neighbours are linked, gaps add up."""
    ids = gone.select(F.col(tie).alias("__gone")).distinct()
    return chain(messages.join(ids, messages[tie] == ids["__gone"], "left_anti"), per, at, tie)


def surviving_support(supports: DataFrame, doomed: DataFrame, fact: str = "fact_id", observation: str = "observation_id") -> DataFrame:
    """(fact, support, left): how many observations support a fact, and how many once ``doomed`` are gone."""
    marked = supports.join(doomed.select(F.col(observation).alias("__d")).distinct(), supports[observation] == F.col("__d"), "left")
    return marked.groupBy(fact).agg(F.count("*").alias("support"), F.count_if(F.col("__d").isNull()).alias("left"))


def superseded(revisions: DataFrame, source: str, revision: str, order: list[str]) -> DataFrame:
    """``revisions`` with ``superseded``: whether a later row of the source carries another revision."""
    last = revisions.where(F.col(source).isNotNull()).groupBy(source).agg(F.max(F.struct(*order, F.coalesce(F.col(revision), F.lit("")).alias("__r"))).alias("__last"))
    joined = revisions.join(last, source, "left")
    return joined.withColumn("superseded", F.coalesce(F.col("__last.__r") != F.coalesce(F.col(revision), F.lit("")), F.lit(False))).drop("__last")


def repoint(edges: DataFrame, mapping: DataFrame, extra: str = "count") -> DataFrame:
    """(src, dst, etype, extra): edges with ends replaced by ``mapping`` (old, new), equal ones merged by adding ``extra``."""
    a = mapping.select(F.col("old").alias("src"), F.col("new").alias("ns"))
    b = mapping.select(F.col("old").alias("dst"), F.col("new").alias("nd"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("ns", "src").alias("src"), F.coalesce("nd", "dst").alias("dst"), "etype", extra)
    return moved.groupBy("src", "dst", "etype").agg(F.sum(extra).alias(extra))


def recipients(messages: DataFrame, per: str, sender: str, to: str, at: str, tie: str) -> DataFrame:
    """(tie, recipient): those addressed, else all who spoke in the session before, but for the sender.

    Each participant is joined from its first message on, so no set is gathered per session.
    """
    explicit = messages.where(F.size(to) > 0).select(tie, F.explode(to).alias("recipient"))
    firsts = messages.where(F.col(sender).isNotNull()).groupBy(per, sender).agg(F.min(F.struct(at, tie)).alias("first")).select(F.col(per).alias("__s"), F.col(sender).alias("recipient"), F.col("first"))
    rest = messages.where(F.coalesce(F.size(to) <= 0, F.lit(True))).select(tie, per, sender, at)
    implied = rest.join(firsts, (rest[per] == firsts["__s"]) & (F.struct(rest[at], rest[tie]) > firsts["first"])).where(~F.col(sender).eqNullSafe(F.col("recipient"))).select(tie, "recipient")
    return explicit.where("recipient is not null").unionByName(implied).distinct()
