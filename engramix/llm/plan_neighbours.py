"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.llm.neighbours import nearest, similar_pairs
from engramix.sources.tables import read


def p6_found(spark, folder):
    return similar_pairs(read(spark, folder, "fact_upserts", "upsert_id", "embedding"), "upsert_id", "embedding")


def p6_neighbours(spark, folder):
    """The five most similar facts of every fact whose id is divisible by 20, of all facts."""
    facts = read(spark, folder, "fact_upserts", "upsert_id", "embedding")
    found = nearest(facts, "upsert_id", "embedding", asking=F.col("upsert_id") % 20 == 0)
    return found.select(F.col("id").alias("upsert_id"), F.posexplode("neighbours").alias("position", "n")).select("upsert_id", "position", F.col("n.id").alias("neighbour_id"))


QUERIES = {"p6_found": p6_found, "p6_neighbours": p6_neighbours}
SQL = {}
