"""Queries of problem 3."""

from __future__ import annotations

from engramix.llm.names import entities, variant_pairs
from engramix.sources.tables import read


def _names(spark, folder):
    spans = read(spark, folder, "ner_spans", "text").toDF("name")
    facts = read(spark, folder, "fact_upserts", "subject", "object")
    return spans.unionByName(facts.selectExpr("subject as name")).unionByName(facts.selectExpr("object as name"))


def p3_found(spark, folder):
    return variant_pairs(_names(spark, folder))


def p3_entities(spark, folder):
    return entities(_names(spark, folder))


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
SQL = {}
