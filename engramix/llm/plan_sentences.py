"""Queries of problem 10."""

from __future__ import annotations

from engramix.llm.sentences import sentence_units
from engramix.sources.tables import read


def p10_found(spark, folder):
    return sentence_units(read(spark, folder, "documents", "doc_id", "text"))


QUERIES = {"p10_found": p10_found}
SQL = {}
