"""Queries of problem 9."""

from __future__ import annotations

from engramix.llm.leaks import leaks
from engramix.sources.tables import read


def p9_found(spark, folder):
    return leaks(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "eval_items", "item_id", "passage"))


QUERIES = {"p9_found": p9_found}
SQL = {}
