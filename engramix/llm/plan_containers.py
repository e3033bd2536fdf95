"""Queries of problem 8."""

from __future__ import annotations

from engramix.llm.containers import pack
from engramix.sources.tables import read


def p8_containers(spark, folder):
    return pack(read(spark, folder, "documents", "doc_id", "text"))


QUERIES = {"p8_containers": p8_containers}
SQL = {}
