"""The best documents of full text without pairs of query and document."""

import pytest
from pyspark.sql import functions as F

from engramix.operators import recall, retrieval
from engramix.operators.predicates import Viewer

WORDS = "harbour budget choir garden parcel the queue moved weekly summary rota ORD-77 canteen".split()


def table(spark):
    """200 texts, of which every fifth is like one before it, one stands twice, and some say nothing."""
    texts = [" ".join(WORDS[(i // 5 * 7 + j * (1 + i % 5 // 2)) % len(WORDS)] for j in range(1 + i % 9)) if i % 17 else ("" if i % 2 else None) for i in range(200)]
    rows = [(i, ("fact", "topic", "message")[i % 3], t, None) for i, t in enumerate(texts)] + [(5, "message", "choir garden", None), (None, "fact", "harbour budget", None)]
    return spark.createDataFrame(rows, "nid long, label string, content string, visibility string")


def questions(spark):
    rows = [(i, f"{WORDS[i % 13]} {WORDS[i * 5 % 13]} {WORDS[i * 3 % 13]} {WORDS[i * 7 % 13]}?") for i in range(40)] + [(90, "unknown words"), (91, ""), (92, None)]
    return spark.createDataFrame(rows, "query_id long, query string")


def rows(df, *columns):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("block,size", [(32_768, 131_072), (20, 40), (32_768, 1)])
def test_best_are_those_of_all_pairs(spark, block, size):
    items, asked = table(spark), questions(spark)
    found = retrieval.found_terms(items, retrieval.asked_terms(asked), "nid", "content", "label", broadcast=True)
    pairs = retrieval.bm25(items, asked, "nid", "content").where("doc is not null")
    want = retrieval.top_k(pairs, 6, ["query"], "doc")
    columns = ("query", "doc", "score", "rank")
    got = retrieval.bm25_best(found, retrieval.asked_terms(asked), 6, block=block, rows=size)
    assert rows(got, *columns) == rows(want, *columns) and got.count() > 200


def test_best_of_compact_are_those_of_all_pairs(spark):
    items, intent = table(spark).where("nid <> 5"), recall.intents(questions(spark))
    kinds = items.where("label <> 'message'")
    pairs = retrieval.bm25(kinds, recall.asked(intent), "nid", "content").select("query", F.col("doc").alias("nid"), (F.col("score") / (1 + F.col("score"))).alias("score"))
    want = retrieval.top_k(pairs.join(kinds.select("nid", "label"), "nid"), 20, ["query", "label"], "nid").where("rank <= 5 or label = 'fact'")
    columns = ("query", "label", "nid", "score", "rank")
    assert rows(recall.compact(items, intent), *columns) == rows(want, *columns)


def test_cascade_forms_no_pairs(spark, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("every pair of a question and a text that share a word")

    monkeypatch.setattr(retrieval, "bm25", pairs)
    found = recall.recall(table(spark).where("nid <> 5"), questions(spark), recall.Settings(candidates=10, limit=5), viewer=Viewer("me"))
    assert {r["query_id"] for r in found.collect()} >= set(range(40))
