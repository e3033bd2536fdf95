"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.llm import pii_rules as R
from engramix.llm.pii import redact, spans_of, train
from engramix.session import cut
from engramix.sources.tables import read


def _labelled(spark, folder):
    """(content, xs): each text of which something is known, with its views with placeholders and its spans,
    joined to the messages that carry their identifier letter by letter; one scan of the messages serves both."""
    views = read(spark, folder, "message_views", "message_id", "content").where(F.col("content").rlike(R._PLACEHOLDER.pattern) & F.col("message_id").isNotNull())
    spans = read(spark, folder, "ner_spans", "message_id", "entity_type", "start_word", "end_word").where("message_id is not null and entity_type is not null and start_word is not null and end_word is not null")
    a = views.select("message_id", F.struct(F.col("content").alias("view"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")).alias("x"))
    b = spans.select("message_id", F.struct(F.lit(None).cast("string").alias("view"), F.upper("entity_type").alias("kind"), F.col("start_word").cast("int").alias("first"), F.col("end_word").cast("int").alias("last")).alias("x"))
    held = a.unionByName(b).groupBy("message_id").agg(F.collect_set("x").alias("xs"))
    texts = read(spark, folder, "ingest_messages", "message_id", "content").where("content is not null")
    return cut(texts.join(held, "message_id").select("content", F.explode("xs").alias("x")).groupBy("content").agg(F.collect_set("x").alias("xs")))


def _model(spark, folder):
    texts = read(spark, folder, "ingest_messages", "content").where("content is not null").select(F.col("content").alias("t"))
    people = read(spark, folder, "participants", "kind", "display_name").where("lower(trim(kind)) = 'human'")
    return train(texts, read(spark, folder, "ner_spans", "text", "entity_type"), people, _labelled(spark, folder))


def _rows(spark, folder):
    return (("ingest_messages", read(spark, folder, "ingest_messages", "delivery_id", "content").toDF("row_id", "content")), ("message_views", read(spark, folder, "message_views", "view_id", "content").toDF("row_id", "content")))


def p1_found(spark, folder):
    model = _model(spark, folder)
    (name, messages), (other, views) = _rows(spark, folder)
    one = spans_of(messages, "row_id", "content", model).withColumn("table_name", F.lit(name))
    two = spans_of(views, "row_id", "content", model).withColumn("table_name", F.lit(other))
    # A value counts once per row; both lie in one partition, so nothing has to be shuffled but the found values.
    return one.unionByName(two).select("table_name", "row_id", "pii_type", "pii_value").distinct()


def p1_redacted(spark, folder):
    """The contents of both tables with typed placeholders."""
    model = _model(spark, folder)
    parts = [redact(rows, "row_id", "content", model).select(F.lit(name).alias("table_name"), "row_id", "content") for name, rows in _rows(spark, folder)]
    return parts[0].unionByName(parts[1])


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
SQL = {}
