"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.llm.pieces import pieces
from engramix.sources.tables import read


def p4_pieces(spark, folder):
    messages = read(spark, folder, "ingest_messages", "delivery_id", "content")
    artifacts = read(spark, folder, "ingest_artifacts", "artifact_id", "content")
    return (
        pieces(messages, "delivery_id", "content").select(F.lit("ingest_messages").alias("table_name"), F.col("delivery_id").cast("string").alias("item_id"), "piece_no", "start_at", "overlap", "piece")
    ).unionByName(pieces(artifacts, "artifact_id", "content").select(F.lit("ingest_artifacts").alias("table_name"), F.col("artifact_id").alias("item_id"), "piece_no", "start_at", "overlap", "piece"))


def p4_quality(spark, folder):
    """How the cuts of each table lie: at which boundary, and how far the pieces are from even sizes on average."""
    p = p4_pieces(spark, folder).withColumn("fresh", F.length("piece") - F.col("overlap"))
    sizes = p.groupBy("table_name", "item_id").agg(F.count("*").alias("pieces"), F.sum("fresh").alias("chars")).where("pieces > 1").select("item_id", "table_name", "pieces", (F.col("chars") / F.col("pieces")).alias("even"))
    ended = p.select("table_name", "item_id", "fresh", F.right("piece", F.lit(2)).alias("tail")).join(sizes, ["table_name", "item_id"])
    kind = F.when(F.col("tail").rlike(r"\n$"), "line").when(F.col("tail").rlike(r"[.!?…。！？।؟۔।][\"'”’»)\]]?\s?$"), "sentence").when(F.col("tail").rlike(r"[,;:，、；：،؛]\s?$"), "clause").when(F.col("tail").rlike(r"\s$"), "word").otherwise("other")
    return ended.groupBy("table_name", kind.alias("ends_at")).agg(F.count("*").alias("pieces"), F.round(F.avg(F.abs(F.col("fresh") / F.col("even") - 1)), 4).alias("deviation"))


QUERIES = {"p4_pieces": p4_pieces, "p4_quality": p4_quality}
SQL = {}
