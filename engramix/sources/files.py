"""Readers and sinks of files: conversations, blobs, JSON lines and delimited tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The date of a session that has none.
NO_DATE = "2023-01-01"


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, session_no, session_at, turn_no, speaker, dia_id, text) of conversation files with keys session_N and session_N_date_time.

    The keys differ by file, so each file is parsed as a map of texts; a session without a date counts as of NO_DATE.
    """
    turn = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("speaker", "dia_id", "text", "blip_caption")]))
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", T.ArrayType(T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("conversation", T.MapType(T.StringType(), T.StringType()))])))).alias("s"))
    entry = raw.select("s.sample_id", F.explode("s.conversation").alias("k", "v"), F.col("s.conversation").alias("all"))
    sessions = entry.where(F.col("k").rlike(r"^session_\d+$")).select("sample_id", F.regexp_extract("k", r"(\d+)", 1).cast("int").alias("session_no"), F.coalesce(F.try_element_at("all", F.concat("k", F.lit("_date_time"))), F.lit(NO_DATE)).alias("session_at"), F.posexplode(F.from_json("v", turn)).alias("turn_no", "t"))
    return sessions.select("sample_id", "session_no", "session_at", "turn_no", "t.speaker", "t.dia_id", F.concat_ws(" ", "t.text", "t.blip_caption").alias("text"))


def haystacks(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question_type, question, answer, session_id, session_at, turn_no, role, content, has_answer) of question files with haystack sessions."""
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("has_answer", T.BooleanType())])
    strings = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("question_id", "question_type", "question", "answer", "question_date")] + [T.StructField(n, strings) for n in ("haystack_dates", "haystack_session_ids", "answer_session_ids")] + [T.StructField("haystack_sessions", T.ArrayType(T.ArrayType(turn)))])
    rows = spark.read.schema(schema).json(path, multiLine=True)
    zipped = rows.select("question_id", "question_type", "question", "answer", F.explode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("h"))
    return zipped.select("question_id", "question_type", "question", "answer", F.col("h.haystack_session_ids").alias("session_id"), F.col("h.haystack_dates").alias("session_at"), F.posexplode("h.haystack_sessions").alias("turn_no", "t")).select("*", "t.role", "t.content", "t.has_answer").drop("t")


def delimited(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=separator, enforceSchema=False)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def put_blobs(blobs: DataFrame, folder: str, bytes_col: str = "bytes") -> DataFrame:
    """(content_id, uri, size) of the distinct contents, written under ``folder`` by the first two digits of their hash.

    A content is stored once whatever its copies; a folder holds the table of those beginning alike.
    """
    hashed = blobs.where(F.col(bytes_col).isNotNull()).select(F.sha2(bytes_col, 256).alias("content_id"), F.col(bytes_col).alias("bytes")).dropDuplicates(["content_id"])
    placed = hashed.withColumn("fan", F.substring("content_id", 1, 2))
    placed.write.mode("append").partitionBy("fan").parquet(folder)
    return placed.select("content_id", F.concat(F.lit(f"{folder}/fan="), "fan").alias("uri"), F.octet_length("bytes").alias("size"))


def get_blobs(spark: SparkSession, folder: str, ids: DataFrame, id_col: str = "content_id") -> DataFrame:
    """(content_id, bytes) of the wanted contents; only their folders are read."""
    wanted = ids.select(F.col(id_col).alias("content_id")).distinct().withColumn("fan", F.substring("content_id", 1, 2))
    return spark.read.parquet(folder).withColumn("fan", F.col("fan").cast("string")).join(wanted, ["content_id", "fan"], "left_semi").dropDuplicates(["content_id"]).select("content_id", "bytes")


def files_as_blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content").alias("bytes"), F.col("length").alias("size"))


def evidence_texts(turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """(question_id, texts): what the turns (dia_id, text) say that a question's ``evidence`` (array of dia_ids) names, in its order; unknown ids add nothing."""
    named = wanted.select("question_id", F.posexplode("evidence").alias("place", "dia_id"))
    found = named.join(turns.select("dia_id", "text").dropDuplicates(["dia_id"]), "dia_id")
    listed = found.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("texts"))
    return wanted.select("question_id").join(listed, "question_id", "left").select("question_id", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def write_report(summary: DataFrame, details: DataFrame, path: str) -> None:
    """A report as two JSON tables: one of the summary, one of all details."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")


def blob_store(kind: str, folder: str | None = None):
    """(put, get) of a kind of storage: 'inline' keeps bytes in the table, 'files' in a folder of any file system that Spark can write."""
    if kind == "inline":
        put = lambda blobs, column="bytes": blobs.where(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("content_id"), F.col(column).alias("bytes")).dropDuplicates(["content_id"])
        return put, lambda table, ids: table.join(ids.select("content_id").distinct(), "content_id", "left_semi").select("content_id", "bytes")
    if kind == "files" and folder:
        return lambda blobs, column="bytes": put_blobs(blobs, folder, column), lambda spark, ids: get_blobs(spark, folder, ids)
    raise ValueError(f"unknown storage: {kind}")
