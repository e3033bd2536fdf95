"""Structured Streaming forms of ingestion: exactly-once rows, sessions, triggers and step chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix.operators.deliveries import Seen, accept


class DeliveryLog:
    """foreachBatch sink that keeps one copy of each message over all batches.

    State and output are tables in ``folder``, one part per batch, so that a batch that is run
    again after a failure overwrites its own part and changes nothing. Each batch reads the ranges that the one before it
    left, and the keys of all: of every COMPACT batches as one table, and single ones since. A state that can't be read is an error.
    """

    #: Batches whose keys are gathered into one table.
    COMPACT = 64

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "message_id", ts_col: str = "msg_timestamp", delivery_col: str = "delivery_id"):
        self.spark, self.folder = spark, folder
        self.columns = (id_col, ts_col, delivery_col)

    def _seen(self, before: int) -> Seen:
        empty = Seen.empty(self.spark)
        if not before:
            return empty
        table = lambda kind, *paths: self.spark.read.schema(kind.schema).parquet(*[f"{self.folder}/{p}" for p in paths])
        whole = before // self.COMPACT * self.COMPACT
        if whole == before:
            older = [f"compact/upto={whole - self.COMPACT}"] if whole > self.COMPACT else []
            gathered = table(empty.keys, *older, *[f"keys/batch={b}" for b in range(whole - self.COMPACT, whole)])
            gathered.write.mode("overwrite").parquet(f"{self.folder}/compact/upto={whole}")
        parts = [f"compact/upto={whole}"] if whole else []
        return Seen(table(empty.ranges, f"ranges/batch={before - 1}"), table(empty.keys, *parts, *[f"keys/batch={b}" for b in range(whole, before)]))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        accepted, after = accept(batch, self._seen(batch_id), *self.columns)
        accepted.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch_id}")
        after.ranges.write.mode("overwrite").parquet(f"{self.folder}/ranges/batch={batch_id}")
        after.fresh.write.mode("overwrite").parquet(f"{self.folder}/keys/batch={batch_id}")


def session_activity(stream: DataFrame, session: str, ts: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions that close after ``gap`` without a row; rows later than ``late`` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), session).agg(F.count("*").alias("messages")).select(session, F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("closes_at"), "messages")


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows by key in tumbling or sliding windows of event time."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(window, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), key, "n")


def threshold_trigger(stream: DataFrame, key: str, threshold: int = 20) -> DataFrame:
    """(key, fired, rest): per key, how often its count reached ``threshold`` in the batch; the count then begins again at 0."""

    def count(name: tuple, groups: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        held += sum(len(g) for g in groups)
        fired, held = divmod(held, threshold)
        state.update((held,))
        if fired:
            yield pd.DataFrame({key: [name[0]], "fired": [fired], "rest": [held]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, fired long, rest long", "held long", "append", "NoTimeout")


def step_chain(rows: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame], str]]) -> tuple[DataFrame, DataFrame]:
    """(rows after all steps, dead letters): each step is (name, transform, check), where ``check`` is an SQL condition of good rows.

    A row that fails a check leaves the chain as a dead letter with the step and the row as JSON.
    """
    dead = None
    for name, step, check in steps:
        out = step(rows)
        good = F.coalesce(F.expr(check), F.lit(False))
        letters = out.where(~good).select(F.lit(name).alias("step"), F.lit(check).alias("error"), F.to_json(F.struct(*out.columns)).alias("payload"))
        dead = letters if dead is None else dead.unionByName(letters)
        rows = out.where(good)
    if dead is None:
        dead = rows.sparkSession.createDataFrame([], "step string, error string, payload string")
    return rows, dead
