"""Exactly one copy of each message that was delivered at least once.

Identifiers fall into two classes. A *producer sequence* identifier
(``producer:17``, ``producer/17``, ``producer#17``) is covered by disjoint seen
ranges per producer, so the state of a log of N messages is a few ranges, not N
keys; and within a table only the numbers that ranges of several tasks share are
compared row by row. Everything else (UUIDs in any spelling, and identifiers that fit no form)
is resolved by an exact lookup of its canonical key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.functions.ids import bare_id, uuid_bytes
from engramix.session import cut

#: Sequence numbers are cut into blocks of this size, so that a hot producer is spread over many tasks; blocks of blocks have a size of the next power.
BITS = 16
BLOCK = 1 << BITS
LEVELS = 4
SEQUENCE = r"^([^:/#]+)[:/#]0*(\d{1,18})$"


def with_keys(rows: DataFrame, id_col: str, ts_col: str, delivery_col: str) -> DataFrame:
    """__order, and __producer and __seq (sequence identifiers) or __key (all others); all null for a missing id."""
    order = F.struct(rows[ts_col].isNull().alias("late"), rows[ts_col].alias("ts"), rows[delivery_col].alias("delivery"))
    found = rows.select(order.alias("__order"), uuid_bytes(rows[id_col]).alias("__uuid"), rows[id_col].alias("__id"))
    named = found.select("__order", "__uuid", F.when(F.col("__uuid").isNull(), bare_id(F.col("__id"))).alias("__bare"))
    is_seq = F.col("__bare").isNotNull() & F.col("__bare").rlike(SEQUENCE)
    return named.select(
        "__order",
        F.when(is_seq, F.regexp_extract("__bare", SEQUENCE, 1)).alias("__producer"),
        F.when(is_seq, F.regexp_extract("__bare", SEQUENCE, 2).cast("long")).alias("__seq"),
        F.when(F.col("__uuid").isNotNull(), F.col("__uuid")).when(~is_seq, F.encode("__bare", "utf-8")).alias("__key"),
    )


def kept_deliveries(rows: DataFrame, id_col: str = "message_id", ts_col: str = "msg_timestamp", delivery_col: str = "delivery_id") -> DataFrame:
    """(__producer, __seq, __key, __delivery): the row that stays for each identifier.

    The smallest (timestamp, delivery id) stays; a null timestamp counts as the latest.
    Rows without an identifier aren't here, as nothing tells whether they are copies.
    The aggregate is combined before the shuffle, so an identifier that holds a third of
    all rows sends one row per task.
    """
    keyed = with_keys(rows, id_col, ts_col, delivery_col).where("__key is not null or __seq is not null")
    return _first_of(keyed, ["__producer", "__seq", "__key"])


def _first_of(keyed: DataFrame, keys: list[str]) -> DataFrame:
    return keyed.groupBy(*keys).agg(F.min("__order").alias("__first")).select(*keys, F.col("__first.delivery").alias("__delivery"))


def duplicate_deliveries(rows: DataFrame, id_col: str = "message_id", ts_col: str = "msg_timestamp", delivery_col: str = "delivery_id") -> DataFrame:
    """Delivery ids (one column, named as ``delivery_col``) of the rows to be removed.

    Sequence identifiers: the numbers of each producer become seen ranges where they are read; numbers that only one
    range holds once are accepted, whatever their number, and only rows of contested numbers are compared. Other
    identifiers: exact lookup of the key. Nulls: rows without an identifier or without a delivery id are never removed.
    Ties: at equal timestamps the smaller delivery id stays. Other columns, whatever their
    names, are not read. An empty table gives an empty result.
    """
    keyed = with_keys(rows, id_col, ts_col, delivery_col)
    others = keyed.where("__key is not null")
    gone = _rest_of(others, _first_of(others, ["__key"]))
    numbers = keyed.where("__seq is not null")
    if not numbers.isEmpty():
        contested = contested_ranges(seen_ranges(numbers))
        shared = covered(numbers, contested)
        gone = gone.unionByName(_rest_of(shared, _first_of(shared, ["__producer", "__seq"])))
    return gone.select(F.col("__gone").alias(delivery_col))


def _rest_of(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    named = keyed.select(F.col("__order.delivery").alias("__gone")).where("__gone is not null")
    return named.join(kept.select("__delivery"), F.col("__gone") == F.col("__delivery"), "left_anti")


def once(rows: DataFrame, id_col: str = "message_id", ts_col: str = "msg_timestamp", delivery_col: str = "delivery_id") -> DataFrame:
    """``rows`` (all their columns) with one row for each identifier; rows without one stay."""
    gone = duplicate_deliveries(rows, id_col, ts_col, delivery_col).select(F.col(delivery_col).alias("__gone"))
    return rows.join(gone, rows[delivery_col] == gone["__gone"], "left_anti")


def seen_ranges(numbers: DataFrame) -> DataFrame:
    """(producer, lo, hi, copies): the ranges of (__producer, __seq) that each batch of rows holds, made where the rows are read.

    A number that stands more than once in a batch is a range of its own, with ``copies`` 2. Consecutive numbers cost one row, whatever
    their number, so a log in order of its producers is shuffled as a few ranges.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted = batch.groupby(["p", "n"], sort=True).size()
            if not len(counted):
                continue
            p, n = (counted.index.get_level_values(i).to_numpy() for i in (0, 1))
            many = counted.to_numpy() > 1
            opens = np.ones(len(n), dtype=bool)
            opens[1:] = (p[1:] != p[:-1]) | (n[1:] != n[:-1] + 1) | many[1:] | many[:-1] | (n[1:] >> BITS != n[:-1] >> BITS)
            at = np.flatnonzero(opens)
            yield pd.DataFrame({"producer": p[at], "lo": n[at], "hi": n[np.append(at[1:], len(n)) - 1], "copies": np.where(many[at], 2, 1)})

    return numbers.select(F.col("__producer").alias("p"), F.col("__seq").alias("n")).mapInPandas(gather, "producer string, lo long, hi long, copies long")


def contested_ranges(ranges: DataFrame) -> DataFrame:
    """(producer, lo, hi): numbers that more than one of ``ranges`` holds, or one more than once; ranges lie within blocks.

    A sweep over the ends of the ranges, block by block: no task holds all ranges of a producer.
    """
    block = F.floor(F.col("lo") / BLOCK)
    ends = ranges.select("producer", block.alias("block"), F.explode(F.array(F.struct(F.col("lo").alias("at"), F.col("copies").alias("d")), F.struct((F.col("hi") + 1).alias("at"), (-F.col("copies")).alias("d")))).alias("e"))
    steps = ends.groupBy("producer", "block", "e.at").agg(F.sum("e.d").alias("d"))
    w = W.partitionBy("producer", "block").orderBy("at")
    held = steps.withColumn("held", F.sum("d").over(w)).withColumn("next", F.lead("at").over(w))
    return held.where("held > 1").select("producer", F.col("at").alias("lo"), (F.col("next") - 1).alias("hi"))


def to_ranges(numbers: DataFrame) -> DataFrame:
    """(producer, lo, hi): disjoint maximal ranges covering all (__producer, __seq) of ``numbers``."""
    return merge_ranges(seen_ranges(numbers).select("producer", "lo", "hi"))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Overlapping or adjoining ranges of a producer become one.

    In two levels: ranges are sorted within buckets of their begin, and only one row of each bucket (how far it reaches, and
    where its last run begins) is sorted per producer, so that no task holds all ranges of a hot one.
    """
    placed = ranges.select("producer", "lo", "hi", F.floor(F.col("lo") / (BLOCK * 16)).alias("bucket"))
    inside = W.partitionBy("producer", "bucket").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("producer").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    reach = placed.groupBy("producer", "bucket").agg(F.max("hi").alias("top")).select(F.col("producer").alias("p"), F.col("bucket").alias("b"), F.max("top").over(W.partitionBy("producer").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)).alias("below"))
    reached = placed.join(reach, (F.col("producer") == F.col("p")) & (F.col("bucket") == F.col("b"))).drop("p", "b")
    so_far = F.greatest(F.max("hi").over(inside), F.col("below"))
    marked = reached.withColumn("run", F.when(so_far.isNull() | (F.col("lo") > so_far + 1), F.col("lo"))).drop("below")
    upto = W.partitionBy("producer", "bucket").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = marked.groupBy("producer", "bucket").agg(F.max("run").alias("last"), F.max("hi").alias("top"))
    carried = last.select(F.col("producer").alias("p"), F.col("bucket").alias("b"), F.max("last").over(before).alias("carried"))
    runs = marked.withColumn("run", F.max("run").over(upto)).join(carried, (F.col("producer") == F.col("p")) & (F.col("bucket") == F.col("b")))
    return runs.groupBy("producer", F.coalesce("run", "carried").alias("lo")).agg(F.max("hi").alias("hi"))


def covered(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of ``numbers`` (__producer, __seq) that lie in one of the disjoint ``ranges``: an equi-join on blocks.

    A range is its two ends within blocks, and the whole blocks between them, which are a range of the next level: at most two rows a
    level, however long it is, and a number looks up one block of each level.
    """
    left = ranges.select("producer", F.col("lo").alias("a"), F.col("hi").alias("b"))
    parts = None
    for level in range(LEVELS):
        p, q = F.shiftright("a", BITS), F.shiftright("b", BITS)
        whole = p == q
        piece = lambda block, lo, hi: F.struct(block.alias("block"), lo.alias("lo"), hi.alias("hi"))
        top = level == LEVELS - 1
        if top:  # the highest level has few blocks: its numbers are below 2^(63 - 48)
            both = F.array(piece(p, F.col("a"), F.col("b")))
        else:
            both = F.when(whole, F.array(piece(p, F.col("a"), F.col("b")))).otherwise(F.array(piece(p, F.col("a"), F.shiftleft(p + 1, BITS) - 1), piece(q, F.shiftleft(q, BITS), F.col("b"))))
        found = left.select("producer", F.lit(level).alias("level"), F.explode(both).alias("x")).select("producer", "level", "x.*")
        parts = found if parts is None else parts.unionByName(found)
        left = left.where(q - p > 1).select("producer", (p + 1).alias("a"), (q - 1).alias("b"))
    block = lambda level: F.shiftright("__seq", BITS * (level + 1)) if level < LEVELS - 1 else F.lit(0).cast("long")
    keys = F.array(*[F.struct(F.lit(i).alias("level"), block(i).alias("block"), F.shiftright("__seq", BITS * i).alias("at")) for i in range(LEVELS)])
    asked = numbers.select("__producer", "__seq").distinct().select("__producer", "__seq", F.explode(keys).alias("k")).select("__producer", "__seq", "k.*")
    on = (asked["__producer"] == parts["producer"]) & (asked["level"] == parts["level"]) & (asked["block"] == parts["block"]) & asked["at"].between(parts["lo"], parts["hi"])
    inside = asked.join(parts, on, "left_semi").select(F.col("__producer").alias("__p"), F.col("__seq").alias("__s")).distinct()
    return numbers.join(inside, (numbers["__producer"] == inside["__p"]) & (numbers["__seq"] == inside["__s"]), "left_semi")


@dataclass
class Seen:
    """What earlier batches accepted: ``ranges`` (producer, lo, hi) and ``keys`` (key binary); ``fresh`` are the keys that the last batch added."""

    ranges: DataFrame
    keys: DataFrame
    fresh: DataFrame | None = None

    @classmethod
    def empty(cls, spark) -> "Seen":
        return cls(spark.createDataFrame([], "producer string, lo long, hi long"), spark.createDataFrame([], "key binary"))


def accept(batch: DataFrame, seen: Seen, id_col: str = "message_id", ts_col: str = "msg_timestamp", delivery_col: str = "delivery_id") -> tuple[DataFrame, Seen]:
    """(the rows of ``batch`` that are new, the state after it).

    Within the batch the smallest (timestamp, delivery id) is taken; identifiers of earlier
    batches are refused whatever their timestamps. Rows without an identifier are accepted.
    """
    kept = cut(kept_deliveries(batch, id_col, ts_col, delivery_col))
    numbers = kept.where("__seq is not null")
    fresh_numbers = numbers.join(covered(numbers, seen.ranges).select(F.col("__delivery").alias("__old")), F.col("__delivery") == F.col("__old"), "left_anti")
    others = kept.where("__key is not null")
    fresh_others = others.join(seen.keys, others["__key"] == seen.keys["key"], "left_anti")
    fresh = cut(fresh_numbers.unionByName(fresh_others))
    accepted = batch.join(fresh.select("__delivery"), batch[delivery_col] == F.col("__delivery"), "left_semi").unionByName(batch.where(bare_id(batch[id_col]).isNull()))
    ranges = merge_ranges(seen.ranges.unionByName(to_ranges(fresh.where("__seq is not null"))))
    new = fresh.where("__key is not null").select(F.col("__key").alias("key"))
    return accepted, Seen(ranges, seen.keys.unionByName(new), new)
