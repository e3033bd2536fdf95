"""Containers of fixed capacity filled with items of varying size.

Items are only known by their sizes, of which there are at most ``capacity``: the plan is
made on the histogram of sizes, whatever the number of items. A container is begun with the
largest size left; its gap is closed by one, two or three sizes that fill it exactly, looked up
in an index of sums under the counts still available; where none does, the largest size that
fits goes in (best fit) and the look-up is repeated. Each pattern is used as many times as its
counts allow, so every step uses up a size and the plan has a few thousand steps at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.llm.tokens import VOCABULARY, count
from engramix.session import cut

CAPACITY = 2048


class _Sums:
    """How many pairs of available sizes (in order, a size with itself included) have each sum."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.top = counts, len(counts) - 1
        self.there = (counts > 0).astype(np.int64)
        self.pairs = np.rint(np.fft.irfft(np.fft.rfft(self.there, 2 * len(counts)) ** 2, 2 * len(counts)))[: len(counts)].astype(np.int64)

    def use(self, size: int, times: int) -> None:
        self.counts[size] -= times
        if not self.counts[size]:
            here = np.zeros(len(self.counts), dtype=np.int64)
            here[size:] = 2 * self.there[: len(self.counts) - size]
            if 2 * size <= self.top:
                here[2 * size] -= 1
            self.pairs -= here
            self.there[size] = 0

    def fill(self, gap: int, taken: Counter) -> tuple[int, ...] | None:
        """One, two or three sizes that are still available beside ``taken`` and add up to ``gap``; larger ones first."""
        left = lambda s: self.counts[s] - taken[s]
        if left(gap) > 0:
            return (gap,)
        if self.pairs[gap]:
            first = np.flatnonzero(self.there[(gap + 1) // 2 : gap] & self.there[gap - np.arange((gap + 1) // 2, gap)])[::-1] + (gap + 1) // 2
            for a in first.tolist():
                if left(a) > (a == gap - a) and left(gap - a) > 0:
                    return (a, gap - a)
        sizes = np.flatnonzero(self.there[1:gap]) + 1
        for a in sizes[self.pairs[gap - sizes] > 0][::-1].tolist():
            if left(a) > 0:
                rest = gap - a
                for b in (np.flatnonzero(self.there[1:rest] & self.there[rest - np.arange(1, rest)]) + 1)[::-1].tolist():
                    c = rest - b
                    if a >= b >= c and all(left(s) >= n for s, n in Counter((a, b, c)).items()):
                        return (a, b, c)
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of one container, number of such containers), using up ``histogram`` (sizes 1 to capacity)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"size {size} is not between 1 and the capacity")
        counts[size] = n
    sums = _Sums(counts)
    out = []
    while sums.there[1:].any():
        largest = int(np.flatnonzero(counts[1:])[-1]) + 1
        pattern, taken, gap = [largest], Counter([largest]), capacity - largest
        while gap:
            found = sums.fill(gap, taken)
            if found is None:
                fits = [s for s in (np.flatnonzero(counts[1 : gap + 1]) + 1)[::-1].tolist() if counts[s] > taken[s]][:1]
                if not fits:
                    break
                found = (fits[0],)
            pattern += found
            taken.update(found)
            gap -= sum(found)
        times = min(int(counts[s]) // n for s, n in taken.items())
        for s, n in taken.items():
            sums.use(s, n * times)
        out.append((tuple(pattern), times))
    return out


def lookup(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first rank, first container and items per container of each step, in order of rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    rank: Counter = Counter()
    base = 0
    for pattern, times in steps:
        for size, n in Counter(pattern).items():
            rows.setdefault(size, []).append((rank[size], base, n))
            rank[size] += n * times
        base += times
    return {size: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for size, r in rows.items()}


def sized(documents: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str) -> DataFrame:
    """(id, part_no, start_token, tokens): a document above the capacity is split into full parts and a rest."""
    kind = documents.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, n in zip(batch["id"], count(batch["text"], vocabulary)):
                out += [(key, k + 1, k * capacity, min(capacity, n - k * capacity)) for k in range(max(1, -(-n // capacity)))]
            yield pd.DataFrame(out, columns=["id", "part_no", "start_token", "tokens"])

    return documents.select(documents[id_col].alias("id"), documents[text_col].alias("text")).mapInPandas(measure, f"id {kind}, part_no int, start_token long, tokens int")


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, part_no, start_token, tokens, container_id) of every document.

    Only a document above ``capacity`` tokens has more than one part. Null and empty texts keep one
    row with 0 tokens and a null container. Items of equal size are told apart by their rank
    within the size, counted in salted buckets so that no task sees all items of a size. Repeated
    ids and texts are items of their own; other columns aren't read.
    """
    spark = documents.sparkSession
    parts = cut(sized(documents, id_col, text_col, capacity, vocabulary))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = parts.where("tokens > 0").withColumn("salt", F.pmod(F.xxhash64("id", "part_no"), F.lit(buckets)))
    counted = cut(salted.groupBy("tokens", "salt").agg(F.count("*").alias("n")))
    histogram = {r["tokens"]: r["n"] for r in counted.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    where = spark.sparkContext.broadcast(lookup(plan(histogram, capacity)))
    earlier = W.partitionBy("tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = counted.select("tokens", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("tokens", "salt").orderBy("id", "part_no", "start_token"))
    ranked = salted.withColumn("within", within).join(bases, ["tokens", "salt"]).select("id", "part_no", "start_token", "tokens", (F.col("base") + F.col("within") - 1).alias("rank"))

    def place(batches):
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.int64)
            ranks = batch["rank"].to_numpy()
            for size, rows in batch.groupby("tokens").indices.items():
                first, base, per = where.value[size]
                step = np.searchsorted(first, ranks[rows], side="right") - 1
                out[rows] = base[step] + (ranks[rows] - first[step]) // per[step]
            yield batch.assign(container_id=out).drop(columns="rank")

    kind = documents.schema[id_col].dataType.simpleString()
    placed = ranked.mapInPandas(place, f"id {kind}, part_no int, start_token long, tokens int, container_id long")
    nothing = parts.where("tokens = 0").withColumn("container_id", F.lit(None).cast("long"))
    return placed.unionByName(nothing).withColumnRenamed("id", id_col)
