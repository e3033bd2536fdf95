"""The most similar vectors of every vector, from one navigable small-world graph per shard.

Vectors are sharded by topic: nearest of some centroids, fitted on bounded samples and split again where a topic
would be larger than a shard, so that their number grows with the vectors. Every vector is indexed in the shard of its own topic
and asks its graph at once; it then asks the graphs of those topics whose border lies so near that one of its
neighbours may be beyond it. The answers are merged. Exact copies are one node with its smallest ids, whatever their number.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramix.llm import hnsw
from engramix.session import cut

#: Vectors of a shard on average, rows that the first centroids are fitted on, rows for each centroid, and queries of a task.
SHARD, SAMPLE, PER, QUERIES = 8192, 20_000, 24, 16_384
#: Centroids of one fit, and of all together: with more than SHARD * LEAVES vectors (half a billion) topics are salted.
FAN, LEAVES = 256, 65_536
#: Candidates kept while walking a graph: from the vector's own node, and from above.
BREADTH_OWN, BREADTH = 16, 64
#: How many standard deviations of a neighbour's offset (across a border, in any direction) are asked for, and most topics that a vector asks.
DEVIATIONS, MOST = 1.5, 16
#: Candidates for pairs above a high cosine, which are easily told from all others.
CLOSE = {"own": 12, "breadth": 16, "deviations": 1.25}


def units(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the usable rows, their unit vectors): of the right dimension, without nulls, finite, not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False).to_numpy(zero_copy_only=False)
    values = column.filter(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    norm = np.linalg.norm(values, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    mask = right.copy()
    mask[right] = good
    return mask, (values[good] / norm[good, None]).astype(np.float32)


def packed(unit: np.ndarray) -> list[bytes]:
    """Vectors as they travel: two bytes a number, which moves a cosine by less than 0.0001."""
    return [u.tobytes() for u in unit.astype(np.float16)]


def unpacked(raw, dimension: int) -> np.ndarray:
    found = np.frombuffer(b"".join(raw), dtype=np.float16).reshape(-1, dimension).astype(np.float32)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def centroids(sample: np.ndarray, topics: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), topics, replace=False)]
    for _ in range(rounds):
        own = (sample @ found.T).argmax(1)
        total = np.zeros_like(found)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        found = np.where(norm > 0, total / np.maximum(norm, 1e-12), sample[rng.choice(len(sample), topics)])
    return found.astype(np.float32)


def fitted(sample: np.ndarray, total: float, shard: int) -> np.ndarray:
    """Centroids of ``total`` vectors, of which ``sample`` is a part: a topic that would hold more than two shards is split again."""
    topics = min(math.ceil(total / shard), len(sample) // PER, FAN)
    found = centroids(sample, max(1, topics))
    if topics < 2:
        return found
    own = (sample @ found.T).argmax(1)
    out = []
    for t in range(topics):
        mine = sample[own == t]
        size = total * len(mine) / len(sample)
        split = size > 2 * shard and 2 * PER <= len(mine) < len(sample)
        out.append(fitted(mine, size, shard) if split else found[t : t + 1])
    return np.concatenate(out)


def _leaves(given: DataFrame, total: int, dimension: int, shard: int) -> np.ndarray:
    """Centroids of all topics. The driver fits the first FAN on at most about SAMPLE rows taken by hash; where more
    are needed, each of these topics is split by a task of its own, on at most about 2 * PER rows for each centroid."""

    def taken(rows: int) -> DataFrame:
        every = max(1, -(-total // rows))
        return given.where((F.size("v") == dimension) & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).select("v")

    first = taken(SAMPLE).toArrow()
    sample = units(first.column("v"), dimension)[1] if first.num_rows else np.zeros((0, dimension), dtype=np.float32)
    if not len(sample):
        return np.zeros((1, dimension), dtype=np.float32)
    wanted = min(math.ceil(total / shard), LEAVES)
    if wanted <= FAN:
        return fitted(sample, total, shard)
    top = centroids(sample, min(FAN, len(sample) // PER))
    share = wanted * 2 * PER / total

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = units(batch.column(0), dimension)[1]
            yield pa.RecordBatch.from_arrays([pa.array((unit @ top.T).argmax(1).astype(np.int32)), pa.array([u.tobytes() for u in unit], pa.binary())], names=["topic", "unit"])

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        mine = np.frombuffer(b"".join(frame["unit"]), dtype=np.float32).reshape(-1, dimension)
        return pd.DataFrame({"unit": [c.tobytes() for c in fitted(mine, len(mine) / share, shard)]})

    found = taken(wanted * 2 * PER).mapInArrow(place, "topic int, unit binary").groupBy("topic").applyInPandas(split, "unit binary").toPandas()["unit"]
    return np.frombuffer(b"".join(sorted(found)), dtype=np.float32).reshape(-1, dimension)


def nearest(
    rows: DataFrame, id_col: str, vector_col: str, k: int = 5, least: float = -1.0, asking: Column | None = None, shard: int = SHARD, own: int = BREADTH_OWN, breadth: int = BREADTH, deviations: float = DEVIATIONS
) -> DataFrame:
    """(id, neighbours array<struct<distance, id>>) of every usable vector: its k most similar rows by cosine.

    ``distance`` is minus the cosine, so that the array is sorted; equal cosines are ordered by id. A vector is
    usable if it isn't null, empty or zero, has no null or non-finite element, and has the dimension
    that most rows have; others take no part. Fewer than k usable rows give shorter arrays; an empty table an empty result.
    Neighbours with a cosine below ``least`` are left out. ``asking``, a condition on the id column, tells which
    rows have a result (all rows are indexed). Ids must be integers and distinct; other columns aren't read.

    A neighbour at cosine s lies off by sqrt(1 - s * s), spread over all dimensions; a topic is asked if its border is no
    further away than ``deviations`` times that offset in one direction, where s is the cosine of the k-th
    neighbour that the own topic gave, or ``least`` if that is greater.
    """
    spark = rows.sparkSession
    wanted = F.lit(True) if asking is None else F.coalesce(asking, F.lit(False))
    given = rows.where(rows[id_col].isNotNull() & rows[vector_col].isNotNull()).select(rows[id_col].cast("long").alias("id"), rows[vector_col].cast("array<float>").alias("v"), wanted.alias("asks")).where("size(v) > 0")
    counted = sorted(((r["n"], r["d"]) for r in given.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()))
    empty = spark.createDataFrame([], "id long, neighbours array<struct<distance: float, id: long>>")
    if not counted:
        return empty
    total, dimension = counted[0]
    leaves = _leaves(given, total, dimension, shard)
    centre = spark.sparkContext.broadcast(leaves)  # at most LEAVES rows
    reach = deviations / math.sqrt(dimension)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centre.value
        for batch in batches:
            mask, unit = units(batch.column(1), dimension)
            ids, asks = (batch.column(i).filter(pa.array(mask)).to_numpy(zero_copy_only=False) for i in (0, 2))
            order = np.argsort(ids, kind="stable")
            ids, unit, asks = ids[order], unit[order], asks[order]
            near = unit @ c.T
            p = min(MOST, near.shape[1])
            part = np.argpartition(-near, p - 1, axis=1)[:, :p] if len(unit) else np.zeros((0, p), dtype=int)
            part = np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1).astype(np.int32)
            # Distance of each topic's border from the vector; the first topic is its own.
            ahead = np.take_along_axis(near, part[:, :1], 1) - np.take_along_axis(near, part, 1)
            apart = np.linalg.norm(c[part] - c[part[:, :1]], axis=2)
            border = ahead / np.maximum(apart, 1e-6)
            border[:, 1:][apart[:, 1:] < 1e-6] = 0
            widest = reach * math.sqrt(1 - max(least, 0.0) ** 2)
            raw = packed(unit)
            keys = [hashlib.md5(r).digest() for r in raw]
            copies: dict[bytes, int] = {}
            first = []
            for key in keys:  # of the copies within a batch the k + 1 smallest ids are indexed
                copies[key] = copies.get(key, 0) + 1
                first.append(copies[key] <= k + 1)
            beyond = [(t[1:][b[1:] <= widest], b[1:][b[1:] <= widest]) for t, b in zip(part, border)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids),
                    pa.array(keys, pa.binary()),
                    pa.array([r if f else None for r, f in zip(raw, first)], pa.binary()),
                    pa.array(asks, pa.bool_()),
                    pa.array(part[:, 0] if len(part) else [], pa.int32()),
                    pa.array([t for t, _ in beyond], pa.list_(pa.int32())),
                    pa.array([b.astype(np.float32) for _, b in beyond], pa.list_(pa.float32())),
                ],
                names=["id", "key", "unit", "asks", "topic", "others", "borders"],
            )

    ready = cut(given.mapInArrow(prepare, "id long, key binary, unit binary, asks boolean, topic int, others array<int>, borders array<float>"))
    indexed = ready.where("unit is not null")
    homes = indexed.groupBy("topic").agg(F.count("*").alias("n")).collect()  # a row for each topic
    if not homes:
        return empty
    salts = {r["topic"]: -(-r["n"] // (3 * shard)) for r in homes}
    layout = F.broadcast(spark.createDataFrame(sorted(salts.items()), "topic int, salts int"))
    tasks = min(sum(salts.values()), 20_000)
    found_type = "array<struct<distance: float, id: long>>"

    def neighbours(nodes: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> list[list[tuple[float, int]]]:
        """The k + 1 nearest rows of each query: nodes stand for all their copies."""
        cand = np.where((nodes >= 0)[:, :, None], ids[nodes], -1).reshape(len(nodes), -1)
        dist = np.repeat(-sims, k + 1, axis=1)
        dist[(cand < 0) | (dist > 1e-6 - least)] = np.inf
        order = np.lexsort((cand, dist), axis=1)[:, : k + 1]
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        return [[(x, i) for x, i in zip(d, c) if x != np.inf] for d, c in zip(dist.tolist(), cand.tolist())]

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        """The graph of a shard, the answers that it gives to its own vectors, and what these ask other topics."""
        frame = frame.sort_values("id")
        topic, salt = frame["topic"].iloc[0], frame["salt"].iloc[0]
        groups = frame.groupby("key", sort=False)
        head = groups.head(1)
        place = {key: i for i, key in enumerate(head["key"])}
        at, nth = frame["key"].map(place).to_numpy(), groups.cumcount().to_numpy()
        ids = np.full((len(head), k + 1), -1, dtype=np.int64)
        keep = nth <= k
        ids[at[keep], nth[keep]] = frame["id"].to_numpy()[keep]
        unit = unpacked(head["unit"], dimension)
        graph = hnsw.build(unit)
        out = [(topic, salt, None, pickle.dumps((graph.dumps(), ids), protocol=5), None)]
        ask = np.zeros(len(head), dtype=bool)
        np.logical_or.at(ask, at, frame["asks"].to_numpy(dtype=bool))
        mine = np.flatnonzero(ask)
        nodes, sims = hnsw.search(graph, unit[mine], k + 1, max(own, k + 1), mine)
        # The vector itself is one of its nearest rows, and so are its copies.
        found = neighbours(nodes, sims, ids)
        keys, raw, others, borders = (head[c].tolist() for c in ("key", "unit", "others", "borders"))
        siblings = [s for s in range(salts[topic]) if s != salt]
        for q, near in zip(mine.tolist(), found):
            out.append((None, None, keys[q], None, near))
            s = max(least, -near[k][0] if len(near) > k else -1.0, 0.0)
            wide = reach * math.sqrt(max(0.0, 1 - s * s))
            out += [(t, None, keys[q], raw[q], None) for t, b in zip(others[q], borders[q]) if b <= wide]
            if siblings:
                out.append((topic, salt, keys[q], raw[q], None))
        return pd.DataFrame(out, columns=["topic", "salt", "key", "data", "found"]).astype({"topic": "Int32", "salt": "Int32"})

    placed = indexed.join(layout, "topic").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")).select("topic", "salt", "id", "key", "unit", "asks", "others", "borders")
    made = cut(placed.repartition(tasks, "topic", "salt").groupBy("topic", "salt").applyInPandas(make, f"topic int, salt int, key binary, data binary, found {found_type}"))
    asked = made.where("data is not null and key is not null").select("topic", F.col("salt").alias("from"), "key", F.col("data").alias("unit"))
    sizes = {r["topic"]: r["n"] for r in asked.groupBy("topic").agg(F.count("*").alias("n")).collect()}
    answers = made.where("found is not null").select("key", "found")

    def ask(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or held.empty:
            return pd.DataFrame({"key": [], "found": []})
        data, ids = pickle.loads(held["data"].iloc[0])
        graph = hnsw.Graph.loads(data)
        nodes, sims = hnsw.search(graph, unpacked(queries["unit"], dimension), k + 1, max(breadth, k + 1))
        found = [(key, near) for key, near in zip(queries["key"], neighbours(nodes, sims, ids)) if near]
        return pd.DataFrame(found, columns=["key", "found"])

    if sizes:
        chunks = [(t, salts[t], -(-n // QUERIES)) for t, n in sizes.items() if t in salts]
        plan = F.broadcast(spark.createDataFrame(chunks, "topic int, salts int, chunks int"))
        spread = asked.join(plan, "topic").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).where(F.col("from").isNull() | (F.col("from") != F.col("salt")))
        spread = spread.select("topic", "salt", F.pmod(F.hash("key"), F.col("chunks")).cast("int").alias("chunk"), "key", "unit")
        graphs = made.where("data is not null and key is null").select(F.col("topic").alias("t"), F.col("salt").alias("s"), "data")
        held = graphs.join(plan.select(F.col("topic").alias("t"), F.col("chunks").alias("parts")), "t").select("t", "s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("c"), "data")
        both = min(sum(s * c for _, s, c in chunks), 20_000)
        left, right = ("topic", "salt", "chunk"), ("t", "s", "c")
        answers = answers.unionByName(spread.repartition(both, *left).groupBy(*left).cogroup(held.repartition(both, *right).groupBy(*right)).applyInPandas(ask, f"key binary, found {found_type}"))
    merged = answers.where("size(found) > 0").groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k + 1).alias("found"))
    each = ready.where("asks").select("id", "key").join(merged, "key", "left")
    others = F.filter(F.coalesce("found", F.array().cast(found_type)), lambda x: x["id"] != F.col("id"))
    return each.select("id", F.slice(others, 1, k).alias("neighbours"))


def similar_pairs(rows: DataFrame, id_col: str, vector_col: str, least: float = 0.85, k: int = 5, **options) -> DataFrame:
    """(id_a, id_b), a < b: rows of which one is among the k most similar of the other, with a cosine of at least ``least``."""
    found = nearest(rows, id_col, vector_col, k, least, **(CLOSE | options)).select("id", F.explode("neighbours").alias("n"))
    return found.select(F.least("id", "n.id").alias(f"{id_col}_a"), F.greatest("id", "n.id").alias(f"{id_col}_b")).distinct()
