import numpy as np
import pyarrow.parquet as pq

from engramix.llm import hnsw, plan_neighbours
from engramix.llm import neighbours as K

SCHEMA = "uid long, vec array<float>, id long, topics string"


def clumps(n, seed=1, dim=16, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // size, dim))
    x = np.repeat(centres, size, axis=0) + 0.25 * rng.normal(size=(n // size * size, dim))
    return (x * rng.uniform(0.1, 10, size=(len(x), 1))).astype(np.float32)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k], s


def test_graph_recall():
    x = clumps(3000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph.loads(hnsw.build(u).dumps())
    want, _ = exact(x, 5)
    got, _ = hnsw.search(graph, u, 6, 24)
    assert np.mean([len(set(a[1:]) & set(b)) / 5 for a, b in zip(got, want)]) > 0.95
    own, _ = hnsw.search(graph, u, 6, 24, np.arange(len(u)))
    assert np.mean([len(set(a[1:]) & set(b)) / 5 for a, b in zip(own, want)]) > 0.95
    for n in (0, 1, 2, 3):
        small = hnsw.build(u[:n])
        assert hnsw.search(small, u[:5], 3, 8)[0].shape == (5, 3)


def test_pairs_against_brute_force(spark):
    x = clumps(1600)
    df = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], SCHEMA)
    want, s = exact(x, 5)
    truth = {(min(i, j), max(i, j)) for i in range(len(x)) for j in want[i].tolist() if s[i, j] >= 0.85}
    got = {tuple(r) for r in K.similar_pairs(df, "uid", "vec", shard=300).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.01 * len(truth)


def test_copies_and_unusable_vectors(spark):
    x = clumps(64)
    same = x[0].tolist()
    rows = [(i, same, 0, "x") for i in range(40)] + [(100 + i, v.tolist(), 0, "x") for i, v in enumerate(x[8:])]
    rows += [(900, None, 0, None), (901, [], 0, "x"), (902, [0.0] * 16, 0, "x"), (903, [1.0, 2.0], 0, "x"), (904, [float("nan")] + [1.0] * 15, 0, "x"), (905, [None] + [1.0] * 15, 0, "x"), (None, same, 0, "x")]
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in K.nearest(spark.createDataFrame(rows, SCHEMA), "uid", "vec").collect()}
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[39] == [0, 1, 2, 3, 4]
    assert not set(got) & {900, 901, 902, 903, 904, 905, None} and len(got) == 96


def test_empty_and_single(spark):
    assert K.nearest(spark.createDataFrame([], SCHEMA), "uid", "vec").count() == 0
    one = K.nearest(spark.createDataFrame([(1, [1.0, 2.0], 0, "x")], SCHEMA), "uid", "vec").collect()
    assert [(r["id"], list(r["neighbours"])) for r in one] == [(1, [])]
    assert K.nearest(spark.createDataFrame([(1, None, 0, "x"), (2, [0.0, 0.0], 0, "x")], SCHEMA), "uid", "vec").count() == 0


def brute(path):
    table = pq.read_table(path, columns=["upsert_id", "embedding"])
    mask, unit = K.units(table.column("embedding"), 64)
    return table.column("upsert_id").to_numpy()[mask], unit


def test_recall_of_all_neighbours_and_of_close_pairs(spark):
    folder = "/root/testdata/sf0.1"
    ids, unit = brute(f"{folder}/fact_upserts.parquet")
    pairs = {tuple(r) for r in plan_neighbours.p6_found(spark, folder).collect()}
    got = {}
    for r in plan_neighbours.p6_neighbours(spark, folder).collect():
        got.setdefault(r["upsert_id"], set()).add(r["neighbour_id"])
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[asked].tolist())
    hits, close, right = 0, set(), set()
    for i in range(len(ids)):
        s = unit @ unit[i]
        s[i] = -2
        top = np.argsort(-s, kind="stable")[:5]
        if ids[i] % 20 == 0:
            fifth = s[top[-1]]
            at = {x: j for j, x in enumerate(ids.tolist())} if not hits else at
            hits += sum(s[at[j]] >= fifth - 1e-4 for j in got[ids[i]])
        close |= {(min(a, b), max(a, b)) for a, b in ((int(ids[i]), int(ids[j])) for j in top if s[j] >= 0.85)}
    right = pairs & close
    assert hits >= 0.9 * 5 * len(asked)
    assert len(right) >= 0.99 * len(close) and len(right) >= 0.99 * len(pairs)


def test_topics_grow_with_the_vectors(spark):
    x = clumps(6000)
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    monkey = {"FAN": 8, "SAMPLE": 1500}
    old = {name: getattr(K, name) for name in monkey}
    try:
        for name, value in monkey.items():
            setattr(K, name, value)
        leaves = K._leaves(given, len(x), 16, 150)
        assert 30 <= len(leaves) <= 90
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert np.bincount((u @ leaves.T).argmax(1)).max() < 1200
        want, s = exact(x, 5)
        got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in K.nearest(given, "id", "v", shard=150).collect()}
    finally:
        for name, value in old.items():
            setattr(K, name, value)
    assert np.mean([len(set(got[i]) & set(want[i].tolist())) / 5 for i in range(len(x))]) > 0.9
