import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from engramix.llm import ranking as R

SCORED = "query_id long, channel string, node_id long, label string, score double, z double, weight double"
TARGETS = "node_type string, tier_weight double"


def test_inverse_normal(spark):
    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.98, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(R.inverse_normal(F.col("p")).alias("z")).collect()
    assert [r["z"] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-6)


@pytest.mark.parametrize("group", [R.GROUP, 40])
def test_normal_scores_equal_a_plain_ranking(spark, monkeypatch, group):
    monkeypatch.setattr(R, "GROUP", group)
    rnd = random.Random(3)
    rows = [(1, rnd.choice([0.1, 0.1, 0.5, rnd.random(), rnd.random() * 1000])) for _ in range(400)] + [(2, 7.0)] * 5 + [(3, 1.0)]
    got = R.normal_scores(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()
    for g in (1, 2, 3):
        values = [v for q, v in rows if q == g]
        want = {v: NormalDist().inv_cdf((sum(x < v for x in values) + (values.count(v) + 1) / 2 - 0.5) / len(values)) for v in values}
        assert all(r["z"] == pytest.approx(want[r["v"]], abs=1e-6) for r in got if r["g"] == g)


def test_scale_of_a_channel_does_not_matter(spark):
    base = [(1, "a", n, "Fact", float(n)) for n in range(10)] + [(1, "b", n, "Fact", float(-n)) for n in range(10)]
    big = [(q, c, n, label, s * (1e9 if c == "a" else 1)) for q, c, n, label, s in base]
    targets = spark.createDataFrame([("fact", 1.0)], TARGETS)
    order = lambda rows: [r["node_id"] for r in R.fuse(spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], SCORED), targets).orderBy("position").collect()]
    assert order(base) == order(big)


def test_defined_cases(spark):
    nan = float("nan")
    rows = [(1, "dense", 1, "FACT", 0.9), (1, "dense", 1, "Fact", 0.1), (1, "dense", 2, "Fact", 0.5), (1, "l2_distance", 1, "Fact", 0.1), (1, "l2_distance", 2, "Fact", 5.0), (1, "dense", 3, "Other", 0.99), (1, "dense", 4, None, None), (1, None, 5, "Fact", 1.0), (None, "dense", 6, "Fact", 1.0), (1, "dense", 7, "Fact", nan)]
    df = spark.createDataFrame([(*r, 1.0, 2.0) for r in rows], SCORED)
    targets = spark.createDataFrame([("Fact", 1.0), (None, None)], TARGETS)
    got = [(r["node_id"], r["position"]) for r in R.fuse(df, targets).orderBy("position").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]
    recalled = spark.createDataFrame([(1, 2, 0.5), (1, 2, None), (1, 8, nan)], "query_id long, node_id long, score double")
    assert R.fuse(df, targets, recalled, top=1).count() == 1
    assert R.fuse(df.where("false"), targets).count() == 0


def test_large_groups_keep_their_order(spark):
    """Below the 0.135 % point too, items differ from each other and from one that the channel misses."""
    rows = [(1, "a", n, "Fact", float(n), 0.0, 0.0) for n in range(2000)] + [(1, "b", 5000, "Fact", 1.0, 0.0, 0.0)]
    got = {r["node_id"]: r["fused"] for r in R.fuse(spark.createDataFrame(rows, SCORED), spark.createDataFrame([("fact", 1.0)], TARGETS)).collect()}
    low = [got[n] for n in range(6)]
    assert low == sorted(low) and len(set(low)) == 6 and low[0] >= 0
