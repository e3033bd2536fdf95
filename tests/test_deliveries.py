import random
from datetime import datetime

import pytest

from engramix.operators import deliveries as D

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
SCHEMA = "delivery_id long, message_id string, msg_timestamp timestamp_ntz, content string, `key` string, ts int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "clash", 1) for r in rows], SCHEMA)


U = "018cc29b-9c5c-7045-a0f1-5612bbf4f183"
SPELLINGS = [U, U.upper(), "{" + U.upper() + "}", U.replace("-", ""), "urn:uuid:" + U, " " + U + "\n", "\u200b" + U]


def test_all_spellings_of_one_identifier_are_one(spark):
    df = frame(spark, [(i, s, T0) for i, s in enumerate(SPELLINGS)])
    assert sorted(r[0] for r in D.duplicate_deliveries(df).collect()) == list(range(1, len(SPELLINGS)))
    assert [r["delivery_id"] for r in D.once(df).collect()] == [0]


def test_ties_nulls_and_order(spark):
    df = frame(spark, [(5, "a:1", T1), (4, "a:1", T1), (3, "a:1", None), (9, None, T0), (10, None, T0), (11, " ", T0), (6, "a:01", T0), (7, "odd id", None), (8, "ODD ID", None)])
    gone = sorted(r[0] for r in D.duplicate_deliveries(df).collect())
    assert gone == [3, 4, 5, 8]  # a:01 is the earliest of a:1; null times are last; missing ids stay
    assert D.once(df).columns == df.columns


def test_empty(spark):
    assert D.duplicate_deliveries(frame(spark, [])).count() == 0


def test_ranges(spark):
    numbers = [("p", n) for n in [1, 2, 3, 7, 8, 65535, 65536, 65537, 200000]] + [("q", 5)]
    df = spark.createDataFrame(numbers, "__producer string, __seq long")
    assert sorted(tuple(r) for r in D.to_ranges(df).collect()) == [("p", 1, 3), ("p", 7, 8), ("p", 65535, 65537), ("p", 200000, 200000), ("q", 5, 5)]
    ranges = spark.createDataFrame([("p", 1, 70000)], "producer string, lo long, hi long")
    assert sorted(r["__seq"] for r in D.covered(df, ranges).collect()) == [1, 2, 3, 7, 8, 65535, 65536, 65537]


def test_batches_accept_each_identifier_once(spark):
    seen = D.Seen.empty(spark)
    first, seen = D.accept(frame(spark, [(1, "p:1", T0), (2, "p:2", T0), (3, U, T0), (4, "p:2", T1)]), seen)
    assert sorted(r["delivery_id"] for r in first.collect()) == [1, 2, 3]
    second, seen = D.accept(frame(spark, [(5, "p:2", T0), (6, "p:3", T0), (7, "{" + U + "}", T0), (8, "bad", T0), (9, None, T0)]), seen)
    assert sorted(r["delivery_id"] for r in second.collect()) == [6, 8, 9]
    assert [tuple(r) for r in seen.ranges.collect()] == [("p", 1, 3)]


@pytest.mark.parametrize("hot", [2000])
def test_hot_identifier(spark, hot):
    df = frame(spark, [(i, U, T1) for i in range(hot)] + [(hot + i, f"p:{i}", T0) for i in range(50)])
    assert D.duplicate_deliveries(df).count() == hot - 1


def test_long_ranges_cost_a_few_rows(spark):
    numbers = spark.createDataFrame([("p", n) for n in (0, 4, 5, 70_000, 10**12, 10**17, 10**17 + 1, 999_999_999_999_999_999)] + [("q", 5)], "__producer string, __seq long")
    ranges = spark.createDataFrame([("p", 5, 10**17), ("p", 10**17 + 5, 999_999_999_999_999_999)], "producer string, lo long, hi long")
    assert sorted(r["__seq"] for r in D.covered(numbers, ranges).collect()) == [5, 70_000, 10**12, 10**17, 999_999_999_999_999_999]
    merged = D.merge_ranges(ranges.unionByName(spark.createDataFrame([("p", 10**17 + 1, 10**17 + 4), ("p", 1, 2), ("q", 7, 9), ("q", 8, 30_000_000), ("q", 2_000_000, 2_000_001), ("q", 30_000_001, 30_000_002)], "producer string, lo long, hi long")))
    assert sorted(tuple(r) for r in merged.collect()) == [("p", 1, 2), ("p", 5, 999_999_999_999_999_999), ("q", 7, 30_000_002)]


def test_ranges_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, f"{rnd.choice('ab')}:{rnd.randint(0, 150_000) if i % 3 else rnd.randint(100, 160)}", datetime(2024, 1, rnd.randint(1, 28))) for i in range(3000)]
    first = {}
    for d, m, t in sorted(rows, key=lambda r: (r[2], r[0])):
        first.setdefault(m, d)
    want = sorted(d for d, m, _ in rows if first[m] != d)
    assert sorted(r[0] for r in D.duplicate_deliveries(frame(spark, rows).repartition(5)).collect()) == want
    lows = [rnd.randint(0, 3_000_000) for _ in range(300)]
    made = [("p", a, a + rnd.randint(0, 20_000)) for a in lows]
    held = set()
    for _, a, b in made:
        held |= set(range(a, b + 1))
    got = sorted(tuple(r) for r in D.merge_ranges(spark.createDataFrame(made, "producer string, lo long, hi long")).collect())
    assert sum(b - a + 1 for _, a, b in got) == len(held) and all(a[2] + 1 < b[1] for a, b in zip(got, got[1:]))
