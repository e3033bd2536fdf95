from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from engramix.llm import containers as C


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_uses_every_item_once(sizes):
    steps = C.plan(Counter(sizes), 40)
    used = Counter()
    for pattern, times in steps:
        assert sum(pattern) <= 40 and times > 0
        for s in pattern:
            used[s] += times
    assert used == Counter(sizes)
    bins = sum(times for _, times in steps)
    assert bins <= max(1, 2 * -(-sum(sizes) // 40))


def test_exact_fills_come_first():
    assert C.plan({30: 2, 10: 2, 25: 1, 15: 1}, 40) == [((30, 10), 2), ((25, 15), 1)]
    assert C.plan({20: 1, 10: 1, 6: 1, 4: 1}, 40) == [((20, 10, 6, 4), 1)]


def test_rows(spark):
    words = "one two three four five "
    rows = [(1, words * 900, 1), (2, words, 1), (2, words, 1), (3, None, 1), (4, "", 1), (None, words * 3, 2)] + [(10 + i, words * (i % 40 + 1), 3) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = C.pack(df, capacity=256).collect()
    fill = Counter()
    for r in got:
        assert (r["container_id"] is None) == (r["tokens"] == 0)
        if r["container_id"] is not None:
            fill[r["container_id"]] += r["tokens"]
    assert max(fill.values()) <= 256 and sum(fill.values()) / (256 * len(fill)) > 0.97
    parts = sorted((r["part_no"], r["start_token"], r["tokens"]) for r in got if r["doc_id"] == 1)
    assert [p[1] for p in parts] == [i * 256 for i in range(len(parts))] and all(p[2] == 256 for p in parts[:-1])
    assert all(r["part_no"] == 1 for r in got if r["doc_id"] != 1) and len({r["doc_id"] for r in got}) == 305
    assert C.pack(df.where("false")).count() == 0
