import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engramix.llm import pieces as P


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c.,\n。้ก王é́‍", min_size=0, max_size=900), st.integers(20, 90), st.integers(0, 15))
def test_round_trip_and_limits(text, most, overlap):
    found = P.split(text, most, overlap)
    assert "".join(text[f:e] for _, f, e in found) == text
    assert all(e - s <= most and f - s <= overlap for s, f, e in found)
    assert all(a[2] == b[1] and b[0] >= a[0] for a, b in zip(found, found[1:]))


def test_natural_boundaries():
    text = ("One sentence stands here. " * 12 + "\n\n") * 12
    ends = [text[e - 2 : e] for _, _, e in P.split(text, 700, 50)][:-1]
    assert ends and all(x == "\n\n" for x in ends)
    starts = [text[s - 1 : s + 1] for s, f, _ in P.split(text, 700, 50)][1:]
    assert all(x[0].isspace() and not x[1].isspace() for x in starts)


def test_text_without_breaks_and_marks():
    text = "กำ้" * 3000
    found = P.split(text)
    assert all(e - s <= 1500 for s, _, e in found) and "".join(text[f:e] for _, f, e in found) == text
    assert P.split("x" * 4000)[1][1] - P.split("x" * 4000)[1][0] == 150


def test_rows(spark):
    df = spark.createDataFrame([("a", "short", 1), ("b", "long words " * 400, 2), ("b", "long words " * 400, 2), ("c", None, 3), ("d", "", 4), (None, "   ", 5)], "key string, body string, piece int")
    got = P.pieces(df, "key", "body").collect()
    assert sorted({(r["key"] or "-", r["piece_no"]) for r in got}) == [("-", 1), ("a", 1), ("b", 1), ("b", 2), ("b", 3), ("b", 4)]
    assert sum(r["key"] == "b" for r in got) == 8
    assert P.pieces(df.where("false"), "key", "body").count() == 0
    with pytest.raises(ValueError):
        P.pieces(df, "key", "body", 100, 100)
