from datetime import datetime, timedelta

from pyspark.sql import functions as F

from engramix.llm import conversations as C
from engramix.llm import plan_conversations as plan
from tests.test_oracles import database, rows

SCHEMA = "delivery_id long, message_id string, content string, sender_id string, session_id string, addressed_to array<string>, msg_timestamp timestamp_ntz, metadata map<string,string>, role string, depth int"
AT = datetime(2024, 1, 1)


def people(spark):
    return spark.createDataFrame([("h", " Human", "x"), ("h", "human", "x"), ("a", "AGENT", "x"), ("s", "system", None), (None, "human", "x"), ("n", None, "x")], "participant_id string, kind string, role string")


def msg(i, who, session, minute=None, text="words", to=None, reply=None, key=None):
    return (i, key or f"m{i}", text, who, session, to, AT + timedelta(minutes=i if minute is None else minute), {"reply_to": reply} if reply else None, "clash", 9)


def turns(spark, data):
    got = C.rebuild(spark.createDataFrame(data, SCHEMA), people(spark)).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["session_id"], r["turn_no"])):
        out.setdefault(r["session_id"], []).append((r["turn_no"], r["message_id"], r["role"]))
    return out


def test_sound_and_unsound_sessions(spark):
    data = [
        msg(1, "h", "ok"), msg(2, "a", "ok", text="​ \n"), msg(3, "a", "ok"), msg(4, "h", "ok", to=["h"]), msg(3, "a", "ok", key=" M3 "),
        msg(10, "h", "blank", text=" "), msg(11, "a", "blank", text=None), msg(12, None, "stranger"), msg(13, "h", "stranger"), msg(14, "a", "stranger"),
        msg(20, "h", "broken"), msg(21, "a", "broken", reply="gone"), msg(30, "a", "no reply"), msg(31, "h", "no reply"), msg(40, "h", "alone"), msg(50, "h", "to agent"), msg(51, "a", "to agent"), msg(52, "h", "to agent", to=["h", "a"]), msg(60, "h", None), msg(61, "a", " "),
        msg(70, "x", "unknown"), msg(71, "a", "unknown"), msg(72, "h", "unknown"), msg(73, "a", "unknown"), msg(80, "h", "kindless"), msg(81, "n", "kindless"), msg(82, "a", "kindless"),
    ]
    got = turns(spark, data)
    assert sorted(got) == ["kindless", "ok"]
    assert got["ok"] == [(1, "m1", "human"), (2, "m3", "agent"), (3, "m4", "human")]


def test_equal_times_follow_the_answers(spark):
    data = [msg(5, "a", "s", 1, reply="m9"), msg(9, "h", "s", 1), msg(2, "h", "s", 1, reply="m5"), msg(1, "a", "s", 1, reply="m2")]
    assert [t[1] for t in turns(spark, data)["s"]] == ["m9", "m5", "m2", "m1"]


def test_circle_of_answers_and_empty_table(spark):
    data = [msg(1, "h", "s", 1, reply="m2"), msg(2, "a", "s", 1, reply="m1")]
    assert [t[1] for t in turns(spark, data)["s"]] == ["m1", "m2"]
    assert turns(spark, []) == {}


def test_long_sessions_over_days(spark):
    data = [msg(i, "ha"[i % 2], "s", i * 60) for i in range(200)]
    assert [t[0] for t in turns(spark, data)["s"]] == list(range(1, 201))


def test_gaps(spark):
    df = spark.createDataFrame([("c", AT + timedelta(minutes=m), i) for i, m in enumerate([0, 1, 2, 500, 501, 502, 1500])], "c string, ts timestamp_ntz, delivery int")
    assert C.calibrated_gap(df, ["c"], share=0.5) == 120.0
    assert [r["part"] for r in C.split_at_gaps(df, ["c"], 3600).orderBy("delivery").collect()] == [1, 1, 1, 2, 2, 2, 3]


def test_queries_equal_sql(spark, folder):
    for name in plan.QUERIES:
        got, want = plan.QUERIES[name](spark, folder).toPandas(), database(folder).execute(plan.SQL[name]).df()
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_a_long_chain_of_equal_times(spark):
    """Answers of one time are ordered however long their chain is; what answers into a circle keeps its place."""
    n = 70
    data = [msg(n - i, "ha"[i % 2], "s", 1, reply=f"m{n - i + 1}" if i else None) for i in range(n)]
    assert [t[1] for t in turns(spark, data)["s"]] == [f"m{n - i}" for i in range(n)]
