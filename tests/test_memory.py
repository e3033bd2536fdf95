from datetime import datetime

import pytest
from pyspark.sql import functions as F

from engramix.api import Engine
from engramix.functions import lexical as L
from engramix.memory import Agent, Conflict
from engramix.operators import changes, evaluate, recall, retrieval, sources, temporal
from engramix.operators.predicates import Viewer
from engramix.streaming import control

T = [datetime(2024, 5, 1, 10, m) for m in range(20)]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture()
def agent(spark):
    return Agent(Engine(spark), "a1")


def test_turns_units_and_conflicts(agent):
    s = agent.session("s1")
    assert s.observe("u1", "hello there", message_id="m1", at=T[0]) == "m1"
    assert s.observe("u1", "hello there", message_id="m1", at=T[0]) is None
    with pytest.raises(Conflict):
        s.commit_unit([{"sender_id": "a1", "content": "fine", "message_id": "m2"}, {"sender_id": "u1", "content": "other", "message_id": "m1"}])
    assert agent.table("messages").count() == 1
    assert s.commit_unit([{"sender_id": "a1", "content": "fine", "message_id": "m2", "at": T[1]}]) == 1
    assert s.submit("u1", "later", at=T[2]) == 1 and s.flush() == 1
    assert [r["content"] for r in s.transcript().collect()] == ["hello there", "fine", "later"]
    s.forget_turn("m2")
    assert [r["content"] for r in s.transcript().collect()] == ["hello there", "later"] and agent.table("messages").count() == 3
    s.delete_turn("m1")
    assert agent.table("messages").count() == 2
    assert s.finalize() == 1 and s.finalize() == 1
    agent.delete_session("s1")
    assert agent.table("messages").count() == 0 and agent.table("chunks").count() == 0


def test_tools_sources_and_reads(agent):
    s = agent.session("s1")
    s.observe_tool("grep", "x", "short output", at=T[0])
    s.observe_tool("cat", "y", "# Head\n" + "word " * 400, at=T[1])
    assert [r["tool_name"] for r in s.tool_calls().collect()] == ["cat", "grep"] and [r["tool_name"] for r in s.tool_calls("grep").collect()] == ["grep"]
    assert agent.table("artifacts").count() == 1 and agent.table("actions").where("artifact_id is not null").count() == 1
    key = s.ingest('{"a": {"b": [1, 2]}, "c~/": 3}', path="x.json", artifact_id="doc")
    assert agent.outline(key)[:2] == [("/a", "object of 1"), ("/a/b", "array of 2")] and agent.read(key, "/a/b") == "[1, 2]" and agent.read(key, "/c~0~1") == "3" and agent.read(key, "/no") is None
    assert agent.artifact_bytes(key).startswith(b"{") and agent.artifact_bytes("none") is None
    agent.delete_artifact(key)
    assert agent.artifact_bytes(key) is None
    assert s.summarize() == ""
    agent.add_observation("Ann", "likes", "tea", session_id="s1", at=T[0])
    assert s.summarize() == "Ann likes tea"


def test_facts_goals_groups_and_privacy(agent):
    facts = agent.assert_fact("Ann", "likes", "tea", T[0])
    key = facts.first()["fact_id"]
    assert agent.invalidate_facts([key], T[1]).first()["invalidated_at"] == T[1]
    for m in range(6):
        agent.record_episode("plan" if m % 2 == 0 else "run", "success", at=T[m])
    assert agent.episode_chain().count() == 5
    assert [(r["first_action"], r["support"]) for r in agent.procedures().collect()] == [("plan", 3)]
    agent.record_query_episode("q", 3, False)
    agent.create_goal("g1", "top", {"a": 1})
    agent.create_goal("g2", "sub", parent="g1")
    agent.create_task("t1", "g2", "do it")
    assert [r["task_id"] for r in agent.goal_tree("g1").collect()] == ["t1"]
    assert agent.complete_goal("g1", {"a": 2, "b": 3}).where("goal_id = 'g1'").first()["metrics"] == {"a": "2", "b": "3"}
    agent.add_member("u1", "team:t1")
    agent.add_member("team:t1", "org:o1")
    assert agent.viewer("u1") == Viewer("u1", ["t1"], ["o1"])
    agent.remove_member("u1", "team:t1")
    assert agent.viewer("u1").teams == []
    agent.session("s").observe("u9", "secret")
    agent.forget_participant("u9", "ann")
    assert agent.table("messages").count() == 0 and agent.table("observations").count() == 0
    agent._add("sources", [{"source_id": "x", "name": "X"}])
    assert agent.retire_source("x", T[0]).first()["retired_at"] == T[0] and agent.restore_source("x").first()["retired_at"] is None
    agent.purge()
    assert agent.table("goals").count() == 0


def test_control():
    now = [0.0]
    clock = lambda: now[0]
    q = control.IngestQueue(2)
    q.submit({"n": 1})
    q.submit({"n": 2})
    with pytest.raises(control.Full):
        q.submit({"n": 3})
    with pytest.raises(ZeroDivisionError):
        q.drain(lambda tasks: 1 / 0)
    seen = []
    assert q.shutdown(seen.extend) == 2 and [t["n"] for t in seen] == [1, 2]
    b = control.CircuitBreaker(2, 60, clock)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(lambda: 1 / 0)
    with pytest.raises(control.Open):
        b.call(lambda: 1)
    now[0] = 61
    assert b.state == "half-open" and b.call(lambda: 7) == 7 and b.state == "closed"
    h = control.Health(300, clock)
    h.success(100)
    h.success(200)
    assert h.latency_ms == pytest.approx(29) and h.status(0, 10) == "healthy" and h.status(9, 10) == "backpressured"
    now[0] = 1000
    assert h.status(1, 10) == "stalled"
    sweeps = control.Sweeps({"topics": 2, "rules": 3}, 900, clock)
    assert [sweeps.cycle() for _ in range(6)] == [[], ["topics"], ["rules"], ["topics"], [], ["topics", "rules"]]
    assert sweeps.timer({"a": 1, "b": 0}) == ["a"] and sweeps.timer({"a": 1}) == []


def test_batch_metrics(spark):
    row = control.batch_metrics(spark.createDataFrame([(T[0], True), (T[1], None)], "at timestamp_ntz, bad boolean"), "at", "bad").first()
    assert (row["rows"], row["failures"], row["first"], row["last"]) == (2, 1, T[0], T[1])


def test_addresses_and_outlines(spark):
    text = "a,b\n1,2\n\n3,4\n"
    part = lambda address: (lambda s: s and text[slice(*s)])(sources.span_of(text, address))
    assert part("lines 2-2") == "1,2\n" and part("records 3") == "3,4\n" and part("rows 1-2") == "1,2\n\n3,4\n" and part("lines 9") is None and part("odd") is None
    assert sources.line_of(text, 4) == 2 and sources.cut_to_tokens("one two three\nfour five", 5) == ("one two three\n", True)
    assert sources.outline_of("# A\ntext\n## B") == [("lines 1-1", "A"), ("lines 3-3", "B")]
    items = spark.createDataFrame([("x", text), ("y", None)], "id string, t string")
    got = sources.read_ranges(items, spark.createDataFrame([("x", "lines 2-2"), ("x", "lines 99"), ("y", "lines 1"), ("z", "lines 1")], "id string, address string"), "id", "t").collect()
    assert [(r["id"], r["line"], r["text"], r["more"]) for r in got] == [("x", 2, "1,2\n", False)]
    assert sources.outlines(items, "id", "t").count() == 0
    old = spark.createDataFrame([("o", 0, "a"), ("o", 1, "b"), ("o", 2, "c"), ("p", 0, "x")], "owner string, index int, text string")
    new = spark.createDataFrame([("o", 0, "a"), ("o", 1, "B"), ("o", 2, "c"), ("o", 3, "d"), ("p", 0, "x")], "owner string, index int, text string")
    assert sorted((r["owner"], r["index"], r["action"]) for r in sources.refreshed(old, new, "owner").collect()) == [("o", 0, "keep"), ("o", 1, "remove"), ("o", 1, "write"), ("o", 2, "remove"), ("o", 2, "write"), ("o", 3, "write"), ("p", 0, "keep")]


def test_words_of_statements(spark):
    got = {w: one(spark, L.lemma(F.lit(w))) for w in ("got", "is_starting", "has_been_doing", "Researches", "painted", "planning", "studies", "passes", "is", "moved_to")}
    assert got == {"got": "get", "is_starting": "start", "has_been_doing": "do", "Researches": "research", "painted": "paint", "planning": "plan", "studies": "study", "passes": "pass", "is": "be", "moved_to": "moved_to"}
    assert one(spark, L.clean_object(F.lit(" in the old house. "))) == "old house" and one(spark, L.clean_object(F.lit("yesterday!"))) is None and one(spark, L.clean_object(F.lit("to it"))) is None
    assert one(spark, L.light_only(F.lit("do"), F.lit("it"))) and not one(spark, L.light_only(F.lit("do"), F.lit("dishes")))
    assert [one(spark, L.negated(F.lit(t))) for t in ("He doesn’t know", "Notes are here", "No way", None)] == [True, False, True, False]
    assert one(spark, L.entity_ref(F.lit("Ann's?"))) == "Ann" and one(spark, L.entity_ref(F.lit("A."))) is None
    assert one(spark, L.render("{a} likes {b} {c}", a=F.lit("Ann"), b=F.lit(None).cast("string"))) == "Ann likes"
    assert one(spark, L.sentences_kept_whole(F.lit("Dr. Berg met J. Doe of the U.S. Navy. Then they left at once. Fine."))) == ["Dr. Berg met J. Doe of the U.S. Navy.", "Then they left at once."]
    assert one(spark, L.sentences_kept_whole(F.lit("Yes! Fine. We agree."))) == ["Yes! Fine. We agree."] and one(spark, L.sentences_kept_whole(F.lit("Too short."))) == []
    state = F.create_map(F.lit("k"), F.lit("v=1"))
    assert [one(spark, L.precondition_holds(F.lit(r), state)) for r in ("k=v=1", "", "k", "k=v=1, x=1", None)] == [True, True, False, False, True]
    acts, p = F.array(F.lit("greet"), F.lit("inform")), lambda a, b: F.array(F.lit(a), F.lit(b))
    assert one(spark, L.act_admits(acts, p(0.9, 0.2))) and not one(spark, L.act_admits(acts, p(0.9, 0.1)))
    assert one(spark, L.dated_content(F.lit("met yesterday"), F.lit("yesterday"), F.lit(T[0]))) == "met 2024-05-01"


def test_measures_of_answers(spark):
    assert [one(spark, evaluate.judged(F.lit(t))) for t in ("Label: CORRECT", "WRONG", "first correct, then wrong", "", None, "INCORRECT")] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    ranks = spark.createDataFrame([(1, 10), (3, 30), (None, 20), (9, None)], "rank int, tokens int")
    row = evaluate.recall_summary(ranks, "rank", "tokens").first()
    assert (row["queries"], row["hit_1"], row["hit_5"], row["tokens_p50"]) == (4, 0.25, 0.5, 20) and row["mrr"] == pytest.approx((1 + 1 / 3 + 1 / 9) / 4)
    r = spark.createDataFrame([(1, "the red cat sat"), (1, "nothing")], "q int, c string")
    e = spark.createDataFrame([(1, "red cat"), (1, "blue dog"), (2, "x")], "q int, t string")
    assert {(x["q"], x["found"], x["total"]) for x in evaluate.evidence_hits(r, e, "q", "c", "t").collect()} == {(1, 1, 2), (2, 0, 1)}


def test_cascade(spark):
    items = spark.createDataFrame(
        [(1, "fact", "Ann manages the harbour budget", None, T[0]), (2, "fact", "Bob manages the choir", "private:x", T[1]), (3, "message", "The harbour budget was discussed with ORD-77", None, T[2]), (4, "message", "Nothing to see", None, T[3])],
        "nid long, label string, content string, visibility string, at timestamp_ntz",
    )
    q = spark.createDataFrame([(1, "Who manages the harbour budget?", T[5]), (2, "What about ORD-77 today?", T[5])], "query_id long, query string, asked_at timestamp_ntz")
    got = {}
    for r in recall.recall(items, q, recall.Settings(candidates=10, limit=5), viewer=Viewer("me")).collect():
        got.setdefault(r["query_id"], []).append(r["nid"])
    assert 1 in got[1] and 3 in got[2] and 2 not in got[1] + got[2]
    covered = recall.recall(items, q.where("query_id = 1"), recall.Settings(candidates=10, limit=5, coverage=0.0, least_items=1), viewer=Viewer("me")).collect()
    assert [r["nid"] for r in covered] == [1]  # the first phase is enough, so no message is asked
    drift = spark.createDataFrame([("harbour",)], "name string")
    intent = recall.intents(spark.createDataFrame([(1, "Does Ann run Harbour?")], "query_id long, query string"))
    first = spark.createDataFrame([(1, i, "fact", 1.0) for i in range(5)], "query long, nid long, label string, score double")
    assert recall.covered(first, intent, recall.Settings(coverage=0.1)).first()["enough"] and not recall.covered(first, intent, recall.Settings(coverage=0.1), drift).first()["enough"]
    with pytest.raises(ValueError):
        recall.Settings(limit=60, candidates=50).checked()
    assert recall.recall(items.where("false"), q).count() == 0


def test_terms_of_all_scripts(spark):
    docs = spark.createDataFrame([(1, "昨日は 会議 でした"), (2, "Совет проверил бюджет"), (3, "راجع المخطط النسخة"), (4, "Café Über naïve")], "d int, t string")
    q = spark.createDataFrame([(1, "会議"), (2, "бюджет"), (3, "المخطط"), (4, "über")], "query_id int, query string")
    assert {(r["query"], r["doc"]) for r in retrieval.bm25(docs, q, "d", "t").collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_changes_with_nulls_and_empty_tables(spark):
    m = spark.createDataFrame([("k1", "a", 1), ("k1", "a", 2), ("k2", None, 3), ("k2", "b", 4), (None, "c", 5)], "key string, content string, d int")
    assert {r["key"]: r["outcome"] for r in changes.ingest_outcome(m, "key", F.encode("content", "utf-8"), ["d"]).collect()} == {"k1": "replay", "k2": "conflict"}
    assert changes.ingest_outcome(m.where("false"), "key", F.encode("content", "utf-8"), ["d"]).count() == 0
    p = temporal.positions(spark.createDataFrame([("s", T[1], 1), ("s", T[0], 2), ("s", None, 3), (None, T[0], 4)], "s string, t timestamp_ntz, d int"), ["s"], "t", "d")
    assert {(r["d"], r["position"]) for r in p.collect()} == {(2, 1), (1, 2), (3, 3), (4, 1)}
