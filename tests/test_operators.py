import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from engramix import schema
from engramix.api import Engine
from engramix.functions import text as T
from engramix.operators import chunking, components, derive, evaluate, extract, fusion, graph, mutate, predicates, retrieval, temporal
from engramix.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_schema_is_complete_and_checked():
    assert len(schema.LABELS) == 26 and len(schema.EDGES) == 55
    for check, bad in ((schema.check_label, "Nope"), (schema.check_edge, "NOPE")):
        with pytest.raises(ValueError):
            check(bad)
    assert schema.check_property("Fact", "subject") == "subject"
    assert all(a == "*" or a in schema.LABELS for pair in schema.EDGES.values() for a in pair)


def test_scalars(spark):
    assert one(spark, T.canonical_name(F.lit("  ALICE   SMITH! "))) == "alice smith"
    assert one(spark, T.strip_thousands(F.lit("1,234,567 and 1,2"))) == "1234567 and 1,2"
    assert one(spark, T.search_text(F.lit("see request_id, orderId"))) == "see request_id request id orderId order Id"
    assert one(spark, T.fact_id(F.lit("Caroline"), F.lit("researches"), F.lit("adoption agencies"), F.lit("public"))) == "caroline|researches|adoption agencies"
    assert one(spark, T.laplace(F.lit(-3))) == 0.5
    assert one(spark, T.strip_html(F.lit("<p>a &amp; b</p><script>x</script><!-- c -->"))) == "a & b"
    assert one(spark, T.redact_urls(F.lit("https://me:pw@h.example/p?q=1#f x"))) == "https://h.example/p x"
    assert not one(spark, T.is_informative(F.lit("Sounds great!"), F.lit("text")))
    assert one(spark, T.mime_of(F.lit(None).cast("string"), F.unhex(F.lit("255044462D312E37")), F.lit("a.txt"))) == "application/pdf"


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    keep = lambda *tree: sorted(r["n"] for r in df.where(predicates.predicate(tree)).collect())
    assert keep("or") == keep("and") == [1, 2, 3]
    assert keep("ne", "s", "a") == [3] and keep("not", ("is_null", "s")) == [1, 3] and keep("in", "n", []) == []
    viewer = predicates.Viewer("u1", ["t1"], [])
    shown = spark.createDataFrame([(None,), ("",), ("public",), ("private:u1",), ("private:u2",), ("team:t1",), ("org:o",), ("odd:x",)], "v string").where(predicates.admits(F.col("v"), viewer))
    assert {r["v"] for r in shown.collect()} == {None, "", "public", "private:u1", "team:t1"}
    assert predicates.read_only("select 'set' from t") and not predicates.read_only("DROP table t")


def test_phrases_and_intervals(spark):
    ref = datetime(2024, 5, 15, 10, 0)  # a Wednesday
    def point(phrase):
        r = spark.createDataFrame([(phrase, ref)], "p string, t timestamp_ntz").select(temporal.resolve_phrase(F.col("p"), F.col("t")).alias("r")).first()["r"]
        return r and (r["point"], r["granularity"])
    assert point("last wednesday") == (datetime(2024, 5, 8, 10), "day")
    assert point("in may") == (datetime(2023, 5, 1, 10), "month")
    assert point("two weeks ago") == (datetime(2024, 5, 1, 10), "week")
    assert point("plain") is None
    a = spark.createDataFrame([(1, 0, 10), (2, 5, 5), (3, 100, schema.LONG_MAX)], "k int, lo long, hi long").withColumn("g", F.lit(1))
    b = spark.createDataFrame([(9, 1, 9, 10), (8, 1, 10, 20), (7, 1, 3, 3_000_000_000)], "m int, g int, lo long, hi long")
    got = sorted((r["k"], r["m_r"]) for r in temporal.overlap_join(a, b, ["g"]).collect())
    assert got == [(1, 7), (1, 9), (3, 7)]


def test_fusion(spark):
    hits = spark.createDataFrame([(1, "a", 10, 3.0), (1, "a", 11, 2.0), (1, "b", 11, 9.0), (1, "b", 12, float("nan")), (1, "b", 13, None)], "q int, l string, n int, score double")
    got = {r["n"]: r["fused"] for r in fusion.rrf(hits, ["q"], "l", "n").collect()}
    assert got == pytest.approx({10: 1 / 61, 11: 1 / 62 + 1 / 61})
    items = spark.createDataFrame([(1, 1, "red green blue", 0.9), (1, 2, "red green blue", 0.8), (1, 3, "one two", 0.7)], "q int, n int, c string, score double")
    assert [r["n"] for r in fusion.mmr(items, "q", "n", "c").orderBy("position").collect()] == [1, 3]
    packed = fusion.pack(spark.createDataFrame([(1, 1, 60, 3.0), (1, 2, 50, 2.0), (1, 3, 40, 1.0)], "q int, n int, t int, score double"), "q", "n", "t", budget=100)
    assert sorted(r["n"] for r in packed.collect()) == [1, 3]
    v = lambda *x: F.array(*[F.array(*map(F.lit, map(float, p))) for p in x])
    assert one(spark, retrieval.maxsim(v((1, 0), (0, 1)), v((1, 0), (0, 2)))) == pytest.approx(2.0)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, "A", 1.0), (2, 3, "A", None), (3, 1, "B", 1.0), (4, 5, "A", 0.0)], "src long, dst long, etype string, weight double")
    starts = spark.createDataFrame([(1,)], "start long")
    assert sorted((r["node"], r["depth"]) for r in graph.traverse(edges, starts, 5).collect()) == [(2, 1), (3, 2)]
    parts = components.components(edges.select(F.col("src").alias("id")), edges)
    assert {r["id"]: r["component"] for r in parts.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    score = {r["node"]: r["score"] for r in graph.personalised_pagerank(edges, spark.createDataFrame([(1,)], "node long"), 0.5, 2, 0.0).collect()}
    assert score == pytest.approx({1: 0.5, 2: 0.25, 3: 0.25})
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert components.components(chain.select(F.col("src").alias("id")), chain).select("component").distinct().count() == 1
    two = spark.createDataFrame([("a", "b", 2), ("b", "c", 2), ("x", "y", 1)], "a string, b string, weight int")
    assert graph.label_propagation(two).select("label").distinct().count() == 2
    assert graph.label_propagation(two, largest=1).count() == 5


def test_cooccurrence_counts_all_pairs_of_large_sources(spark):
    rows = [(1, i) for i in range(450)] + [(2, i) for i in range(0, 450, 149)] + [(None, 1), (3, None), (1, 5)]
    got = {(r["a"], r["b"]): r["weight"] for r in graph.cooccurrence(spark.createDataFrame(rows, "s int, e int"), "s", "e").collect()}
    assert got == {(a, b): 1 + (a % 149 == 0 and b % 149 == 0) for a in range(450) for b in range(a + 1, 450)}


def test_labels_are_alike_below_and_above_the_limit(spark):
    rnd = random.Random(3)
    edges = {tuple(sorted(rnd.sample(range(24), 2))): rnd.randint(1, 3) for _ in range(34)} | {(30, 31): 1}
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a int, b int, weight int")
    small, big = ({r["node"]: r["label"] for r in graph.label_propagation(frame, largest=n).collect()} for n in (50, 1))
    assert small == big and big[30] == big[31]


def test_clusters_of_a_hot_group_are_whole(spark):
    rows = [("s", f"k{i:04}", [1.0, 0.001 * (i % 5)] if i % 2 else [0.0, 1.0, 0.001 * (i % 3)]) for i in range(2100)] + [("s", "none", None), ("t", "k", [1.0, 0.0])]
    got = derive.cluster_objects(spark.createDataFrame(rows, "s string, k string, v array<double>"), ["s"], "k", "v")
    assert sorted((r["s"], r["cluster"], r["n"]) for r in got.groupBy("s", "cluster").agg(F.count("*").alias("n")).collect()) == [("s", 0, 1050), ("s", 1, 1050), ("s", 2, 1), ("t", 0, 1)]


def test_mmr_goes_beyond_its_pool(spark):
    rows = [(1, i, "red green blue", 1 - i / 10_000) for i in range(600)] + [(1, 1000 + i, f"word{i} other{i}", 0.5 - i / 100) for i in range(20)] + [(2, 1, "a b", 0.5)]
    frame = spark.createDataFrame(rows, "q int, n int, c string, score double")
    got = {tuple(r) for r in fusion.mmr(frame, "q", "n", "c", limit=5).select("q", "n", "position").collect()}
    assert got == {(1, 0, 1), (1, 1000, 2), (1, 1001, 3), (1, 1002, 4), (1, 1003, 5), (2, 1, 1)}
    rnd = random.Random(2)
    mixed = spark.createDataFrame([(1, i, " ".join(rnd.sample("abcdefgh", 3)), rnd.random()) for i in range(60)], "q int, n int, c string, score double")
    small, whole = (fusion.mmr(mixed, "q", "n", "c", limit=9, pool=n).orderBy("position").collect() for n in (2, 500))
    assert small == whole


def test_mutations(spark):
    m = spark.createDataFrame([(1, "s", "a", None, 1), (2, "s", "b", [], 2), (3, "s", "a", ["z"], 3)], "d int, s string, p string, t array<string>, at int")
    assert sorted(map(tuple, mutate.recipients(m, "s", "p", "t", "at", "d").collect())) == [(2, "a"), (3, "z")]
    r = spark.createDataFrame([("x", "r1", 1), ("x", "r2", 2), ("y", None, 1)], "s string, r string, o int")
    assert {(x["s"], x["r"]): x["superseded"] for x in mutate.superseded(r, "s", "r", ["o"]).collect()} == {("x", "r1"): True, ("x", "r2"): False, ("y", None): False}


def test_chunkers():
    text = "# Head\n\n" + "\n\n".join(f"Paragraph {i} has some words in it. And one more sentence." for i in range(40))
    found = chunking.text_chunks(text, chunking.Limits(60, 10, 8))
    assert all(chunking.tokens(c["text"]) <= 60 + 12 for c in found) and found[0]["heading"] == "Head" and found[-1]["end"] == len(text)
    assert all(text[c["start"] : c["end"]] == c["text"] for c in found) and all(a["end"] > b["start"] for a, b in zip(found, found[1:]))
    assert chunking.text_chunks("  \n ") == []
    code = "import x\n\ndef a():\n    return 1\n\nclass B:\n    pass\n"
    assert "".join(c["text"] for c in chunking.code_chunks(code, chunking.Limits(8, 1, 0))) == code
    data = '{"a": [' + ", ".join('{"n": %d, "t": "some words here"}' % i for i in range(50)) + '], "b/c": 1}'
    assert all(chunking.tokens(c["text"]) <= 80 for c in chunking.json_chunks(data, chunking.Limits(80, 1, 0)))
    rows = "a,b\n" + "\n".join(f"{i},x|y" for i in range(30))
    assert chunking.row_chunks(rows, ",", chunking.Limits(60, 1, 0))[0]["text"].startswith("| a | b |")
    assert chunking.html_chunks("<h1>T</h1><p>Hello <b>you</b></p><script>no</script>")[0]["heading"] == "T"
    kinds = {'{"a": 1}': "json", '{"a":1}\n{"a":2}': "ndjson", "a,b\n1,2\n3,4": "delimited", "plain words": "text", "| a | b |\n|---|---|\n| 1 | 2 |": "table", "@@ -1 +1 @@\n--- a\n+++ b": "diff", "\n".join(["2024-05-25T14:29 INFO x"] * 4): "log", "<html><body>x": "html"}
    assert {k: chunking.detect(k) for k in kinds} == kinds


def test_extraction(spark):
    df = spark.createDataFrame([(1, "I love green tea. Mail a@b.example on 2024-05-01, says Anna Berg. It is 5 km."), (2, None)], "id int, t string")
    got = {(r["entity_type"], r["name"]) for r in extract.entities(df, "id", "t").collect()}
    assert {("email", "a@b.example"), ("date", "2024-05-01"), ("person", "anna berg"), ("measurement", "5 km"), ("preference", "green tea")} <= got
    assert one(spark, extract.literals(F.lit('Where is "blue door" in src/foo.rs for ORD-48213, orderId and APAC?'))) == ["blue door", "src/foo.rs", "ORD-48213", "orderId", "APAC"]


def test_measures(spark):
    assert one(spark, evaluate.token_f1(F.lit("The red cat"), F.lit("a red dog"))) == pytest.approx(0.5)
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1)], "q int, i string, rank int")
    right = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y")], "q int, i string")
    got = {r["q"]: (round(r["recall"], 4), round(r["mrr"], 4)) for r in evaluate.ranking_measures(ranked, right, "q", "i", "rank", 5).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0)}


def test_engine(spark):
    engine = Engine(spark)
    engine.tables["facts_raw"] = spark.createDataFrame([(1, "a"), (2, "b")], "nid long, s string")
    engine.define_rule("some", "select nid from facts_raw where nid >= :least")
    assert [r["nid"] for r in engine.run_rule("some", least=2).collect()] == [2]
    other = engine.assume(adds={"facts_raw": spark.createDataFrame([(3, "c")], "nid long, s string")})
    assert other.run_rule("some", least=2).count() == 2 and engine.run_rule("some", least=2).count() == 1
    assert engine.abduce("some", [("add", 1.0, other), ("none", 0.5, engine)], least=3) == [("add", 1.0, 1)]
    with pytest.raises(ValueError):
        engine.query("delete from facts_raw")
    assert engine.query("select * from facts_raw", allow=spark.createDataFrame([(2,)], "nid long")).count() == 1


def test_step_chain(spark):
    rows, dead = ingest.step_chain(spark.createDataFrame([(1, "a"), (2, None)], "n int, s string"), [("named", lambda d: d, "s is not null"), ("small", lambda d: d.withColumn("m", F.col("n") * 2), "m < 10")])
    assert rows.count() == 1 and [r["step"] for r in dead.collect()] == ["named"]


def test_stream_keeps_one_copy(spark, tmp_path):
    schema_ = "delivery_id long, message_id string, msg_timestamp timestamp_ntz"
    at = datetime(2024, 1, 1)
    src = tmp_path / "in"
    spark.createDataFrame([(1, "p:1", at), (2, "p:1", at), (3, "x", at)], schema_).coalesce(1).write.parquet(str(src))
    log = ingest.DeliveryLog(spark, str(tmp_path / "out"))
    run = lambda: spark.readStream.schema(schema_).parquet(str(src)).writeStream.foreachBatch(log).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([(4, "p:1", at), (5, "p:2", at), (6, "X", at)], schema_).coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert sorted(r["delivery_id"] for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()) == [1, 3, 5]
