"""Recall over a table of questions: both phases, their channels and boosts, searches over several fields and labels, and measures of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.functions import lexical as L
from engramix.functions import text as T
from engramix.operators import evaluate, fusion, recall, retrieval
from engramix.plans.model import mentions, messages, sql_key, sql_mentions, sql_messages, sql_name
from engramix.sources.tables import read


def questions(spark, folder):
    """Every view whose id is divisible by 20 and that asks something, as a question."""
    v = read(spark, folder, "message_views", "view_id", "content", "msg_timestamp").where("view_id % 20 = 0 and content like '%?%'")
    return v.select(F.col("view_id").alias("query_id"), F.col("content").alias("query"), F.col("msg_timestamp").alias("asked_at"))


def facts(spark, folder):
    f = read(spark, folder, "fact_upserts", "upsert_id", "subject", "predicate", "object", "visibility")
    return f.select((F.col("upsert_id") + 1_000_000_000).alias("nid"), F.lit("fact").alias("label"), F.concat_ws(" ", "subject", F.replace("predicate", F.lit("_"), F.lit(" ")), "object").alias("content"), "visibility")


def views(spark, folder):
    v = read(spark, folder, "message_views", "view_id", "content", "visibility", "msg_timestamp", "session_id").where("content is not null")
    return v.select(F.col("view_id").alias("nid"), F.lit("message").alias("label"), "content", "visibility", F.col("msg_timestamp").alias("at"), "session_id")


def recall_compact(spark, folder):
    """First phase: the best facts of every question."""
    first = recall.compact(facts(spark, folder), recall.intents(questions(spark, folder)))
    return first.select("query", "nid", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


def recall_coverage(spark, folder):
    """Which questions the first phase covers."""
    intent = recall.intents(questions(spark, folder))
    gate = recall.covered(recall.compact(facts(spark, folder), intent), intent, recall.Settings(coverage=0.4))
    return gate.select("query", "items", F.round("coverage", 6).alias("coverage"), "enough")


def recall_temporal(spark, folder):
    """Messages in the window of time phrases, asked at the end of each month of the data."""
    phrases = spark.createDataFrame([(1, "what happened yesterday?"), (2, "who called last week?"), (3, "what was agreed last month?"), (4, "what did we say two days ago?")], "no int, query string")
    m = messages(spark, folder).where("at is not null")
    ends = m.select(F.date_trunc("MONTH", "at").cast("timestamp_ntz").alias("asked_at")).distinct()
    asked = ends.crossJoin(F.broadcast(phrases)).select((F.year("asked_at") * 10_000 + F.month("asked_at") * 100 + F.col("no")).cast("long").alias("query_id"), "query", "asked_at")
    hits = recall.temporal_hits(m.select(F.col("delivery_id").alias("nid"), "at"), recall.intents(asked, "asked_at"))
    return hits.groupBy("query").agg(F.count("*").alias("messages"), F.min("nid").alias("first"))


def _graph(spark, folder):
    """Messages, the names they mention and their sessions as edges."""
    n = mentions(spark, folder).where("key is not null and name <> ''").select("key", "name").distinct()
    m = messages(spark, folder, "session_id").where("session_id is not null")
    edge = lambda df, src, dst, etype: df.select(src.alias("src"), dst.alias("dst"), F.lit(etype).alias("etype"), F.lit(None).cast("double").alias("weight"))
    return edge(n, F.col("key"), F.concat(F.lit("name:"), F.col("name")), "MENTIONS").unionByName(edge(m.join(n.select("key").distinct(), "key", "left_semi"), F.col("key"), F.concat(F.lit("session:"), F.col("session_id")), "IN_SESSION"))


def recall_graph(spark, folder):
    """Messages that activation reaches in three rounds from the people whom a fact of management names, one query each."""
    f = read(spark, folder, "fact_upserts", "upsert_id", "subject", "predicate").where("lower(predicate) = 'manages' and subject is not null")
    edges = _graph(spark, folder)
    start = f.select(F.col("upsert_id").alias("query"), F.concat(F.lit("name:"), T.canonical_name(F.col("subject"))).alias("node")).join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
    dropped = edges.select(F.col("dst").alias("node")).distinct()
    hits = recall.graph_hits(edges, start.select("query", "node"), dropped, rounds=3)
    return hits.groupBy("query").agg(F.count("*").alias("messages"), F.round(F.sum("score"), 8).alias("activation"))


def _scored(spark, folder):
    r = read(spark, folder, "recall_items", "query_id", "node_id", "kind", "score").where("score is not null and not isnan(score) and node_id is not null")
    return r.groupBy(F.col("query_id").alias("query"), F.col("node_id").alias("nid")).agg(F.max("score").alias("score"), F.max("kind").alias("label"))


def session_boosted(spark, folder):
    """Recalled items with a tenth of the scores of the facts that their source supports."""
    scored = _scored(spark, folder)
    held = read(spark, folder, "recall_items", "node_id", "source_id").where("node_id is not null and source_id is not null").select(F.col("node_id").alias("nid"), F.col("source_id").alias("session")).distinct()
    return recall.session_boost(scored.select("query", "nid", "score"), scored, held, held, 0.1).select("query", "nid", F.round("score", 6).alias("score"))


def type_boosted(spark, folder):
    """Recalled items that carry what a question wants, by the label that the search found them under."""
    s = read(spark, folder, "scored_rows", "node_id", "label").where("node_id is not null").select(F.col("node_id").alias("nid"), F.lower("label").alias("kind")).distinct()
    scored = _scored(spark, folder)
    wants = scored.groupBy("query").agg(F.max_by("label", F.struct("score", "nid")).alias("wanted")).withColumnRenamed("query", "query_id")
    return recall.type_boost(scored.select("query", "nid", "score"), wants, s, 1.2).select("query", "nid", F.round("score", 6).alias("score"))


def recall_expanded(spark, folder):
    """Second phase: full text and literals of all questions over views, fused by weighted reciprocal ranks, with the three best facts."""
    intent = recall.intents(questions(spark, folder))
    v = views(spark, folder)
    text = retrieval.bm25(v, recall.asked(intent), "nid", "content").select("query", F.col("doc").alias("nid"), "score")
    fused = recall.fused_lists([("text", text, 1.0), ("literals", recall.literal_hits(v, intent), 2.0)])
    second = fused.select("query", "nid", (F.col("fused") * 0.4).alias("score"))
    first = recall.compact(facts(spark, folder), intent)
    return recall.with_first(second, first, 3).select("query", "nid", F.round("score", 9).alias("score"))


def question_keywords(spark, folder):
    q = recall.intents(questions(spark, folder))
    return q.select("query_id", F.array_join("keywords", " ").alias("keywords"), "wanted")


def multi_field_search(spark, folder):
    """Evaluation questions over passages and answers: of every item its best field."""
    i = read(spark, folder, "eval_items", "item_id", "question", "passage", "answer").withColumn("answer", F.coalesce("answer", F.lit("")))
    asked = i.select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    best = retrieval.multi_field(i, asked, "item_id", ["answer", "passage"])
    return retrieval.top_k(best, 5, ["query"], "doc").select("query", "doc", "field", F.round("score", 6).alias("score"))


def hybrid_weighted(spark, folder):
    """Half of the cosine and half of BM25 for every vector whose id is divisible by 20 and the text of the same id."""
    e = read(spark, folder, "embeddings", "vec_id", "embedding")
    asked = e.where("vec_id % 20 = 0")
    near = retrieval.exact_nearest(e, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 20, "vec_id", "embedding").select("query", "id", "score")
    d = read(spark, folder, "documents", "doc_id", "text")
    opening = d.join(asked.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(T.search_terms(F.col("text")), 1, 12), " ").alias("query"))
    text = retrieval.top_k(retrieval.bm25(d, opening, "doc_id", "text"), 20, ["query"], "doc").select("query", F.col("doc").alias("id"), "score")
    both = retrieval.weighted_hybrid(near, text)
    return retrieval.top_k(both, 10, ["query"], "id").select("query", "id", F.round("score", 5).alias("score"))


def multi_label_nearest(spark, folder):
    """The five nearest of facts and embeddings together to every embedding whose id is divisible by 20."""
    e = read(spark, folder, "embeddings", "vec_id", "embedding").where("size(embedding) = 64")
    f = read(spark, folder, "fact_upserts", "upsert_id", "embedding").where("size(embedding) = 64").select((F.col("upsert_id") + 1_000_000_000).alias("vec_id"), "embedding")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = retrieval.exact_nearest(e.unionByName(f), asked, 5, "vec_id", "embedding")
    return near.select("query", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


def lexical_chunks(spark, folder):
    """Lines of artifacts found by the words of their own titles (paths), with the session of their owner."""
    from engramix.operators.sources import line_chunks

    a = read(spark, folder, "ingest_artifacts", "artifact_id", "content", "path", "session_id")
    lines = line_chunks(a, "artifact_id", "content").where("trim(text) <> ''").select(F.concat_ws(":", "artifact_id", "index").alias("nid"), "text", "artifact_id")
    asked = a.where("path is not null").select(F.regexp_extract("path", r"^/([^/]+)/", 1).alias("query")).where("query <> ''").distinct().select(F.col("query").alias("query_id"), "query")
    found = retrieval.top_k(retrieval.bm25(lines, asked, "nid", "text"), 10, ["query"], "doc")
    owned = found.withColumn("artifact_id", F.substring_index("doc", ":", 1)).join(a.select("artifact_id", "session_id"), "artifact_id")
    return owned.select("query", F.col("doc").alias("chunk"), "session_id", F.round("score", 6).alias("score"))


def late_interaction(spark, folder):
    """MaxSim of facts in windows of four: the first two vectors of a subject against the next two, by cosine."""
    from engramix.operators.temporal import positions

    f = read(spark, folder, "fact_upserts", "upsert_id", "subject", "observed_at", "embedding").where("subject is not null and size(embedding) = 64")
    placed = positions(f.select("subject", "observed_at", "upsert_id", "embedding"), ["subject"], "observed_at", "upsert_id").where("position <= 4")
    listed = placed.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "embedding"))), lambda x: x["embedding"]).alias("v")).where("size(v) = 4")
    return listed.select("subject", F.round(retrieval.maxsim(F.slice("v", 1, 2), F.slice("v", 3, 2)), 4).alias("score"))


def answer_hits(spark, folder):
    """Share of recalled items among the five best of the dense channel, in all and by kind: ratios of sums."""
    r = read(spark, folder, "recall_items", "query_id", "node_id", "kind").where("node_id is not null").distinct()
    s = read(spark, folder, "scored_rows", "query_id", "channel", "node_id", "score").where("channel = 'dense' and score is not null and not isnan(score) and node_id is not null").groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    top = retrieval.top_k(s, 5, ["query_id"], "node_id").select("query_id", "node_id").withColumn("hit", F.lit(1))
    joined = r.join(top, ["query_id", "node_id"], "left")
    return joined.rollup("kind").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("found"), F.count("*").alias("total"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("rate"))


def recall_summary(spark, folder):
    """Of all queries: how often the best item is among the first one or five of the earlier run, reciprocal rank, and the upper median of tokens."""
    r = read(spark, folder, "recall_items", "query_id", "item_no", "node_id", "score", "token_count").where("score is not null and not isnan(score) and node_id is not null")
    s = read(spark, folder, "scored_rows", "query_id", "channel", "node_id", "score").where("channel = 'reranker' and score is not null and not isnan(score) and node_id is not null").groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    right = retrieval.top_k(s, 1, ["query_id"], "node_id").select("query_id", "node_id")
    ranked = retrieval.top_k(r, 50, ["query_id"], "item_no").select("query_id", "node_id", "rank", "token_count")
    first = right.join(ranked, ["query_id", "node_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    tokens = ranked.where("rank <= 5").groupBy("query_id").agg(F.sum("token_count").alias("tokens"))
    return evaluate.recall_summary(first.join(tokens, "query_id", "left"), "rank", "tokens").select("queries", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_5", "mrr")], "tokens_p50")


def evidence_found(spark, folder):
    """Which evaluation answers stand in the context that full text finds for their question, at 1 and at 5."""
    i = read(spark, folder, "eval_items", "item_id", "question", "passage", "answer")
    scored = retrieval.bm25(i, i.select(F.col("item_id").alias("query_id"), F.col("question").alias("query")), "item_id", "passage")
    ranked = retrieval.top_k(scored, 5, ["query"], "doc").join(i.select(F.col("item_id").alias("doc"), "passage"), "doc").select(F.col("query").alias("item_id"), "rank", "passage")
    gold = i.where("answer is not null").select("item_id", "answer")
    return evaluate.contains_at(ranked, gold, "item_id", "passage", "answer", "rank", (1, 5)).select("item_id", "at_1", "at_5")


def smoothed_values(spark, folder):
    """Exponential moving average of the values of each user's events, a tenth of each new one."""
    e = read(spark, folder, "events", "event_id", "user_id", "ts", "value").where("value is not null")
    return evaluate.moving_average(e, "user_id", "ts", "event_id", "value", 0.1).select("user_id", F.round("ema", 6).alias("ema"))


def predicate_lemmas(spark, folder):
    f = read(spark, folder, "fact_upserts", "predicate").where("predicate is not null")
    return f.groupBy(L.normal_predicate(F.col("predicate")).alias("predicate"), L.lemma(F.col("predicate")).alias("lemma")).agg(F.count("*").alias("facts"))


def clean_objects(spark, folder):
    f = read(spark, folder, "fact_upserts", "upsert_id", "object").where("object is not null")
    return f.select("upsert_id", L.clean_object(F.col("object")).alias("object"), L.entity_ref(F.col("object")).alias("ref"))


def negated_messages(spark, folder):
    m = read(spark, folder, "ingest_messages", "content").where("content is not null")
    return m.groupBy(L.negated(F.col("content")).alias("negated")).agg(F.count("*").alias("messages"))


def embedding_texts(spark, folder):
    f = read(spark, folder, "fact_upserts", "upsert_id", "subject", "predicate", "object", "observed_at")
    return f.select("upsert_id", L.embedding_text(F.col("observed_at"), F.col("subject"), F.lower("predicate"), F.col("object"), F.lit("nothing")).alias("text"))


def whole_sentences(spark, folder):
    """Sentences of all passages, not cut after titles and initials."""
    i = read(spark, folder, "eval_items", "item_id", "passage").where("passage is not null")
    return i.select("item_id", F.size(L.sentences_kept_whole(F.col("passage"))).alias("sentences"), F.length(F.element_at(L.sentences_kept_whole(F.col("passage")), 1)).alias("first_chars"))


def preconditions_met(spark, folder):
    """Messages whose metadata meet one of three rules."""
    m = read(spark, folder, "ingest_messages", "metadata").where("metadata is not null")
    rules = {"cli": "client=cli", "odd": "client=cli,client=web", "any": ""}
    return m.agg(*[F.count_if(L.precondition_holds(F.lit(rule), F.col("metadata"))).alias(name) for name, rule in rules.items()])


QUERIES = {f.__name__: f for f in (
    recall_compact, recall_coverage, recall_temporal, recall_graph, session_boosted, type_boosted, recall_expanded, question_keywords, multi_field_search, hybrid_weighted, multi_label_nearest, lexical_chunks, late_interaction,
    answer_hits, recall_summary, evidence_found, smoothed_values, predicate_lemmas, clean_objects, negated_messages, embedding_texts, whole_sentences, preconditions_met,
)}

_SPLIT = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in recall.STOP)
_Q = f"""q0 AS (SELECT view_id AS query, content AS c, {_SPLIT.format('content')} AS w FROM message_views WHERE view_id % 20 = 0 AND content LIKE '%?%'), q1 AS (SELECT query, c, w, list_filter(w, lambda x: x NOT IN ({_STOP})) AS k FROM q0),
    q AS (SELECT query, c, list_distinct(CASE WHEN len(k) > 0 THEN k ELSE w END) AS k FROM q1), qt AS (SELECT DISTINCT query, unnest(k) AS term FROM q)"""


def _bm25(name: str, docs: str, doc: str, text: str, asked: str) -> str:
    """CTEs that end in ``name`` (query, doc, score)."""
    return f"""{name}t AS (SELECT {doc} AS doc, unnest({_SPLIT.format(text)}) AS term FROM {docs}), {name}l AS (SELECT doc, count(*) AS dl FROM {name}t GROUP BY 1), {name}s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}l),
    {name}h AS (SELECT doc, term, count(*) AS tf FROM {name}t WHERE term IN (SELECT term FROM {asked}) GROUP BY 1, 2), {name}d AS (SELECT term, count(*) AS df FROM {name}h GROUP BY 1),
    {name} AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {name}h JOIN {asked} USING (term) JOIN {name}d USING (term) JOIN {name}l USING (doc), {name}s GROUP BY 1, 2)"""


_FACTS = "f AS (SELECT upsert_id + 1000000000 AS nid, concat_ws(' ', subject, replace(predicate, '_', ' '), object) AS content FROM fact_upserts)"
_FIRST = f"{_Q}, {_FACTS}, {_bm25('fb', 'f', 'nid', 'content', 'qt')}, first AS (SELECT query, doc AS nid, score / (1 + score) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score / (1 + score), 9) DESC, doc) AS rank FROM fb QUALIFY rank <= 20)"
_R = "r AS (SELECT query_id AS query, node_id AS nid, max(score) AS score, max(kind) AS label FROM recall_items WHERE score IS NOT NULL AND NOT isnan(score) AND node_id IS NOT NULL GROUP BY 1, 2)"
_VEC = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_COS = f"({_VEC} / (sqrt({_VEC.format('{0}', '{0}')}) * sqrt({_VEC.format('{1}', '{1}')})))"
_ANSWER = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the', 'and'))"
_STEP = "SELECT query, node, sum(s) AS score FROM (SELECT query, dst AS node, score * p * 0.85 AS s FROM {0} JOIN st ON node = src UNION ALL SELECT query, node, score * 0.15 FROM s0) GROUP BY 1, 2"
_LITERALS = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(c, '["“`][^"”`]+["”`]', ' ', 'g'), '[ \t\n\r\f\v]+'), lambda w: regexp_replace(w, '^[?,.!;:()\[\]''"]+|[?,.!;:()\[\]''"]+$', '', 'g')), lambda w: w <> '' AND (regexp_matches(w, '[0-9]') OR regexp_matches(w, '[\p{L}\p{N}].*[_\-./:@#].*[\p{L}\p{N}]') OR regexp_matches(w, '\p{Ll}\p{Lu}')
    OR (regexp_full_match(w, '[A-Z0-9]+') AND len(regexp_replace(w, '[^A-Z]', '', 'g')) >= 2)))"""

SQL = {
    "recall_compact": f"WITH {_FIRST} SELECT query, nid, rank::INT AS rank, round(score, 6) AS score FROM first",
    "recall_coverage": f"""WITH {_FIRST}, a AS (SELECT query, count(*) AS items, avg(score) AS mean FROM first GROUP BY 1), b AS (SELECT q.query, coalesce(items, 0) AS items, 0.4 * least(coalesce(items, 0) / greatest(len(k), 1), 1) + 0.3 * least(greatest(coalesce(mean, 0), 0), 1) + CASE WHEN items > 0 THEN 0.06 ELSE 0 END AS coverage FROM q LEFT JOIN a USING (query))
        SELECT query, items, round(coverage, 6) AS coverage, coverage >= 0.4 AND items >= 3 AS enough FROM b""",
    "recall_temporal": f"""WITH {sql_messages()}, e AS (SELECT DISTINCT date_trunc('month', sent)::TIMESTAMP AS t FROM m WHERE sent IS NOT NULL), w AS (SELECT t, unnest([{{'n': 1, 'lo': date_trunc('day', t - INTERVAL 1 DAY)::TIMESTAMP, 'hi': date_trunc('day', t)::TIMESTAMP}}, {{'n': 2, 'lo': t - INTERVAL 7 DAY, 'hi': t}},
          {{'n': 3, 'lo': date_trunc('month', t - INTERVAL 30 DAY)::TIMESTAMP, 'hi': date_trunc('month', t - INTERVAL 30 DAY)::TIMESTAMP + INTERVAL 1 MONTH}}, {{'n': 4, 'lo': date_trunc('day', t - INTERVAL 2 DAY)::TIMESTAMP, 'hi': date_trunc('day', t - INTERVAL 1 DAY)::TIMESTAMP}}]) AS w FROM e)
        SELECT (year(t) * 10000 + month(t) * 100 + w.n)::BIGINT AS query, count(*) AS messages, min(delivery_id) AS first FROM w JOIN m ON sent >= w.lo AND sent < w.hi GROUP BY 1""",
    "recall_graph": f"""WITH {sql_messages('session_id')}, {sql_mentions()}, e0 AS (SELECT DISTINCT key, name FROM n WHERE key IS NOT NULL AND name <> ''), e AS (SELECT key AS a, 'name:' || name AS b, 1.0 AS w FROM e0 UNION ALL SELECT key, 'session:' || session_id, 0.3 FROM m WHERE session_id IS NOT NULL AND key IN (SELECT key FROM e0)),
        d AS (SELECT src, dst, sum(w) AS w FROM (SELECT a AS src, b AS dst, w FROM e UNION ALL SELECT b, a, w FROM e) GROUP BY 1, 2), st AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM d),
        sd AS (SELECT DISTINCT upsert_id AS query, 'name:' || {sql_name('subject')} AS node FROM fact_upserts WHERE lower(predicate) = 'manages' AND subject IS NOT NULL AND 'name:' || {sql_name('subject')} IN (SELECT b FROM e)), s0 AS (SELECT query, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY query) AS score FROM sd),
        s1 AS ({_STEP.format('s0')}), s2 AS ({_STEP.format('s1')}), s3 AS ({_STEP.format('s2')}) SELECT query, count(*) AS messages, round(sum(score), 8) AS activation FROM s3 WHERE node NOT IN (SELECT b FROM e) GROUP BY 1""",
    "session_boosted": f"""WITH {_R}, h AS (SELECT DISTINCT node_id AS nid, source_id AS session FROM recall_items WHERE node_id IS NOT NULL AND source_id IS NOT NULL), b AS (SELECT query, session, sum(score) AS boost FROM r JOIN h USING (nid) WHERE label = 'fact' GROUP BY 1, 2),
        c AS (SELECT query, nid, sum(boost) AS boost FROM b JOIN h USING (session) GROUP BY 1, 2) SELECT query, nid, round(score + 0.1 * coalesce(boost, 0), 6) AS score FROM r LEFT JOIN c USING (query, nid)""",
    "type_boosted": f"""WITH {_R}, w AS (SELECT query, arg_max(label, (score, nid)) AS wanted FROM r GROUP BY 1), s AS (SELECT DISTINCT node_id AS nid, lower(label) AS kind FROM scored_rows)
        SELECT r.query, r.nid, round(CASE WHEN s.nid IS NOT NULL THEN score * 1.2 ELSE score END, 6) AS score FROM r JOIN w USING (query) LEFT JOIN s ON s.nid = r.nid AND s.kind = wanted""",
    "recall_expanded": f"""WITH {_FIRST}, v AS (SELECT view_id AS nid, content FROM message_views WHERE content IS NOT NULL), {_bm25('tb', 'v', 'nid', 'content', 'qt')},
        lq AS (SELECT query, list_distinct(list_concat(list_transform(regexp_extract_all(c, '["“`]([^"”`]+)["”`]', 1), lambda x: trim(x)), {_LITERALS})) AS lits FROM q), lt AS (SELECT DISTINCT query, unnest({_SPLIT.format("array_to_string(lits, ' ')")}) AS term FROM lq), {_bm25('lb', 'v', 'nid', 'content', 'lt')},
        u AS (SELECT query, doc AS nid, 1.0 / (59 + row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc)) AS s, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS k FROM tb QUALIFY k <= 50
          UNION ALL SELECT query, doc, 2.0 / (59 + row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc)), row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS k FROM lb QUALIFY k <= 50),
        x AS (SELECT query, nid, sum(s) * 0.4 AS score FROM u GROUP BY 1, 2 UNION ALL SELECT query, nid, score FROM first WHERE rank <= 3) SELECT query, nid, round(max(score), 9) AS score FROM x GROUP BY 1, 2""",
    "question_keywords": f"WITH {_Q} SELECT query AS query_id, array_to_string(list_filter(CASE WHEN len(k) > 0 THEN k ELSE w END, lambda x, i: list_position(CASE WHEN len(k) > 0 THEN k ELSE w END, x) = i), ' ') AS keywords, CASE " + " ".join(f"WHEN regexp_matches(lower(trim(c)), '{p}') THEN '{k}'" for p, k in T.ANSWER_TYPES) + " END AS wanted FROM q1",
    "multi_field_search": f"""WITH i AS (SELECT item_id, passage, coalesce(answer, '') AS answer, question FROM eval_items), qt AS (SELECT DISTINCT item_id AS query, unnest({_SPLIT.format('question')}) AS term FROM i), {_bm25('pb', 'i', 'item_id', 'passage', 'qt')}, {_bm25('ab', 'i', 'item_id', 'answer', 'qt')},
        u AS (SELECT query, doc, 'passage' AS field, score FROM pb UNION ALL SELECT query, doc, 'answer', score FROM ab), b AS (SELECT query, doc, arg_min(field, (-round(score, 9), field)) AS field, arg_min(score, (-round(score, 9), field)) AS score FROM u GROUP BY 1, 2)
        SELECT query, doc, field, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 5""",
    "hybrid_weighted": f"""WITH n AS (SELECT a.vec_id AS query, b.vec_id AS id, {_COS.format('a.embedding', 'b.embedding')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(score, 9) DESC, b.vec_id) <= 20),
        qt AS (SELECT DISTINCT doc_id AS query, unnest(({_SPLIT.format('text')})[1:12]) AS term FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0)), {_bm25('db', 'documents', 'doc_id', 'text', 'qt')},
        t AS (SELECT query, doc AS id, score FROM db QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 20), u AS (SELECT query, id, sum(score) * 0.5 AS score FROM (SELECT * FROM n UNION ALL SELECT * FROM t) GROUP BY 1, 2)
        SELECT query, id, round(score, 5) AS score FROM u QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) <= 10""",
    "multi_label_nearest": f"""WITH u AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 UNION ALL SELECT upsert_id + 1000000000, embedding FROM fact_upserts WHERE len(embedding) = 64), g AS (SELECT *, {_VEC.format('embedding', 'embedding')} AS nn FROM u),
        s AS (SELECT a.vec_id AS query, b.vec_id, CASE WHEN b.nn > 0 THEN {_VEC.format('a.embedding', 'b.embedding')} / (sqrt(a.nn) * sqrt(b.nn)) ELSE 0 END AS score FROM g a, g b WHERE a.vec_id % 20 = 0 AND a.vec_id < 1000000000)
        SELECT query, vec_id, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) <= 5""",
    "lexical_chunks": f"""WITH l AS (SELECT artifact_id || ':' || unnest(range(len(x)))::VARCHAR AS nid, unnest(x) AS text FROM (SELECT artifact_id, string_split(content, chr(10)) AS x FROM ingest_artifacts WHERE content <> '')), k AS (SELECT * FROM l WHERE trim(text, ' ') <> ''),
        p AS (SELECT DISTINCT regexp_extract(path, '^/([^/]+)/', 1) AS query FROM ingest_artifacts WHERE path IS NOT NULL), qt AS (SELECT DISTINCT query, unnest({_SPLIT.format('query')}) AS term FROM p WHERE query <> ''), {_bm25('kb', 'k', 'nid', 'text', 'qt')}
        SELECT query, doc AS chunk, session_id, round(score, 6) AS score FROM kb JOIN ingest_artifacts ON artifact_id = split_part(doc, ':', 1) QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 10""",
    "late_interaction": f"""WITH p AS (SELECT subject, embedding AS e, row_number() OVER (PARTITION BY subject ORDER BY observed_at NULLS LAST, upsert_id) AS k FROM fact_upserts WHERE subject IS NOT NULL AND len(embedding) = 64),
        g AS (SELECT subject, max(e) FILTER (k = 1) AS a, max(e) FILTER (k = 2) AS b, max(e) FILTER (k = 3) AS c, max(e) FILTER (k = 4) AS d FROM p WHERE k <= 4 GROUP BY 1 HAVING count(*) = 4)
        SELECT subject, round(greatest(coalesce(nullif({_COS.format('a', 'c')}, 'nan'), 0), coalesce(nullif({_COS.format('a', 'd')}, 'nan'), 0)) + greatest(coalesce(nullif({_COS.format('b', 'c')}, 'nan'), 0), coalesce(nullif({_COS.format('b', 'd')}, 'nan'), 0)), 4) AS score FROM g""",
    "answer_hits": """WITH r AS (SELECT DISTINCT query_id, node_id, kind FROM recall_items WHERE node_id IS NOT NULL), s AS (SELECT query_id, node_id, max(score) AS score FROM scored_rows WHERE channel = 'dense' AND score IS NOT NULL AND NOT isnan(score) AND node_id IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT query_id, node_id, 1 AS hit FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) <= 5)
        SELECT kind, sum(coalesce(hit, 0))::BIGINT AS found, count(*) AS total, round(sum(coalesce(hit, 0)) / count(*), 6) AS rate FROM r LEFT JOIN t USING (query_id, node_id) GROUP BY ROLLUP (kind)""",
    "recall_summary": """WITH s AS (SELECT query_id, node_id, max(score) AS score FROM scored_rows WHERE channel = 'reranker' AND score IS NOT NULL AND NOT isnan(score) AND node_id IS NOT NULL GROUP BY 1, 2), b AS (SELECT query_id, node_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) = 1),
        k AS (SELECT query_id, node_id, token_count, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_no) AS rank FROM recall_items WHERE score IS NOT NULL AND NOT isnan(score) AND node_id IS NOT NULL QUALIFY rank <= 50),
        f AS (SELECT b.query_id, min(rank) AS rank FROM b LEFT JOIN k ON b.query_id = k.query_id AND b.node_id = k.node_id GROUP BY 1), t AS (SELECT query_id, sum(token_count) AS tokens FROM k WHERE rank <= 5 GROUP BY 1), j AS (SELECT * FROM f LEFT JOIN t USING (query_id)), o AS (SELECT tokens, row_number() OVER (ORDER BY tokens) AS i, count(*) OVER () AS n FROM j WHERE tokens IS NOT NULL)
        SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, (SELECT max(tokens) FROM o WHERE i = n // 2 + 1)::BIGINT AS tokens_p50 FROM j""",
    "evidence_found": f"""WITH qt AS (SELECT DISTINCT item_id AS query, unnest({_SPLIT.format('question')}) AS term FROM eval_items), {_bm25('pb', 'eval_items', 'item_id', 'passage', 'qt')}, k AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM pb QUALIFY rank <= 5),
        g AS (SELECT item_id, array_to_string({_ANSWER.format('answer')}, ' ') AS a FROM eval_items WHERE answer IS NOT NULL), h AS (SELECT query, min(rank) AS rank FROM k JOIN g ON item_id = query JOIN eval_items e ON e.item_id = doc WHERE a <> '' AND contains(' ' || array_to_string({_ANSWER.format('passage')}, ' ') || ' ', a) GROUP BY 1)
        SELECT item_id, coalesce(rank <= 1, false) AS at_1, coalesce(rank <= 5, false) AS at_5 FROM g LEFT JOIN h ON item_id = query""",
    "smoothed_values": """WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back FROM events WHERE value IS NOT NULL)
        SELECT user_id, round(sum(value * 0.1 * power(0.9, back)), 6) AS ema FROM k GROUP BY 1""",
    "predicate_lemmas": r"""WITH p AS (SELECT regexp_replace(trim(lower(predicate), ' '), '[\s_\-]+', '_', 'g') AS predicate FROM fact_upserts WHERE predicate IS NOT NULL)
        SELECT predicate, CASE predicate WHEN 'reported' THEN 'report' WHEN 'is_part_of' THEN 'part_of' WHEN 'manages' THEN 'manage' WHEN 'supplies' THEN 'supply' WHEN 'researches' THEN 'research' WHEN 'prefers' THEN 'prefer' WHEN 'owns' THEN 'own' ELSE predicate END AS lemma, count(*) AS facts FROM p GROUP BY 1, 2""",
    "clean_objects": rf"""WITH o AS (SELECT upsert_id, regexp_replace(regexp_replace(object, '^[!-/:-@\[-`{{-~\s\x{{0B}}]+|[!-/:-@\[-`{{-~\s\x{{0B}}]+$', '', 'g'), '(?i)^(?:(?:{'|'.join(L.LEADING)})(?:[\s\x{{0B}}]+|$))+', '') AS led,
          trim(regexp_replace(regexp_replace(trim(object, ' '), '[?.,!;:"]+$', ''), '(?:[''’]s|[''’])$', ''), ' ') AS bare FROM fact_upserts WHERE object IS NOT NULL)
        SELECT upsert_id, CASE WHEN led <> '' AND lower(led) NOT IN ({', '.join(f"'{w}'" for w in L.EMPTY)}) THEN led END AS object, CASE WHEN length(bare) >= 2 THEN bare END AS ref FROM o""",
    "negated_messages": r"""SELECT regexp_matches(lower(replace(content, '’', '''')), '(?:^|[^\p{L}''])(?:not|never|no|nor)(?:$|[^\p{L}''])|n''t(?:$|[^\p{L}])') AS negated, count(*) AS messages FROM ingest_messages WHERE content IS NOT NULL GROUP BY 1""",
    "embedding_texts": """SELECT upsert_id, coalesce('[' || strftime(observed_at, '%B %Y') || '] ', '') || CASE WHEN object IS NOT NULL THEN concat_ws(' ', subject, replace(lower(predicate), '_', ' '), object) ELSE 'nothing' END AS text FROM fact_upserts""",
    "whole_sentences": rf"""WITH s AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(passage, '((?:^|[\s"''(\[])(?:{'|'.join(L.ABBREVIATIONS)}|[A-Z]|[A-Za-z](?:\.[A-Za-z])+))\.(["'')\]”’]*\s)', '\1' || chr(1) || '\2', 'g'), '([.!?]["'')\]”’]*)\s+([\p{{Lu}}0-9"''(\[“‘])', '\1' || chr(2) || '\2', 'g'), chr(2)),
          lambda x: trim(replace(x, chr(1), '.'), ' ')), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 4) AS s FROM eval_items WHERE passage IS NOT NULL)
        SELECT item_id, len(s)::INT AS sentences, length(s[1])::INT AS first_chars FROM s""",
    "preconditions_met": "SELECT count(*) FILTER (metadata['client'] = 'cli') AS cli, 0::BIGINT AS odd, count(*) AS any FROM ingest_messages WHERE metadata IS NOT NULL",
}
