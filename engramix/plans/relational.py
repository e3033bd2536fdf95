"""Scans, predicates, joins, aggregates, windows and set operations of the memory model."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.functions.ids import canonical_message_id
from engramix.operators import graph, mutate, temporal
from engramix.operators.predicates import Scope, excluded, in_scope, predicate
from engramix.operators.retrieval import top_k
from engramix.sources.tables import read


def scan_filtered(spark, folder):
    """Label scan under a predicate tree."""
    tree = ("and", ("in", "event_type", ["purchase", "error"]), ("or", ("gte", "value", 50.0), ("is_null", "props")), ("not", ("eq", "user_id", 7)), ("and",))
    return read(spark, folder, "events").where(predicate(tree)).select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))


def lookup_by_id(spark, folder):
    return read(spark, folder, "customer", "c_custkey", "c_name", "c_acctbal").where(F.col("c_custkey") == 42)


def adjacency_both(spark, folder):
    """Edges of nodes in either direction over a typed edge view."""
    lines = read(spark, folder, "lineitem", "l_orderkey", "l_partkey")
    edges = lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("MENTIONS").alias("etype"), F.lit(1.0).alias("weight"))
    return graph.directed(edges, "both").groupBy("src", "etype").agg(F.count("*").alias("degree"))


def session_transcript(spark, folder):
    """Public messages of all sessions with the sender's name and their place."""
    m = read(spark, folder, "ingest_messages", "delivery_id", "session_id", "sender_id", "msg_timestamp", "visibility").where("session_id is not null and (visibility is null or visibility in ('', 'public'))")
    p = read(spark, folder, "participants", "participant_id", "display_name").groupBy("participant_id").agg(F.max("display_name").alias("speaker"))
    placed = temporal.positions(m, ["session_id"], "msg_timestamp", "delivery_id").join(p, F.col("sender_id") == F.col("participant_id"), "left")
    return placed.select("session_id", "position", "delivery_id", F.coalesce("speaker", "sender_id", F.lit("")).alias("speaker"))


def unprocessed_observations(spark, folder):
    """Facts whose subject was never recognised in a message: anti join."""
    facts = read(spark, folder, "fact_upserts", "upsert_id", "subject", "predicate", "observed_at").where("subject is not null")
    seen = read(spark, folder, "ner_spans", "text").where("text is not null").toDF("subject")
    return excluded(facts, seen, ["subject"]).select("upsert_id", "subject", "predicate")


def semi_join_sources(spark, folder):
    """Artifacts triggered by a message of a session in which more than 20 messages were sent."""
    busy = read(spark, folder, "ingest_messages", "session_id").groupBy("session_id").agg(F.count("*").alias("n")).where("n > 20 and session_id is not null")
    return read(spark, folder, "ingest_artifacts", "artifact_id", "session_id", "kind").join(busy.select("session_id"), "session_id", "left_semi").select("artifact_id", "session_id", "kind")


def pattern_join(spark, folder):
    """Four hops: region, nation, customer, order, line; distinct parts bought by region."""
    line = read(spark, folder, "lineitem", "l_orderkey", "l_partkey")
    order = read(spark, folder, "orders", "o_orderkey", "o_custkey")
    customer = read(spark, folder, "customer", "c_custkey", "c_nationkey")
    nation = read(spark, folder, "nation", "n_nationkey", "n_regionkey")
    region = read(spark, folder, "region", "r_regionkey", "r_name")
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("lines"))


def memberships(spark, folder):
    """Customers with their team (nation) and organisation (region); left outer joins."""
    customer = read(spark, folder, "customer", "c_custkey", "c_nationkey")
    nation = read(spark, folder, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = read(spark, folder, "region", "r_regionkey", "r_name")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("members"), F.min("c_custkey").alias("first_member"))


def contradicting_pairs(spark, folder):
    """How many pairs of different objects the facts of one subject and predicate have; counted, not formed."""
    f = read(spark, folder, "fact_upserts", "subject", "predicate", "object").where("object is not null and subject is not null")
    n = F.count_distinct("object")
    return f.groupBy("subject", F.lower("predicate").alias("predicate")).agg((n * (n - 1) / 2).cast("long").alias("pairs")).where("pairs > 0")


def latest_in_window(spark, folder):
    """Backward as-of join: each error with the last purchase of its user within an hour."""
    e = read(spark, folder, "events", "event_id", "user_id", "ts", "event_type")
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    return temporal.as_of(errors, bought, ["user_id"], "ts", "ts", "purchase_id", 3_600_000).select("event_id", "user_id", "purchase_id_asof")


def message_statistics(spark, folder):
    """Grouping sets: messages by content type and category, and their totals."""
    m = read(spark, folder, "ingest_messages", "content_type", "category", "content")
    return m.rollup("content_type", "category").agg(F.count("*").alias("messages"), F.count("content").alias("with_content"), F.grouping_id().alias("level"))


def grouped_having(spark, folder):
    e = read(spark, folder, "events", "user_id", "event_type", "value")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.max("value"), 6).alias("top")).where("n >= 3")


def membership_sets(spark, folder):
    """Distinct categories of each source, sorted and joined."""
    a = read(spark, folder, "ingest_artifacts", "source_id", "category").where("source_id is not null")
    return a.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count("*").alias("artifacts"))


def message_chain(spark, folder):
    """NEXT edges: each message of a session with the one before it and the gap."""
    m = read(spark, folder, "ingest_messages", "session_id", "delivery_id", "msg_timestamp").where("session_id is not null")
    return temporal.chain(m, ["session_id"], "msg_timestamp", "delivery_id")


def episode_chain(spark, folder):
    e = read(spark, folder, "events", "event_id", "user_id", "ts")
    return temporal.chain(e, ["user_id"], "ts", "event_id", 3_600_000)


def recipients_inferred(spark, folder):
    """Recipients of each message: those addressed, else all who spoke before in the session."""
    m = read(spark, folder, "ingest_messages", "session_id", "sender_id", "addressed_to", "msg_timestamp", "delivery_id").where("session_id is not null")
    return mutate.recipients(m, "session_id", "sender_id", "addressed_to", "msg_timestamp", "delivery_id").groupBy("delivery_id").agg(F.count("*").alias("recipients"), F.min("recipient").alias("first_recipient"))


def top_per_class(spark, folder):
    """The three largest artifacts of each kind."""
    a = read(spark, folder, "ingest_artifacts", "artifact_id", "kind", "content").select("artifact_id", "kind", F.length("content").cast("double").alias("score")).where("score is not null")
    return top_k(a, 3, ["kind"], "artifact_id").select("kind", "rank", "artifact_id", F.col("score").cast("long").alias("chars"))


def idle_sessions(spark, folder):
    """Sessions that ended: no message within an hour of the last of all."""
    m = read(spark, folder, "ingest_messages", "session_id", "msg_timestamp").where("session_id is not null")
    now = m.agg(F.max("msg_timestamp").alias("now")).scalar()
    return m.groupBy("session_id").agg(F.min("msg_timestamp").alias("started_at"), F.max("msg_timestamp").alias("ended_at"), F.count("*").alias("messages")).where(F.col("ended_at") <= now - F.make_dt_interval(F.lit(0), F.lit(1)))


def superseded_revisions(spark, folder):
    a = read(spark, folder, "ingest_artifacts", "artifact_id", "source_id", "revision_id").where("source_id is not null")
    return mutate.superseded(a, "source_id", "revision_id", ["revision_id", "artifact_id"]).select("artifact_id", "source_id", "revision_id", "superseded")


def scope_union(spark, folder):
    """Union of the arms of a scope: messages, views and artifacts of two categories and a time window."""
    m, v, a = (read(spark, folder, t) for t in ("ingest_messages", "message_views", "ingest_artifacts"))
    since, until = "2024-03-01 00:00:00", "2024-06-01 00:00:00"
    scope = Scope(since=since, until=until, categories=["preference", "result"])
    typed = lambda df: df.where(in_scope(Scope(categories=scope.categories))).where((F.col("msg_timestamp") >= F.to_timestamp_ntz(F.lit(since))) & (F.col("msg_timestamp") < F.to_timestamp_ntz(F.lit(until))))
    arms = [typed(m).select(canonical_message_id(F.col("message_id")).alias("id")), typed(v).select(canonical_message_id(F.col("message_id")).alias("id")), a.where(F.col("category").isin(*scope.categories)).select(F.col("artifact_id").alias("id"))]
    return arms[0].unionByName(arms[1]).unionByName(arms[2]).distinct()


def jaccard_documents(spark, folder):
    """Overlap of the word sets of a question and its passage."""
    from engramix.functions.text import word_set

    i = read(spark, folder, "eval_items", "item_id", "question", "passage")
    a, b = word_set(F.col("question")), word_set(F.col("passage"))
    return i.select("item_id", F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6).alias("jaccard"))


QUERIES = {f.__name__: f for f in (
    scan_filtered, lookup_by_id, adjacency_both, session_transcript, unprocessed_observations, semi_join_sources, pattern_join, memberships, contradicting_pairs, latest_in_window, message_statistics,
    grouped_having, membership_sets, message_chain, episode_chain, recipients_inferred, top_per_class, idle_sessions, superseded_revisions, scope_union, jaccard_documents,
)}

_CANON = "CASE WHEN regexp_full_match(h, '[0-9a-f]{32}') THEN h[1:8]||'-'||h[9:12]||'-'||h[13:16]||'-'||h[17:20]||'-'||h[21:32] ELSE b END"
_HEX = r"regexp_replace(regexp_replace(lower(regexp_replace(message_id, '\s', '', 'g')), '^(urn:uuid:|uuid:)', ''), '[{}()-]', '', 'g')"

SQL = {
    "scan_filtered": "SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events WHERE event_type IN ('purchase', 'error') AND (value >= 50 OR props IS NULL) AND NOT user_id = 7",
    "lookup_by_id": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42",
    "adjacency_both": "WITH e AS (SELECT l_orderkey AS a, l_partkey AS b FROM lineitem) SELECT src, 'MENTIONS' AS etype, count(*) AS degree FROM (SELECT a AS src FROM e UNION ALL SELECT b FROM e) GROUP BY src",
    "session_transcript": """WITH p AS (SELECT participant_id, max(display_name) AS speaker FROM participants GROUP BY 1)
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY msg_timestamp, delivery_id)::INT AS position, delivery_id, coalesce(speaker, sender_id, '') AS speaker
        FROM ingest_messages LEFT JOIN p ON sender_id = participant_id WHERE session_id IS NOT NULL AND (visibility IS NULL OR visibility IN ('', 'public'))""",
    "unprocessed_observations": "SELECT upsert_id, subject, predicate FROM fact_upserts f WHERE subject IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ner_spans n WHERE n.text = f.subject)",
    "semi_join_sources": "SELECT artifact_id, session_id, kind FROM ingest_artifacts WHERE session_id IN (SELECT session_id FROM ingest_messages WHERE session_id IS NOT NULL GROUP BY 1 HAVING count(*) > 20)",
    "pattern_join": """SELECT r_name, count(DISTINCT l_partkey) AS parts, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "memberships": "SELECT r_name, n_name, count(*) AS members, min(c_custkey) AS first_member FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "contradicting_pairs": """WITH f AS (SELECT DISTINCT subject, lower(predicate) AS predicate, object FROM fact_upserts WHERE object IS NOT NULL AND subject IS NOT NULL)
        SELECT a.subject, a.predicate, count(*) AS pairs FROM f a JOIN f b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object < b.object GROUP BY 1, 2""",
    "latest_in_window": """SELECT e.event_id, e.user_id, CASE WHEN epoch_us(e.ts) // 1000 - epoch_us(p.ts) // 1000 <= 3600000 THEN p.purchase_id END AS purchase_id_asof
        FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""",
    "message_statistics": "SELECT content_type, category, count(*) AS messages, count(content) AS with_content, grouping_id(content_type, category)::BIGINT AS level FROM ingest_messages GROUP BY ROLLUP (content_type, category)",
    "grouped_having": "SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(max(value), 6) AS top FROM events GROUP BY 1, 2 HAVING count(*) >= 3",
    "membership_sets": "SELECT source_id, coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), ','), '') AS categories, count(*) AS artifacts FROM ingest_artifacts WHERE source_id IS NOT NULL GROUP BY 1",
    "message_chain": """SELECT session_id, src, dst, gap_ms FROM (SELECT session_id, lag(delivery_id) OVER w AS src, delivery_id AS dst, greatest(0, epoch_us(msg_timestamp) // 1000 - lag(epoch_us(msg_timestamp) // 1000) OVER w) AS gap_ms
        FROM ingest_messages WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY msg_timestamp, delivery_id)) WHERE src IS NOT NULL""",
    "episode_chain": """SELECT user_id, src, dst, gap_ms FROM (SELECT user_id, lag(event_id) OVER w AS src, event_id AS dst, greatest(0, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w) AS gap_ms
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE src IS NOT NULL AND gap_ms <= 3600000""",
    "recipients_inferred": """WITH m AS (SELECT session_id AS s, sender_id AS p, addressed_to AS a, msg_timestamp AS t, delivery_id AS d FROM ingest_messages WHERE session_id IS NOT NULL),
        r AS (SELECT d, unnest(a) AS recipient FROM m WHERE len(a) > 0
          UNION SELECT m.d, o.p FROM m JOIN m o ON m.s = o.s AND (o.t, o.d) < (m.t, m.d) AND o.p IS NOT NULL AND o.p IS DISTINCT FROM m.p WHERE coalesce(len(m.a), 0) = 0)
        SELECT d AS delivery_id, count(*) AS recipients, min(recipient) AS first_recipient FROM (SELECT DISTINCT * FROM r WHERE recipient IS NOT NULL) GROUP BY 1""",
    "top_per_class": "SELECT kind, rank, artifact_id, chars FROM (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY length(content) DESC, artifact_id)::INT AS rank, artifact_id, length(content)::BIGINT AS chars FROM ingest_artifacts WHERE content IS NOT NULL) WHERE rank <= 3",
    "idle_sessions": """SELECT session_id, min(msg_timestamp) AS started_at, max(msg_timestamp) AS ended_at, count(*) AS messages FROM ingest_messages WHERE session_id IS NOT NULL GROUP BY 1
        HAVING max(msg_timestamp) <= (SELECT max(msg_timestamp) FROM ingest_messages WHERE session_id IS NOT NULL) - INTERVAL 1 HOUR""",
    "superseded_revisions": """WITH l AS (SELECT source_id, arg_max(coalesce(revision_id, ''), (coalesce(revision_id, ''), artifact_id)) AS last FROM ingest_artifacts WHERE source_id IS NOT NULL GROUP BY 1)
        SELECT artifact_id, source_id, revision_id, last <> coalesce(revision_id, '') AS superseded FROM ingest_artifacts JOIN l USING (source_id)""",
    "scope_union": f"""WITH k AS (SELECT message_id FROM ingest_messages WHERE category IN ('preference', 'result') AND msg_timestamp >= TIMESTAMP '2024-03-01' AND msg_timestamp < TIMESTAMP '2024-06-01'
          UNION ALL SELECT message_id FROM message_views WHERE category IN ('preference', 'result') AND msg_timestamp >= TIMESTAMP '2024-03-01' AND msg_timestamp < TIMESTAMP '2024-06-01'),
        n AS (SELECT {_HEX} AS h, lower(trim(message_id)) AS b FROM k)
        SELECT {_CANON} AS id FROM n UNION SELECT artifact_id FROM ingest_artifacts WHERE category IN ('preference', 'result')""",
    "jaccard_documents": r"""WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(question), '[^\p{L}\p{M}\p{N}]+'), lambda x: strlen(x) > 1)) AS a, list_distinct(list_filter(regexp_split_to_array(lower(passage), '[^\p{L}\p{M}\p{N}]+'), lambda x: strlen(x) > 1)) AS b FROM eval_items)
        SELECT item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM t""",
}
