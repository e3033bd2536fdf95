"""What batches write and removals take along, as queries over the tables before and after."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.functions import text as T
from engramix.functions.ids import canonical_message_id
from engramix.operators import changes, sources, temporal
from engramix.operators.derive import vector_mean
from engramix.plans.model import artifacts, mentions, messages, sql_artifacts, sql_key, sql_mentions, sql_messages, sql_name
from engramix.sources.tables import read


def message_write(spark, folder):
    """The edges that all messages bring along, by type."""
    m = messages(spark, folder, "sender_id", "session_id", "addressed_to").where("at is not null")
    named = m.select(F.col("delivery_id").alias("message"), F.col("sender_id").alias("sender"), F.col("session_id").alias("session"), F.col("addressed_to").alias("to"), "at")
    return changes.message_edges(named).groupBy("etype").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


def ingest_outcomes(spark, folder):
    """Each message identifier as new, replayed or in conflict with another content."""
    m = read(spark, folder, "ingest_messages", "delivery_id", "message_id", "msg_timestamp", "content").withColumn("key", canonical_message_id(F.col("message_id")))
    found = changes.ingest_outcome(m, "key", F.encode("content", "utf-8"), ["delivery_id"])
    return found.groupBy("outcome").agg(F.count("*").alias("messages"), F.sum("copies").alias("deliveries"))


def whole_batches(spark, folder):
    """Rows of the batches in which every message has a sender and a content."""
    m = read(spark, folder, "ingest_messages", "batch_id", "sender_id", "content").select("batch_id", (F.col("sender_id").isNotNull() & (F.trim("content") != "")).alias("good"))
    return changes.accepted_units(m, "batch_id", F.col("good")).groupBy("batch_id").agg(F.count("*").alias("rows"))


def tool_writes(spark, folder):
    """Actions by how often their payload came, and whether it was the same."""
    a = artifacts(spark, folder, "content").where("produced_by_action_id is not null")
    return changes.ingest_outcome(a, "produced_by_action_id", F.encode("content", "utf-8"), ["artifact_id"]).select(F.col("produced_by_action_id").alias("action"), "outcome", "copies", F.col("kept.artifact_id").alias("artifact_id"))


def stored_contents(spark, folder):
    """Contents of artifacts stored once, by hash."""
    stored, _ = changes.content_table(read(spark, folder, "ingest_artifacts", "artifact_id", "content"), "artifact_id", "content")
    return stored.select("content_id", F.col("size").cast("int").alias("size"), "uses")


def source_spans(spark, folder):
    return changes.source_spans(read(spark, folder, "ingest_messages", "source_id", "msg_timestamp"), "source_id", "msg_timestamp")


def retired_sources(spark, folder):
    """Sources with fewer than a fiftieth of all messages retired, and the messages that stay in scope."""
    m = read(spark, folder, "ingest_messages", "source_id", "msg_timestamp")
    spans = changes.source_spans(m, "source_id", "msg_timestamp")
    total = spans.agg(F.sum("rows").alias("n")).scalar()
    marked = changes.retire(spans, spans.where(F.col("rows") * 50 < total), F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00")))
    return marked.select("source_id", F.col("retired_at").isNotNull().alias("retired"), F.when(F.col("retired_at").isNull(), F.col("rows")).otherwise(0).alias("in_scope"))


def _supports(spark, folder):
    """(fact_id, message): facts whose subject or object a message mentions."""
    f = read(spark, folder, "fact_upserts", "upsert_id", "subject").where("subject is not null").select(F.col("upsert_id").alias("fact_id"), T.canonical_name(F.col("subject")).alias("name"))
    return f.join(mentions(spark, folder).where("key is not null and name <> ''").select("name", F.col("key").alias("message")).distinct(), "name").select("fact_id", "message")


def sessions_deleted(spark, folder):
    """What is left once all sessions with an interpretation are deleted."""
    m = messages(spark, folder, "session_id", "category")
    gone = m.where("category = 'interpretation' and session_id is not null").select("session_id").distinct()
    _, links = changes.content_table(read(spark, folder, "ingest_artifacts", "artifact_id", "content"), "artifact_id", "content")
    a = artifacts(spark, folder).select("artifact_id", "session_id", F.col("triggered_by_message_id").alias("message")).join(links, "artifact_id", "left")
    left = changes.delete_sessions(gone, m.select(F.col("key").alias("message"), "session_id"), a, mentions(spark, folder).select("span_id", F.col("key").alias("message")), _supports(spark, folder))
    counted = [left[name].agg(F.lit(name).alias("kept"), F.count("*").alias("rows")) for name in ("messages", "artifacts", "mentions", "contents")]
    counted.append(left["facts"].agg(F.lit("invalidated facts").alias("kept"), F.count_if("invalidated").alias("rows")))
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


def participants_forgotten(spark, folder):
    """What is left once all people last seen before April are forgotten."""
    p = read(spark, folder, "participants", "participant_id", "display_name", "last_seen").where("last_seen < timestamp_ntz '2024-04-01 00:00:00'").select("participant_id", T.canonical_name(F.col("display_name")).alias("name"))
    m = messages(spark, folder, "sender_id").select(F.col("key").alias("message"), F.col("sender_id").alias("sender"))
    f = read(spark, folder, "fact_upserts", "upsert_id", "subject", "object").select("upsert_id", T.canonical_name(F.col("subject")).alias("subject"), T.canonical_name(F.col("object")).alias("object"))
    left = changes.forget_participants(p, m, f, mentions(spark, folder).select("span_id", F.col("key").alias("message"), "name"))
    a, b, c = (left[name].agg(F.lit(name).alias("kept"), F.count("*").alias("rows")) for name in ("messages", "facts", "mentions"))
    return a.unionByName(b).unionByName(c)


def messages_redacted(spark, folder):
    """Messages of one category redacted: they keep their place, but not their content."""
    m = messages(spark, folder, "content", "category")
    done = changes.redact(m, m.where("category = 'assertion'"), "key", ["content"])
    return done.groupBy("category", "redacted").agg(F.count("*").alias("messages"), F.count("content").alias("with_content"))


def redacted_recall(spark, folder):
    """Recalled items without those that are redacted messages, and the tokens that are left."""
    r = read(spark, folder, "recall_items", "query_id", "item_no", "node_id", "token_count")
    gone = read(spark, folder, "ingest_messages", "delivery_id", "category").where("category = 'assertion'")
    return changes.without(r, gone, "node_id", "delivery_id").groupBy("query_id").agg(F.count("*").alias("items"), F.sum("token_count").alias("tokens"))


def visibility_set(spark, folder):
    """All facts of one predicate made private to a team, but for those already open to another."""
    f = read(spark, folder, "fact_upserts", "upsert_id", "predicate", "visibility")
    change = f.where("lower(predicate) = 'manages'").select("upsert_id", F.lit("team:t1").alias("visibility"))
    done = changes.with_visibility(f, change, "upsert_id", F.col("visibility").startswith("org:"))
    return done.groupBy(F.lower("predicate").alias("predicate"), F.coalesce("visibility", F.lit("")).alias("visibility")).agg(F.count("*").alias("facts"))


def mention_visibility(spark, folder):
    """Mentions with the visibility of their message."""
    n = mentions(spark, folder).select("span_id", "key", F.lit(None).cast("string").alias("visibility"))
    return changes.owned_visibility(n, messages(spark, folder, "visibility").select("key", "visibility"), "key").select("span_id", "visibility")


def vectors_pooled(spark, folder):
    """The mean vector of the facts about every name that is mentioned."""
    f = read(spark, folder, "fact_upserts", "subject", "embedding").where("subject is not null").select(T.canonical_name(F.col("subject")).alias("name"), "embedding")
    done = changes.mean_vectors(f, "name", "embedding", 64, mentions(spark, folder).where("name <> ''"))
    return done.select("name", F.round(F.col("mean")[0] + 1e-9, 5).alias("first"), F.round(F.col("mean")[63] + 1e-9, 5).alias("last"))


def _triples(spark, folder):
    f = read(spark, folder, "fact_upserts", "upsert_id", "subject", "predicate", "object", "observed_at", "visibility").where("subject is not null and predicate is not null and object is not null")
    return f.select(F.col("upsert_id").alias("fact_id"), T.canonical_name(F.col("subject")).alias("s"), F.lower(F.trim("predicate")).alias("p"), F.coalesce(T.visibility(F.col("visibility")), F.lit("")).alias("scope"), T.object_key(F.col("object")).alias("o"), F.col("observed_at").alias("at"))


def _current(triples):
    """The last object of each subject, predicate and scope, and the fact that says so."""
    last = triples.groupBy("s", "p", "scope").agg(F.max(F.struct("at", "fact_id", "o")).alias("l"))
    return last.select("s", "p", "scope", F.col("l.o").alias("o"), F.col("l.fact_id").alias("by"))


def stale_facts(spark, folder):
    """Facts whose object is no longer the last one."""
    t = _triples(spark, folder)
    return changes.stale_facts(t.withColumn("open", F.lit(True)), _current(t)).select("fact_id", "old", "new")


def facts_invalidated(spark, folder):
    """Intervals of stale facts closed at the end of the data, and the edges that say by which fact."""
    t = _triples(spark, folder)
    now = t.agg(F.max(temporal.millis(F.col("at"))).alias("n")).scalar()
    current = _current(t)
    stale = changes.stale_facts(t.withColumn("open", F.lit(True)), current).join(t.select("fact_id", "scope"), "fact_id").join(current.select("s", "p", "scope", "by"), ["s", "p", "scope"]).select("fact_id", "by")
    facts = t.select("fact_id", temporal.millis(F.col("at")).alias("lo"), F.lit((1 << 63) - 1).alias("hi"))
    closed, edges = changes.invalidated(facts, stale, now)
    return closed.join(edges.select("dst", "src"), closed["fact_id"] == edges["dst"], "left").select("fact_id", (F.col("hi") - F.col("lo")).alias("held_ms"), F.col("src").alias("by"))


def cycle_audit(spark, folder):
    """One consolidation cycle over all facts: what it processed, created, reinforced and closed."""
    t = _triples(spark, folder)
    first = t.groupBy("s", "p", "scope", "o").agg(F.min_by("fact_id", F.struct("at", "fact_id")).alias("first"))
    again = t.join(first.select(F.col("first").alias("fact_id")), "fact_id", "left_anti").select("fact_id")
    stale = changes.stale_facts(t.withColumn("open", F.lit(True)), _current(t)).select("fact_id")
    return changes.cycle_audit("cycle-1", t.select("fact_id"), first.select("first"), again, stale).groupBy("etype").agg(F.count("*").alias("edges"))


def contradicted_facts(spark, folder):
    """Facts that at least two later ones of their subject and predicate contradict, by their objects; counted, no pairs are formed."""
    t = _triples(spark, folder)
    w = W.partitionBy("s", "p", "scope").orderBy("at", "fact_id").rowsBetween(1, W.unboundedFollowing)
    same = W.partitionBy("s", "p", "scope", "o").orderBy("at", "fact_id").rowsBetween(1, W.unboundedFollowing)
    later = t.withColumn("against", F.count("*").over(w) - F.count("*").over(same))
    return later.where("against >= 2").select("fact_id", "against")


def transcript_chunks(spark, folder):
    """Transcripts of all sessions in chunks of eight messages: how many, and how long."""
    m = messages(spark, folder, "session_id", "sender_id", "content").where("session_id is not null and trim(content) <> ''")
    line = F.concat(F.coalesce("sender_id", F.lit("")), F.lit(": "), F.col("content"))
    placed = temporal.positions(m.select("session_id", "at", "delivery_id", F.length(line).alias("chars")), ["session_id"], "at", "delivery_id")
    return placed.groupBy("session_id", F.floor((F.col("position") - 1) / 8).cast("int").alias("index")).agg(F.count("*").alias("turns"), (F.sum("chars") + F.count("*") - 1).alias("chars"))


def chunks_refreshed(spark, folder):
    """Transcript chunks of eight messages that stay, go or come when the messages since June are added."""
    m = messages(spark, folder, "session_id").where("session_id is not null and at is not null")

    def chunks(rows):
        placed = temporal.positions(rows.select("session_id", "at", "delivery_id"), ["session_id"], "at", "delivery_id").withColumn("index", F.floor((F.col("position") - 1) / 8).cast("int"))
        listed = F.array_sort(F.collect_list(F.struct("position", F.col("delivery_id").cast("string").alias("d"))))
        return placed.groupBy("session_id", "index").agg(F.array_join(F.transform(listed, lambda x: x["d"]), ",").alias("text"))

    old = chunks(m.where("at < timestamp_ntz '2024-06-01 00:00:00'"))
    return sources.refreshed(old, chunks(m), "session_id").groupBy("action").agg(F.count("*").alias("chunks"), F.count_distinct("session_id").alias("sessions"))


def topics(spark, folder):
    """The names mentioned in a session as its topic: id by members, title of the first three, and types."""
    n = mentions(spark, folder).where("name <> ''").join(messages(spark, folder, "session_id").select("key", "session_id").where("session_id is not null"), "key")
    members = n.groupBy("session_id", "name").agg(F.min(F.coalesce("entity_type", F.lit(""))).alias("t"))
    listed = F.array_sort(F.collect_list("name"))
    kinds = [F.count_if(F.col("t") == k).alias(k.lower()) for k in ("PERSON", "ORG", "LOC")]
    found = members.groupBy("session_id").agg(listed.alias("names"), F.count("*").alias("members"), *kinds).where("members >= 2")
    return found.select("session_id", F.concat(F.lit("topic_"), F.substring(F.sha2(F.array_join("names", "|"), 256), 1, 16)).alias("topic_id"), F.array_join(F.slice("names", 1, 3), ", ").alias("title"), "members", "person", "org", "loc")


def fact_vectors_by_support(spark, folder):
    """How alike the vector of a fact is to the mean of all facts of its subject: its weight as support."""
    f = read(spark, folder, "fact_upserts", "upsert_id", "subject", "embedding").where("subject is not null and size(embedding) = 64").select("upsert_id", T.canonical_name(F.col("subject")).alias("name"), "embedding")
    mean = vector_mean(f, ["name"], "embedding", 64)
    from engramix.operators.retrieval import support_weight

    return f.join(mean, "name").select("upsert_id", F.round(support_weight(F.col("embedding"), F.col("mean")), 4).alias("weight"))


QUERIES = {f.__name__: f for f in (
    message_write, ingest_outcomes, whole_batches, tool_writes, stored_contents, source_spans, retired_sources, sessions_deleted, participants_forgotten, messages_redacted, redacted_recall, visibility_set, mention_visibility,
    vectors_pooled, stale_facts, facts_invalidated, cycle_audit, contradicted_facts, transcript_chunks, chunks_refreshed, topics, fact_vectors_by_support,
)}

_T = f"""t AS (SELECT upsert_id AS fact_id, {sql_name('subject')} AS s, lower(trim(predicate, ' ')) AS p, CASE WHEN trim(visibility) <> '' AND lower(trim(visibility)) <> 'public' THEN trim(visibility) ELSE '' END AS scope, lower(trim(object, ' ')) AS o, observed_at AS seen
        FROM fact_upserts WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL),
    c AS (SELECT s, p, scope, arg_max(o, (seen, fact_id)) AS o, arg_max(fact_id, (seen, fact_id)) AS by FROM t GROUP BY 1, 2, 3), st AS (SELECT t.fact_id, t.o AS old, c.o AS new, c.by FROM t JOIN c USING (s, p, scope) WHERE t.o <> c.o)"""
_MEAN = "list_transform(range(1, 65), lambda i: list_avg(list_transform(list(embedding), lambda v: v[i]::DOUBLE)))"
_POS = "SELECT session_id, delivery_id, row_number() OVER (PARTITION BY session_id ORDER BY sent NULLS LAST, delivery_id) - 1 AS pos"

SQL = {
    "message_write": f"""WITH {sql_messages('sender_id', 'session_id', 'addressed_to')}, k AS (SELECT * FROM m WHERE sent IS NOT NULL), e AS (SELECT 'SENT_BY' AS etype, delivery_id::VARCHAR AS src, sender_id AS dst FROM k UNION ALL SELECT 'IN_SESSION', delivery_id::VARCHAR, session_id FROM k
          UNION ALL SELECT 'ADDRESSED_TO', delivery_id::VARCHAR, unnest(addressed_to) FROM k UNION ALL SELECT 'NEXT', lag(delivery_id) OVER (PARTITION BY session_id ORDER BY sent, delivery_id)::VARCHAR, delivery_id::VARCHAR FROM k WHERE session_id IS NOT NULL
          UNION ALL SELECT 'PARTICIPATED_IN', sender_id, session_id FROM k WHERE session_id IS NOT NULL), d AS (SELECT DISTINCT * FROM e WHERE src IS NOT NULL AND dst IS NOT NULL)
        SELECT etype, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM d GROUP BY 1""",
    "ingest_outcomes": f"""WITH k AS (SELECT {sql_key('message_id')} AS key, content FROM ingest_messages), g AS (SELECT key, count(*) AS copies, count(DISTINCT coalesce(content, chr(0))) AS kinds FROM k WHERE key IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN copies = 1 THEN 'new' WHEN kinds = 1 THEN 'replay' ELSE 'conflict' END AS outcome, count(*) AS messages, sum(copies)::BIGINT AS deliveries FROM g GROUP BY 1""",
    "whole_batches": "SELECT batch_id, count(*) AS rows FROM ingest_messages WHERE batch_id IS NOT NULL GROUP BY 1 HAVING bool_and(coalesce(sender_id IS NOT NULL AND trim(content, ' ') <> '', false))",
    "tool_writes": """SELECT produced_by_action_id AS action, CASE WHEN count(*) = 1 THEN 'new' WHEN count(DISTINCT coalesce(content, chr(0))) = 1 THEN 'replay' ELSE 'conflict' END AS outcome, count(*) AS copies, min(artifact_id) AS artifact_id
        FROM ingest_artifacts WHERE produced_by_action_id IS NOT NULL GROUP BY 1""",
    "stored_contents": "SELECT sha256(content) AS content_id, any_value(strlen(content))::INT AS size, count(*) AS uses FROM ingest_artifacts WHERE content IS NOT NULL GROUP BY 1",
    "source_spans": "SELECT source_id, min(msg_timestamp) AS first_seen, max(msg_timestamp) AS last_seen, count(*) AS rows FROM ingest_messages WHERE source_id IS NOT NULL GROUP BY 1",
    "retired_sources": """WITH s AS (SELECT source_id, count(*) AS rows FROM ingest_messages WHERE source_id IS NOT NULL GROUP BY 1), t AS (SELECT *, rows * 50 < sum(rows) OVER () AS retired FROM s)
        SELECT source_id, retired, CASE WHEN retired THEN 0 ELSE rows END AS in_scope FROM t""",
    "sessions_deleted": f"""WITH {sql_messages('session_id', 'category')}, {sql_mentions()}, {sql_artifacts('content')}, g AS (SELECT DISTINCT session_id FROM m WHERE category = 'interpretation' AND session_id IS NOT NULL), d AS (SELECT key FROM m WHERE session_id IN (FROM g)),
        ka AS (SELECT * FROM a WHERE coalesce(session_id NOT IN (FROM g), true) AND coalesce(triggered NOT IN (FROM d), true)),
        s AS (SELECT DISTINCT upsert_id, key FROM (SELECT upsert_id, {sql_name('subject')} AS name FROM fact_upserts WHERE subject IS NOT NULL) JOIN n USING (name) WHERE key IS NOT NULL AND name <> ''), f AS (SELECT upsert_id FROM s GROUP BY 1 HAVING bool_and(key IN (FROM d)))
        SELECT 'messages' AS kept, count(*) AS rows FROM m WHERE coalesce(session_id NOT IN (FROM g), true) UNION ALL SELECT 'artifacts', count(*) FROM ka UNION ALL SELECT 'mentions', count(*) FROM n WHERE coalesce(key NOT IN (FROM d), true)
        UNION ALL SELECT 'contents', count(DISTINCT content) FROM ka UNION ALL SELECT 'invalidated facts', count(*) FROM f""",
    "participants_forgotten": f"""WITH {sql_messages('sender_id')}, {sql_mentions()}, p AS (SELECT participant_id, {sql_name('display_name')} AS name FROM participants WHERE last_seen < TIMESTAMP '2024-04-01'), i AS (SELECT participant_id FROM p WHERE participant_id IS NOT NULL), w AS (SELECT name FROM p WHERE name IS NOT NULL),
        d AS (SELECT key FROM m WHERE sender_id IN (FROM i)), f AS (SELECT {sql_name('subject')} AS s, {sql_name('object')} AS o FROM fact_upserts)
        SELECT 'messages' AS kept, count(*) AS rows FROM m WHERE coalesce(sender_id NOT IN (FROM i), true) UNION ALL SELECT 'facts', count(*) FROM f WHERE coalesce(s NOT IN (FROM w), true) AND coalesce(o NOT IN (FROM w), true)
        UNION ALL SELECT 'mentions', count(*) FROM n WHERE coalesce(key NOT IN (FROM d), true) AND coalesce(name NOT IN (FROM w), true)""",
    "messages_redacted": f"WITH {sql_messages('content', 'category')} SELECT category, coalesce(category = 'assertion', false) AS redacted, count(*) AS messages, count(CASE WHEN category = 'assertion' THEN NULL ELSE content END) AS with_content FROM m GROUP BY 1, 2",
    "redacted_recall": "SELECT query_id, count(*) AS items, sum(token_count)::BIGINT AS tokens FROM recall_items WHERE coalesce(node_id NOT IN (SELECT delivery_id FROM ingest_messages WHERE category = 'assertion'), true) GROUP BY 1",
    "visibility_set": """SELECT lower(predicate) AS predicate, coalesce(CASE WHEN lower(predicate) = 'manages' AND NOT coalesce(starts_with(visibility, 'org:'), false) THEN 'team:t1' ELSE visibility END, '') AS visibility, count(*) AS facts FROM fact_upserts GROUP BY 1, 2""",
    "mention_visibility": f"""WITH {sql_messages('visibility')}, {sql_mentions()} SELECT span_id, CASE WHEN trim(m.visibility) <> '' AND lower(trim(m.visibility)) <> 'public' THEN trim(m.visibility) END AS visibility FROM n LEFT JOIN m USING (key)""",
    "vectors_pooled": f"""WITH {sql_mentions()}, f AS (SELECT {sql_name('subject')} AS name, embedding FROM fact_upserts WHERE subject IS NOT NULL AND len(embedding) = 64)
        SELECT name, round(avg(embedding[1]::DOUBLE) + 1e-9, 5) AS first, round(avg(embedding[64]::DOUBLE) + 1e-9, 5) AS last FROM f WHERE name IN (SELECT name FROM n WHERE name <> '') GROUP BY 1""",
    "stale_facts": f"WITH {_T} SELECT fact_id, old, new FROM st",
    "facts_invalidated": f"""WITH {_T}, x AS (SELECT max(epoch_us(seen) // 1000) AS now FROM t) SELECT t.fact_id, CASE WHEN st.fact_id IS NULL THEN 9223372036854775807 ELSE now END - epoch_us(seen) // 1000 AS held_ms, st.by FROM t LEFT JOIN st USING (fact_id), x""",
    "cycle_audit": f"""WITH {_T}, f AS (SELECT arg_min(fact_id, (seen, fact_id)) AS first FROM t GROUP BY s, p, scope, o)
        SELECT 'PROCESSED' AS etype, count(*) AS edges FROM t UNION ALL SELECT 'CREATED', count(*) FROM f UNION ALL SELECT 'REINFORCED', count(*) FROM t WHERE fact_id NOT IN (SELECT first FROM f) UNION ALL SELECT 'INVALIDATED', count(*) FROM st""",
    "contradicted_facts": f"""WITH {_T}, g AS (SELECT fact_id, count(*) OVER (PARTITION BY s, p, scope ORDER BY seen, fact_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - count(*) OVER (PARTITION BY s, p, scope, o ORDER BY seen, fact_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS against FROM t)
        SELECT fact_id, against FROM g WHERE against >= 2""",
    "transcript_chunks": f"""WITH {sql_messages('session_id', 'sender_id', 'content')}, p AS ({_POS}, length(coalesce(sender_id, '') || ': ' || content) AS chars FROM m WHERE session_id IS NOT NULL AND trim(content, ' ') <> '')
        SELECT session_id, (pos // 8)::INT AS index, count(*) AS turns, (sum(chars) + count(*) - 1)::BIGINT AS chars FROM p GROUP BY 1, 2""",
    "chunks_refreshed": f"""WITH {sql_messages('session_id')}, k AS (SELECT * FROM m WHERE session_id IS NOT NULL AND sent IS NOT NULL), a AS (SELECT session_id, pos // 8 AS i, string_agg(delivery_id::VARCHAR, ',' ORDER BY pos) AS t FROM ({_POS} FROM k WHERE sent < TIMESTAMP '2024-06-01') GROUP BY 1, 2),
        b AS (SELECT session_id, pos // 8 AS i, string_agg(delivery_id::VARCHAR, ',' ORDER BY pos) AS t FROM ({_POS} FROM k) GROUP BY 1, 2), j AS (SELECT session_id, i, a.t AS old, b.t AS new FROM a FULL JOIN b USING (session_id, i)),
        f AS (SELECT session_id, min(i) AS f FROM j WHERE old IS DISTINCT FROM new GROUP BY 1), s AS (SELECT j.*, f IS NULL OR i < f AS keep FROM j LEFT JOIN f USING (session_id)),
        r AS (SELECT 'keep' AS action, session_id FROM s WHERE keep UNION ALL SELECT 'remove', session_id FROM s WHERE NOT keep AND old IS NOT NULL UNION ALL SELECT 'write', session_id FROM s WHERE NOT keep AND new IS NOT NULL)
        SELECT action, count(*) AS chunks, count(DISTINCT session_id) AS sessions FROM r GROUP BY 1""",
    "topics": f"""WITH {sql_messages('session_id')}, {sql_mentions()}, k AS (SELECT session_id, name, min(coalesce(entity_type, '')) AS t FROM n JOIN m USING (key) WHERE name <> '' AND session_id IS NOT NULL GROUP BY 1, 2), g AS (SELECT session_id, list_sort(list(name)) AS names, count(*) AS members,
          count(*) FILTER (t = 'PERSON') AS person, count(*) FILTER (t = 'ORG') AS org, count(*) FILTER (t = 'LOC') AS loc FROM k GROUP BY 1 HAVING count(*) >= 2)
        SELECT session_id, 'topic_' || sha256(array_to_string(names, '|'))[1:16] AS topic_id, array_to_string(names[1:3], ', ') AS title, members, person, org, loc FROM g""",
    "fact_vectors_by_support": f"""WITH f AS (SELECT upsert_id, {sql_name('subject')} AS name, embedding FROM fact_upserts WHERE subject IS NOT NULL AND len(embedding) = 64), g AS (SELECT name, {_MEAN} AS mean FROM f GROUP BY 1),
        d AS (SELECT upsert_id, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * mean[i])) AS dot, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS a, sqrt(list_sum(list_transform(mean, lambda x: x * x))) AS b FROM f JOIN g USING (name))
        SELECT upsert_id, round(CASE WHEN a > 0 AND b > 0 THEN greatest(0, least(1, dot / (a * b))) ELSE 0 END, 4) AS weight FROM d""",
}
