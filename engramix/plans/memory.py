"""Scans, lookups, joins and lineage over messages, mentions, artifacts and facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.functions import text as T
from engramix.operators import sources, temporal
from engramix.operators.extract import suppressed
from engramix.plans.model import artifacts, mentions, messages, sql_artifacts, sql_key, sql_mentions, sql_messages, sql_name
from engramix.sources.tables import read


def chunk_range(spark, folder):
    """The second to fifth line of every artifact that a message triggered."""
    a = read(spark, folder, "ingest_artifacts", "artifact_id", "content", "triggered_by_message_id")
    found = sources.chunk_range(sources.line_chunks(a, "artifact_id", "content"), 1, 4, a.where("triggered_by_message_id is not null"))
    return found.select("artifact_id", "index", F.length("text").alias("chars"))


def tool_calls(spark, folder):
    """The 50 newest actions, with the artifact they produced, its session and who asked."""
    a = artifacts(spark, folder, "kind").where("produced_by_action_id is not null").withColumnRenamed("session_id", "artifact_session")
    m = messages(spark, folder, "sender_id", "session_id")
    joined = a.join(m, a["triggered_by_message_id"] == m["key"], "left").select("produced_by_action_id", "artifact_id", "kind", F.coalesce("session_id", "artifact_session").alias("session_id"), "sender_id", "at")
    return joined.orderBy(F.col("at").desc_nulls_last(), "produced_by_action_id", "artifact_id").limit(50)


def session_observations(spark, folder):
    """Mentions of every session in order of their messages: public ones only."""
    m = messages(spark, folder, "session_id", "visibility").where("session_id is not null and (visibility is null or trim(visibility) in ('', 'public'))")
    n = mentions(spark, folder)
    joined = n.join(m, "key").select("session_id", "at", "span_id", "name")
    return temporal.positions(joined, ["session_id"], "at", "span_id").select("session_id", "position", "span_id", "name")


def unfinalized_sessions(spark, folder):
    """Sessions with messages but without an artifact."""
    m = read(spark, folder, "ingest_messages", "session_id").where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("deliveries"))
    return m.join(read(spark, folder, "ingest_artifacts", "session_id").where("session_id is not null").distinct(), "session_id", "left_anti")


def entity_scan(spark, folder):
    """All entities with their commonest type, how often they are mentioned, and how many facts about them have a vector."""
    n = mentions(spark, folder).where("name <> ''")
    typed = n.groupBy("name", "entity_type").agg(F.count("*").alias("c")).groupBy("name").agg(F.max(F.struct("c", F.coalesce("entity_type", F.lit("")).alias("t")))["t"].alias("entity_type"), F.sum("c").alias("mentions"))
    f = read(spark, folder, "fact_upserts", "subject", "embedding").where("subject is not null").select(T.canonical_name(F.col("subject")).alias("s"), (F.size("embedding") > 0).alias("has"))
    about = f.groupBy("s").agg(F.count_if("has").alias("vectors"))
    return typed.join(about, F.col("name") == F.col("s"), "left").select("name", "entity_type", "mentions", F.coalesce("vectors", F.lit(0)).alias("vectors"))


def working_set(spark, folder):
    """Of all sessions with a result: the 50 newest messages, the 50 newest sessions and the 50 entities mentioned most."""
    m = messages(spark, folder, "session_id", "category").where("session_id is not null")
    inside = m.where("category = 'result'").select("session_id").distinct()
    held = m.join(inside, "session_id", "left_semi")
    newest = held.orderBy(F.col("at").desc_nulls_last(), "key").limit(50).select(F.lit("message").alias("arm"), F.col("key").alias("item"))
    last = held.groupBy("session_id").agg(F.max("at").alias("at")).orderBy(F.col("at").desc_nulls_last(), "session_id").limit(50).select(F.lit("session").alias("arm"), F.col("session_id").alias("item"))
    named = mentions(spark, folder).join(held.select("key"), "key", "left_semi").groupBy("name").agg(F.count("*").alias("c"), F.min("name").alias("item"))
    common = named.orderBy(F.col("c").desc(), "name").limit(50).select(F.lit("entity").alias("arm"), "item")
    return newest.unionByName(last).unionByName(common)


def visibility_lookup(spark, folder):
    """The visibility of every recalled node that is a fact; null as empty."""
    r = read(spark, folder, "recall_items", "node_id").where("node_id is not null").distinct()
    f = read(spark, folder, "fact_upserts", "upsert_id", "visibility")
    return f.join(r, f["upsert_id"] == r["node_id"], "left_semi").select("upsert_id", F.coalesce(T.visibility(F.col("visibility")), F.lit("")).alias("visibility"))


def vectors_by_id(spark, folder):
    """The vectors of all recalled nodes that are facts."""
    r = read(spark, folder, "recall_items", "node_id").distinct()
    f = read(spark, folder, "fact_upserts", "upsert_id", "embedding").where("size(embedding) > 0")
    return f.join(r, f["upsert_id"] == r["node_id"], "left_semi").select("upsert_id", F.size("embedding").alias("dimension"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


def seed_nodes(spark, folder):
    """Entities and participants that the subjects of facts name, each once."""
    names = read(spark, folder, "fact_upserts", "subject").where("subject is not null").select(T.canonical_name(F.col("subject")).alias("name")).distinct()
    e = mentions(spark, folder).select("name", F.lit("entity").alias("label"), F.col("name").alias("node"))
    p = read(spark, folder, "participants", "participant_id", "display_name").where("display_name is not null").select(T.canonical_name(F.col("display_name")).alias("name"), F.lit("participant").alias("label"), F.col("participant_id").alias("node"))
    return e.unionByName(p).join(names, "name", "left_semi").where("name <> ''").select("label", "node").distinct()


def entity_fanout(spark, folder):
    """What hangs on each name, at the best score of its kinds of link: messages, sessions, facts by subject and object, people and artifacts."""
    n = mentions(spark, folder).where("name <> '' and key is not null").select("name", "key").distinct()
    m = messages(spark, folder, "session_id").select("key", "session_id").where("session_id is not null")
    of_session = n.join(m, "key").select("name", "session_id").distinct()
    f = read(spark, folder, "fact_upserts", "upsert_id", "subject", "object")
    p = read(spark, folder, "participants", "participant_id", "display_name")
    a = read(spark, folder, "ingest_artifacts", "artifact_id", "session_id").where("session_id is not null")
    arm = lambda df, name, label, node, score: df.select(name.alias("name"), F.lit(label).alias("label"), node.cast("string").alias("node"), F.lit(score).alias("score"))
    arms = [
        arm(n, F.col("name"), "message", F.col("key"), 1.0),
        arm(of_session, F.col("name"), "session", F.col("session_id"), 0.8),
        arm(f.where("subject is not null"), T.canonical_name(F.col("subject")), "fact", F.col("upsert_id"), 0.9),
        arm(f.where("object is not null"), T.canonical_name(F.col("object")), "fact", F.col("upsert_id"), 0.7),
        arm(p.where("display_name is not null"), T.canonical_name(F.col("display_name")), "participant", F.col("participant_id"), 0.6),
        arm(of_session.join(a, "session_id"), F.col("name"), "artifact", F.col("artifact_id"), 0.5),
    ]
    best = reduce(DataFrame.unionByName, arms).groupBy("name", "label", "node").agg(F.max("score").alias("score"))
    return best.groupBy("name", "label").agg(F.count("*").alias("nodes"), F.round(F.sum("score"), 6).alias("score"))


def type_probe(spark, folder):
    """Whether a message is about a person: mentioned itself, or by a fact about something that it mentions."""
    n = mentions(spark, folder).where("key is not null")
    direct = n.where("entity_type = 'PERSON'").select("key").distinct().withColumn("direct", F.lit(True))
    people = n.where("entity_type = 'PERSON' and name <> ''").select("name").distinct()
    f = read(spark, folder, "fact_upserts", "subject", "object").where("subject is not null and object is not null")
    linked = f.select(T.canonical_name(F.col("subject")).alias("s"), T.canonical_name(F.col("object")).alias("name")).join(people, "name", "left_semi").select(F.col("s").alias("name")).distinct()
    over = n.join(linked, "name", "left_semi").select("key").distinct().withColumn("over", F.lit(True))
    keys = n.select("key").distinct()
    return keys.join(direct, "key", "left").join(over, "key", "left").select("key", F.coalesce("direct", F.lit(False)).alias("direct"), F.coalesce("over", F.lit(False)).alias("by_fact"))


def chunk_owners(spark, folder):
    """Lines by who owns them: message, session or the artifact itself; and the action behind it."""
    a = sources.owners(artifacts(spark, folder, "content"))
    lines = sources.line_chunks(a, "artifact_id", "content").groupBy("artifact_id").agg(F.count("*").alias("chunks"))
    return a.join(lines, "artifact_id").groupBy("owner", F.col("produced_by_action_id").isNotNull().alias("by_action")).agg(F.count("*").alias("artifacts"), F.sum("chunks").alias("chunks"))


def lineage(spark, folder):
    """Where artifacts come from: the message, its session and its sender."""
    a = artifacts(spark, folder).withColumnRenamed("session_id", "own_session")
    m = messages(spark, folder, "session_id", "sender_id")
    return a.join(m, a["triggered_by_message_id"] == m["key"], "left").select("artifact_id", F.col("key").alias("message"), F.coalesce("session_id", "own_session").alias("session_id"), "sender_id", F.col("produced_by_action_id").alias("action"))


def provenance(spark, folder):
    """Category, source and revision of every recalled node that is a message."""
    r = read(spark, folder, "recall_items", "node_id").where("node_id is not null").distinct()
    m = read(spark, folder, "ingest_messages", "delivery_id", "category", "source_id", "revision_id")
    return m.join(r, m["delivery_id"] == r["node_id"], "left_semi")


def answer_citations(spark, folder):
    r = read(spark, folder, "recall_items", "query_id", "item_no", "source_id", "score").where("score is not null and not isnan(score)")
    return sources.citations(r, "query_id", "source_id", "score", "item_no").select("query_id", "source_id", F.col("place").cast("int").alias("place"))


def reading_order(spark, folder):
    """Spans of each message in reading order: each with the one before it, and the words between."""
    n = mentions(spark, folder, "start_word", "end_word").where("key is not null and start_word is not null")
    w = W.partitionBy("key").orderBy("start_word", "span_id")
    linked = n.select("key", "span_id", F.lag("span_id").over(w).alias("src"), (F.col("start_word") - F.lag("end_word").over(w)).alias("words"))
    return linked.where("src is not null").select("src", F.col("span_id").alias("dst"), "words")


def action_chain(spark, folder):
    """NEXT_ACTION edges of a session, by the time of the triggering message."""
    m = messages(spark, folder, "session_id")
    a = artifacts(spark, folder).where("produced_by_action_id is not null").select("produced_by_action_id", "triggered_by_message_id")
    timed = a.join(m, a["triggered_by_message_id"] == m["key"]).where("session_id is not null").groupBy("session_id", "produced_by_action_id").agg(F.min("at").alias("at"))
    return temporal.chain(timed, ["session_id"], "at", "produced_by_action_id")


def suppressed_spans(spark, folder):
    """Spans that don't overlap another span of their message with more confidence."""
    n = mentions(spark, folder, "start_word", "end_word", "confidence").where("key is not null and start_word is not null and end_word is not null and confidence is not null")
    strong = n.where("entity_type = 'PERSON'").select("key", "start_word", "end_word", "confidence")
    weak = n.where("entity_type is null or entity_type <> 'PERSON'")
    return suppressed(weak, strong, "key", "start_word", "end_word", "confidence").select("span_id", "name", "entity_type")


def artifact_mimes(spark, folder):
    """MIME type and modality of all artifacts, by magic bytes, path and content."""
    a = read(spark, folder, "ingest_artifacts", "path", "content")
    mime = T.mime_of(F.lit(None).cast("string"), F.encode("content", "utf-8"), F.col("path"))
    return a.select(mime.alias("mime")).groupBy("mime", T.modality_of(F.col("mime")).alias("modality")).agg(F.count("*").alias("artifacts"))


def modality_flags(spark, folder):
    """Which modalities a source has any artifact of."""
    a = read(spark, folder, "ingest_artifacts", "source_id", "path", "content")
    m = a.select("source_id", T.modality_of(T.mime_of(F.lit(None).cast("string"), F.encode("content", "utf-8"), F.col("path"))).alias("m"))
    return m.groupBy("source_id").agg(*[F.bool_or(F.col("m") == k).alias(f"has_{k}") for k in ("text", "code", "markup", "image", "audio")])


def session_members(spark, folder):
    """Everyone who sent or received in a session: lists concatenated, unnested, each once."""
    m = read(spark, folder, "ingest_messages", "session_id", "sender_id", "addressed_to").where("session_id is not null")
    everyone = F.concat(F.coalesce("addressed_to", F.array().cast("array<string>")), F.array("sender_id"))
    return m.select("session_id", F.explode(F.array_distinct(everyone)).alias("member")).where("member is not null and member <> ''").distinct().groupBy("session_id").agg(F.count("*").alias("members"), F.min("member").alias("first"))


QUERIES = {f.__name__: f for f in (
    chunk_range, tool_calls, session_observations, unfinalized_sessions, entity_scan, working_set, visibility_lookup, vectors_by_id, seed_nodes, entity_fanout, type_probe, chunk_owners, lineage, provenance,
    answer_citations, reading_order, action_chain, suppressed_spans, artifact_mimes, modality_flags, session_members,
)}

_LINES = "l AS (SELECT artifact_id, unnest(range(len(x))) AS index, unnest(x) AS text FROM (SELECT artifact_id, string_split(content, chr(10)) AS x FROM ingest_artifacts WHERE content <> ''))"
_EXT = r"lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1))"
_MIME = f"""CASE WHEN content LIKE '%PDF%' AND starts_with(content, '%PDF') THEN 'application/pdf' ELSE coalesce(CASE {_EXT} WHEN 'md' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' WHEN 'html' THEN 'text/html' WHEN 'json' THEN 'application/json' WHEN 'csv' THEN 'text/csv'
    WHEN 'py' THEN 'text/x-python' WHEN 'rs' THEN 'text/x-rust' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'mp4' THEN 'video/mp4' END,
    CASE WHEN content IS NOT NULL THEN 'text/plain' END, 'application/octet-stream') END"""
_MODALITY = """CASE WHEN mime = 'text/html' THEN 'markup' WHEN mime IN ('application/json', 'text/csv') THEN 'structured' WHEN mime LIKE 'text/x-%' THEN 'code' WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime LIKE 'text/%' THEN 'text'
    WHEN mime LIKE 'image/%' THEN 'image' WHEN mime LIKE 'audio/%' THEN 'audio' WHEN mime LIKE 'video/%' THEN 'video' ELSE 'other' END"""

SQL = {
    "chunk_range": f"WITH {_LINES} SELECT artifact_id, index::INT AS index, length(text)::INT AS chars FROM l WHERE index BETWEEN 1 AND 4 AND artifact_id IN (SELECT artifact_id FROM ingest_artifacts WHERE triggered_by_message_id IS NOT NULL)",
    "tool_calls": f"""WITH {sql_messages('sender_id', 'session_id')}, {sql_artifacts('kind')} SELECT action AS produced_by_action_id, artifact_id, kind, coalesce(m.session_id, a.session_id) AS session_id, sender_id, sent AS "at"
        FROM a LEFT JOIN m ON triggered = key WHERE action IS NOT NULL ORDER BY sent DESC NULLS LAST, action, artifact_id LIMIT 50""",
    "session_observations": f"""WITH {sql_messages('session_id', 'visibility')}, {sql_mentions()} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY sent NULLS LAST, span_id)::INT AS position, span_id, name
        FROM n JOIN m USING (key) WHERE session_id IS NOT NULL AND (visibility IS NULL OR trim(visibility) IN ('', 'public'))""",
    "unfinalized_sessions": "SELECT session_id, count(*) AS deliveries FROM ingest_messages m WHERE session_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ingest_artifacts a WHERE a.session_id = m.session_id) GROUP BY 1",
    "entity_scan": f"""WITH {sql_mentions()}, c AS (SELECT name, coalesce(entity_type, '') AS t, count(*) AS c FROM n WHERE name <> '' GROUP BY 1, 2), t AS (SELECT name, arg_max(t, (c, t)) AS entity_type, sum(c)::BIGINT AS mentions FROM c GROUP BY 1),
        f AS (SELECT {sql_name('subject')} AS s, count(*) FILTER (len(embedding) > 0) AS vectors FROM fact_upserts WHERE subject IS NOT NULL GROUP BY 1) SELECT name, entity_type, mentions, coalesce(vectors, 0) AS vectors FROM t LEFT JOIN f ON name = s""",
    "working_set": f"""WITH {sql_messages('session_id', 'category')}, {sql_mentions()}, h AS (SELECT * FROM m WHERE session_id IN (SELECT session_id FROM m WHERE category = 'result' AND session_id IS NOT NULL)),
        x AS (SELECT 'message' AS arm, key AS item FROM h ORDER BY sent DESC NULLS LAST, key LIMIT 50), y AS (SELECT 'session' AS arm, session_id AS item FROM h GROUP BY session_id ORDER BY max(sent) DESC NULLS LAST, session_id LIMIT 50),
        z AS (SELECT 'entity' AS arm, name AS item FROM n WHERE key IN (SELECT key FROM h) GROUP BY name ORDER BY count(*) DESC, name LIMIT 50) SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z""",
    "visibility_lookup": "SELECT upsert_id, CASE WHEN trim(visibility) <> '' AND lower(trim(visibility)) <> 'public' THEN trim(visibility) ELSE '' END AS visibility FROM fact_upserts WHERE upsert_id IN (SELECT node_id FROM recall_items)",
    "vectors_by_id": "SELECT upsert_id, len(embedding)::INT AS dimension, round(embedding[1]::DOUBLE, 5) AS first FROM fact_upserts WHERE len(embedding) > 0 AND upsert_id IN (SELECT node_id FROM recall_items)",
    "seed_nodes": f"""WITH {sql_mentions()}, s AS (SELECT DISTINCT {sql_name('subject')} AS name FROM fact_upserts WHERE subject IS NOT NULL)
        SELECT DISTINCT 'entity' AS label, name AS node FROM n WHERE name <> '' AND name IN (SELECT name FROM s) UNION SELECT 'participant', participant_id FROM participants WHERE {sql_name('display_name')} <> '' AND {sql_name('display_name')} IN (SELECT name FROM s)""",
    "entity_fanout": f"""WITH {sql_messages('session_id')}, {sql_mentions()}, e AS (SELECT DISTINCT name, key FROM n WHERE name <> '' AND key IS NOT NULL), o AS (SELECT DISTINCT name, session_id FROM e JOIN m USING (key) WHERE session_id IS NOT NULL),
        u AS (SELECT name, 'message' AS label, key AS node, 1.0 AS score FROM e UNION ALL SELECT name, 'session', session_id, 0.8 FROM o UNION ALL SELECT {sql_name('subject')}, 'fact', upsert_id::VARCHAR, 0.9 FROM fact_upserts WHERE subject IS NOT NULL
          UNION ALL SELECT {sql_name('object')}, 'fact', upsert_id::VARCHAR, 0.7 FROM fact_upserts WHERE object IS NOT NULL UNION ALL SELECT {sql_name('display_name')}, 'participant', participant_id, 0.6 FROM participants WHERE display_name IS NOT NULL
          UNION ALL SELECT name, 'artifact', artifact_id, 0.5 FROM o JOIN ingest_artifacts USING (session_id)), b AS (SELECT name, label, node, max(score) AS score FROM u GROUP BY 1, 2, 3)
        SELECT name, label, count(*) AS nodes, round(sum(score)::DOUBLE, 6) AS score FROM b GROUP BY 1, 2""",
    "type_probe": f"""WITH {sql_mentions()}, k AS (SELECT DISTINCT key FROM n WHERE key IS NOT NULL), l AS (SELECT {sql_name('subject')} AS name FROM fact_upserts WHERE subject IS NOT NULL AND {sql_name('object')} IN (SELECT name FROM n WHERE entity_type = 'PERSON' AND name <> '' AND key IS NOT NULL))
        SELECT key, key IN (SELECT key FROM n WHERE entity_type = 'PERSON' AND key IS NOT NULL) AS direct, key IN (SELECT key FROM n WHERE key IS NOT NULL AND name IN (SELECT name FROM l)) AS by_fact FROM k""",
    "chunk_owners": f"""WITH {_LINES}, {sql_artifacts()}, c AS (SELECT artifact_id, count(*) AS chunks FROM l GROUP BY 1)
        SELECT CASE WHEN triggered IS NOT NULL THEN 'message' WHEN session_id IS NOT NULL THEN 'session' ELSE 'artifact' END AS owner, action IS NOT NULL AS by_action, count(*) AS artifacts, sum(chunks)::BIGINT AS chunks FROM a JOIN c USING (artifact_id) GROUP BY 1, 2""",
    "lineage": f"WITH {sql_messages('session_id', 'sender_id')}, {sql_artifacts()} SELECT artifact_id, key AS message, coalesce(m.session_id, a.session_id) AS session_id, sender_id, action FROM a LEFT JOIN m ON triggered = key",
    "provenance": "SELECT delivery_id, category, source_id, revision_id FROM ingest_messages WHERE delivery_id IN (SELECT node_id FROM recall_items)",
    "answer_citations": """WITH b AS (SELECT query_id, source_id, min((-round(score, 9), item_no)) AS b FROM recall_items WHERE score IS NOT NULL AND NOT isnan(score) AND source_id IS NOT NULL GROUP BY 1, 2)
        SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY b)::INT AS place FROM b""",
    "reading_order": f"""WITH {sql_mentions('start_word', 'end_word')} SELECT src, dst, words FROM (SELECT lag(span_id) OVER w AS src, span_id AS dst, start_word - lag(end_word) OVER w AS words FROM n WHERE key IS NOT NULL AND start_word IS NOT NULL
        WINDOW w AS (PARTITION BY key ORDER BY start_word, span_id)) WHERE src IS NOT NULL""",
    "action_chain": f"""WITH {sql_messages('session_id')}, {sql_artifacts()}, t AS (SELECT m.session_id, action, min(sent) AS t FROM a JOIN m ON triggered = key WHERE action IS NOT NULL AND m.session_id IS NOT NULL GROUP BY 1, 2)
        SELECT session_id, src, dst, gap_ms FROM (SELECT session_id, lag(action) OVER w AS src, action AS dst, greatest(0, epoch_us(t) // 1000 - lag(epoch_us(t) // 1000) OVER w) AS gap_ms FROM t WINDOW w AS (PARTITION BY session_id ORDER BY t, action)) WHERE src IS NOT NULL""",
    "suppressed_spans": f"""WITH {sql_mentions('start_word', 'end_word', 'confidence')}, k AS (SELECT * FROM n WHERE key IS NOT NULL AND start_word IS NOT NULL AND end_word IS NOT NULL AND confidence IS NOT NULL)
        SELECT span_id, name, entity_type FROM k x WHERE (entity_type IS NULL OR entity_type <> 'PERSON') AND NOT EXISTS (SELECT 1 FROM k y WHERE y.entity_type = 'PERSON' AND y.key = x.key AND y.start_word < x.end_word AND x.start_word < y.end_word AND y.confidence >= x.confidence)""",
    "artifact_mimes": f"WITH t AS (SELECT {_MIME} AS mime FROM ingest_artifacts) SELECT mime, {_MODALITY} AS modality, count(*) AS artifacts FROM t GROUP BY 1, 2",
    "modality_flags": f"WITH t AS (SELECT source_id, {_MIME} AS mime FROM ingest_artifacts), k AS (SELECT source_id, {_MODALITY} AS m FROM t) SELECT source_id, " + ", ".join(f"bool_or(m = '{k}') AS has_{k}" for k in ("text", "code", "markup", "image", "audio")) + " FROM k GROUP BY 1",
    "session_members": """WITH u AS (SELECT session_id, unnest(list_concat(coalesce(addressed_to, []), [sender_id])) AS member FROM ingest_messages WHERE session_id IS NOT NULL), d AS (SELECT DISTINCT * FROM u WHERE member <> '')
        SELECT session_id, count(*) AS members, min(member) AS first FROM d GROUP BY 1""",
}
