"""Facts, patterns, procedures, topics and summaries, changes and deletions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.functions.ids import stable_hex64
from engramix.functions.text import canonical_name, fact_id
from engramix.operators import derive, mutate
from engramix.sources.tables import read


def _observations(spark, folder):
    """Each order as an observation: the customer prefers a priority."""
    o = read(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    c = read(spark, folder, "customer", "c_custkey", "c_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("subject"), F.lit("order_priority").alias("predicate"), F.col("o_orderpriority").alias("object"), F.col("o_orderdate").alias("observed_at"), F.lit(None).cast("string").alias("visibility"))


def consolidated_facts(spark, folder):
    """Observations to facts: canonical object, confidence and contradiction."""
    return derive.facts(derive.canonical_objects(derive.votes(_observations(spark, folder)))).select("fact_id", "object", "observation_count", F.round("confidence", 6).alias("confidence"), "first_observed", "contradicted")


def upserted_facts(spark, folder):
    """Facts of the first half of the upserts, with the second half laid over."""
    f = read(spark, folder, "fact_upserts", "upsert_id", "subject", "predicate", "object", "observation_count", "observed_at", "visibility").where("subject is not null and predicate is not null")
    given = f.select(fact_id(F.col("subject"), F.col("predicate"), F.col("object"), F.col("visibility")).alias("fact_id"), "upsert_id", "subject", "predicate", "object", F.coalesce("observation_count", F.lit(1)).alias("observation_count"), F.col("observed_at").alias("first_observed"))
    empty = given.where("false").select("fact_id", "subject", "predicate", "object", "observation_count", "first_observed")
    base = mutate.upsert_facts(empty, given.where("upsert_id % 2 = 1"))
    return mutate.upsert_facts(base, given.where("upsert_id % 2 = 0")).select("fact_id", "observation_count", "first_observed", F.round("confidence", 6).alias("confidence"), "created")


def success_sequences(spark, folder):
    e = read(spark, folder, "events", "event_id", "user_id", "ts", "event_type")
    return derive.followed_pairs(e, "user_id", "event_type", F.col("event_type") != "error", "ts", "event_id")


def episode_patterns(spark, folder):
    e = read(spark, folder, "events", "user_id", "event_type", "value").select(F.col("event_type").alias("action"), F.when(F.pmod("user_id", F.lit(3)) == 0, "failure").otherwise("success").alias("outcome"), F.least(F.lit(1.0), F.col("value") / 100).alias("importance"))
    return derive.patterns(e, "action", "outcome", "importance").select("action", "outcome", "n", F.round("mean_importance", 6).alias("mean_importance"))


def topic_vectors(spark, folder):
    """Mean vector of each label, and how large it is."""
    e = read(spark, folder, "embeddings", "embedding", "label")
    pooled = derive.vector_mean(e, ["label"], "embedding", 64)
    return pooled.select("label", F.round(F.col("mean")[0], 6).alias("first"), F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared_length"))


def session_summaries(spark, folder):
    """The first distinct messages of each session, up to 400 characters."""
    m = read(spark, folder, "ingest_messages", "session_id", "content", "msg_timestamp", "delivery_id").where("session_id is not null and content is not null")
    return derive.first_claims(m, "session_id", "content", "msg_timestamp", "delivery_id", 5, 400).select("session_id", F.length("summary").alias("chars"), F.md5("summary").alias("digest"))


def entity_merge(spark, folder):
    """Entities by canonical name and type: mentions added, the most confident spelling kept."""
    n = read(spark, folder, "ner_spans", "span_id", "text", "entity_type", "confidence").where("text is not null and entity_type is not null").withColumn("name", canonical_name(F.col("text")))
    best = F.max_by("text", F.struct("confidence", -F.col("span_id")))
    return n.where("name <> ''").groupBy(stable_hex64("ent", F.col("name"), F.col("entity_type")).alias("entity_id")).agg(F.count("*").alias("frequency"), F.max("confidence").alias("confidence"), best.alias("spelling"))


def entity_repoint(spark, folder):
    """Mentions moved from spellings to canonical names, equal edges merged."""
    n = read(spark, folder, "ner_spans", "message_id", "text").where("text is not null and message_id is not null")
    edges = n.groupBy(F.col("message_id").alias("src"), F.col("text").alias("dst")).agg(F.count("*").alias("count")).withColumn("etype", F.lit("MENTIONS"))
    mapping = n.select("text").distinct().select(F.col("text").alias("old"), canonical_name(F.col("text")).alias("new"))
    return mutate.repoint(edges, mapping).select("src", "dst", "count")


def spliced_chain(spark, folder):
    """The message chain after every tenth message is deleted."""
    m = read(spark, folder, "ingest_messages", "session_id", "msg_timestamp", "delivery_id").where("session_id is not null")
    return mutate.splice(m, m.where("delivery_id % 10 = 0"), ["session_id"], "msg_timestamp", "delivery_id")


def surviving_facts(spark, folder):
    """Support of facts once the observations of one month are deleted."""
    f = read(spark, folder, "fact_upserts", "upsert_id", "subject", "predicate", "object", "observed_at").where("subject is not null and predicate is not null")
    s = f.select(fact_id(F.col("subject"), F.col("predicate"), F.col("object"), F.lit(None).cast("string")).alias("fact_id"), F.col("upsert_id").alias("observation_id"), "observed_at")
    doomed = s.where("observed_at >= timestamp_ntz'2024-03-01' and observed_at < timestamp_ntz'2024-04-01'")
    return mutate.surviving_support(s, doomed)


def cascade_delete(spark, folder):
    """Customers of one nation deleted with the edges at either end."""
    nodes = read(spark, folder, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("nid"), "c_nationkey")
    edges = read(spark, folder, "orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("src"), (-F.col("o_orderkey")).alias("dst"))
    left, kept = mutate.delete(nodes, edges, nodes.where("c_nationkey = 3"))
    return left.select(F.lit("node").alias("what"), F.col("c_nationkey").cast("long").alias("of")).unionByName(kept.select(F.lit("edge").alias("what"), F.pmod("src", F.lit(25)).alias("of"))).groupBy("what", "of").agg(F.count("*").alias("n"))


def node_upsert(spark, folder):
    """Customers with new balances for some, and new customers."""
    base = read(spark, folder, "customer", "c_custkey", "c_name", "c_acctbal")
    changes = read(spark, folder, "supplier", "s_suppkey", "s_acctbal").select((F.col("s_suppkey") * 50).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return mutate.upsert(base, changes, ["c_custkey"])


def content_versions(spark, folder):
    """Artifacts by content hash: how many share it, and the first of them."""
    a = read(spark, folder, "ingest_artifacts", "artifact_id", "content").where("content is not null and content <> ''")
    return a.groupBy(F.sha2("content", 256).alias("hash")).agg(F.count("*").alias("artifacts"), F.min("artifact_id").alias("first_artifact"), F.max(F.length("content")).alias("chars"))


def object_clusters(spark, folder):
    """Objects of facts of one subject and predicate, clustered by their vectors."""
    f = read(spark, folder, "fact_upserts", "subject", "predicate", "object", "embedding").where("subject is not null and predicate is not null and object is not null").withColumn("predicate", F.lower("predicate"))
    return derive.cluster_objects(f, ["subject", "predicate"], "object", "embedding")


QUERIES = {f.__name__: f for f in (consolidated_facts, upserted_facts, success_sequences, episode_patterns, topic_vectors, session_summaries, entity_merge, entity_repoint, spliced_chain, surviving_facts, cascade_delete, node_upsert, content_versions, object_clusters)}

_VIS = "CASE WHEN trim({0}) <> '' AND lower(trim({0})) <> 'public' THEN trim({0}) END"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FACT = "concat_ws('|', " + _LOW.format("concat_ws('|', coalesce(subject, ''), coalesce(predicate, ''), coalesce(object, ''))") + ", {0})"
_NAME = r"lower(regexp_replace(trim(regexp_replace({0}, '[\s\x{{0B}}]+', ' ', 'g')), '^[!-/:-@\[-`{{-~\s]+|[!-/:-@\[-`{{-~\s]+$', '', 'g'))"
_MS = "(epoch_us({0}) // 1000)"

SQL = {
    "consolidated_facts": f"""WITH v AS (SELECT lower(c_name) AS s, lower(trim(o_orderpriority)) AS o, count(*) AS n, max(o_orderdate) AS latest, min(o_orderdate) AS earliest, any_value(trim(o_orderpriority)) AS spelling FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, {_MS.format('latest')} DESC, o) AS k, sum(n) OVER (PARTITION BY s) AS total, min(earliest) OVER (PARTITION BY s) AS first_observed FROM v)
        SELECT regexp_replace(regexp_replace(s, '^[!-/:-@\\[-`{{-~]+', ''), '[!-/:-@\\[-`{{-~]+$', '') || '|order_priority|' || lower(spelling) AS fact_id, spelling AS object, total::BIGINT AS observation_count, round((total + 1.0) / (total + 2.0), 6) AS confidence, first_observed, 1 - n / total > 0.40 AS contradicted FROM r WHERE k = 1""",
    "upserted_facts": f"""WITH f AS (SELECT upsert_id, {_FACT.format(_VIS.format('visibility'))} AS fact_id, coalesce(observation_count, 1) AS n, observed_at FROM fact_upserts WHERE subject IS NOT NULL AND predicate IS NOT NULL)
        SELECT fact_id, sum(n)::BIGINT AS observation_count, min(observed_at) AS first_observed, round((sum(n) + 1.0) / (sum(n) + 2.0), 6) AS confidence, bool_and(upsert_id % 2 = 0) AS created FROM f GROUP BY 1""",
    "success_sequences": f"""WITH l AS (SELECT user_id, event_type AS first_action, event_type <> 'error' AS ok, lead(event_type) OVER w AS next_action, lead(event_type) OVER w <> 'error' AS ok2, lead({_MS.format('ts')}) OVER w - {_MS.format('ts')} AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, first_action, next_action, count(*) AS support FROM l WHERE ok AND ok2 AND gap <= 3600000 GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
    "episode_patterns": """SELECT event_type AS action, CASE WHEN user_id % 3 = 0 THEN 'failure' ELSE 'success' END AS outcome, count(*) AS n, round(avg(coalesce(least(1.0, value / 100), 0.5)), 6) AS mean_importance FROM events GROUP BY 1, 2 HAVING count(*) >= 3 AND avg(coalesce(least(1.0, value / 100), 0.5)) > 0.3""",
    "topic_vectors": """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS i FROM embeddings WHERE len(embedding) = 64), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2)
        SELECT label, round(max(v) FILTER (i = 1), 6) AS first, round(sum(v * v), 6) AS squared_length FROM m GROUP BY 1""",
    "session_summaries": """WITH m AS (SELECT session_id, lower(trim(content, ' ')) AS k, (msg_timestamp, delivery_id) AS o, trim(content, ' ') AS c FROM ingest_messages WHERE session_id IS NOT NULL AND content IS NOT NULL AND trim(content, ' ') <> ''),
        f AS (SELECT session_id, min(o) AS o, arg_min(c, o) AS c FROM m GROUP BY session_id, k), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o) AS n FROM f), t AS (SELECT session_id, left(string_agg(c, ' ' ORDER BY n), 400) AS s FROM r WHERE n <= 5 GROUP BY 1)
        SELECT session_id, length(s)::INT AS chars, md5(s) AS digest FROM t""",
    "entity_merge": f"""WITH n AS (SELECT *, {_NAME.format('text')} AS name FROM ner_spans WHERE text IS NOT NULL AND entity_type IS NOT NULL)
        SELECT 'ent_' || left(sha256((name || chr(0) || entity_type)), 16) AS entity_id, count(*) AS frequency, max(confidence) AS confidence, arg_max(text, (confidence, -span_id)) AS spelling FROM n WHERE name <> '' GROUP BY name, entity_type""",
    "entity_repoint": f"SELECT message_id AS src, {_NAME.format('text')} AS dst, count(*)::BIGINT AS count FROM ner_spans WHERE text IS NOT NULL AND message_id IS NOT NULL GROUP BY 1, 2",
    "spliced_chain": f"""SELECT session_id, src, dst, gap_ms FROM (SELECT session_id, lag(delivery_id) OVER w AS src, delivery_id AS dst, greatest(0, {_MS.format('msg_timestamp')} - lag({_MS.format('msg_timestamp')}) OVER w) AS gap_ms
        FROM ingest_messages WHERE session_id IS NOT NULL AND delivery_id % 10 <> 0 WINDOW w AS (PARTITION BY session_id ORDER BY msg_timestamp, delivery_id)) WHERE src IS NOT NULL""",
    "surviving_facts": f"""SELECT {_LOW.format("concat_ws('|', subject, predicate, coalesce(object, ''))")} AS fact_id, count(*) AS support, count(*) FILTER (NOT coalesce(observed_at >= TIMESTAMP '2024-03-01' AND observed_at < TIMESTAMP '2024-04-01', false)) AS "left"
        FROM fact_upserts WHERE subject IS NOT NULL AND predicate IS NOT NULL GROUP BY 1""",
    "cascade_delete": """SELECT 'node' AS what, c_nationkey::BIGINT AS "of", count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 2
        UNION ALL SELECT 'edge', o_custkey % 25, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 2""",
    "node_upsert": "SELECT coalesce(s_suppkey * 50, c_custkey)::BIGINT AS c_custkey, c_name, coalesce(s_acctbal, c_acctbal) AS c_acctbal FROM customer FULL JOIN supplier ON s_suppkey * 50 = c_custkey",
    "content_versions": "SELECT sha256(content) AS hash, count(*) AS artifacts, min(artifact_id) AS first_artifact, max(length(content))::INT AS chars FROM ingest_artifacts WHERE content <> '' GROUP BY 1",
}
