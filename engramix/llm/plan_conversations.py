"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.llm.conversations import calibrated_gap, rebuild, split_at_gaps
from engramix.sources.tables import read


def p5_found(spark, folder):
    messages = read(spark, folder, "ingest_messages", "delivery_id", "message_id", "content", "sender_id", "session_id", "addressed_to", "msg_timestamp", "metadata")
    participants = read(spark, folder, "participants", "participant_id", "kind")
    return rebuild(messages, participants).select("session_id", "turn_no", "message_id")


def p5_sessions(spark, folder):
    """Of each sound session: how many turns, and how many of them human or agent."""
    messages = read(spark, folder, "ingest_messages", "delivery_id", "message_id", "content", "sender_id", "session_id", "addressed_to", "msg_timestamp", "metadata")
    turns = rebuild(messages, read(spark, folder, "participants", "participant_id", "kind"))
    return turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "human").alias("human_turns"), F.count_if(F.col("role") == "agent").alias("agent_turns"))


def p5_channels(spark, folder):
    """Conversations of each sender's own channel, split at calibrated gaps: how many messages each has, and when it begins."""
    rows = read(spark, folder, "ingest_messages", "delivery_id", "sender_id", "msg_timestamp").where("sender_id is not null").toDF("delivery", "sender_id", "ts")
    gap = calibrated_gap(rows, ["sender_id"], share=0.9)
    parts = split_at_gaps(rows, ["sender_id"], gap)
    return parts.groupBy("sender_id", "part").agg(F.count("*").alias("messages"), F.min("ts").alias("begins"))


QUERIES = {"p5_found": p5_found, "p5_sessions": p5_sessions, "p5_channels": p5_channels}

_TURNS = r"""
WITH RECURSIVE p AS (SELECT participant_id, coalesce(min(lower(trim(kind))), '') AS role FROM participants WHERE participant_id IS NOT NULL GROUP BY 1),
agents AS (SELECT list(participant_id) AS ids FROM p WHERE role = 'agent'),
raw AS (
  SELECT delivery_id, msg_timestamp AS ts, nullif(trim(session_id), '') AS session_id, sender_id,
    lower(regexp_replace(message_id, '[\s\x{A0}\x{AD}\x{200B}-\x{200F}\x{FEFF}]+', '', 'g')) AS a,
    lower(regexp_replace(metadata['reply_to'], '[\s\x{A0}\x{AD}\x{200B}-\x{200F}\x{FEFF}]+', '', 'g')) AS b,
    NOT coalesce(regexp_matches(content, '[^\s\p{Z}\x{85}\x{AD}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{0B}]'), false) AS blank,
    (addressed_to IS NULL OR len(addressed_to) = 0 OR list_has_any(addressed_to, (SELECT ids FROM agents))) AS wants
  FROM ingest_messages),
hexed AS (SELECT *, regexp_replace(regexp_replace(a, '^(urn:uuid:|uuid:)', ''), '[{}()-]', '', 'g') AS ha, regexp_replace(regexp_replace(b, '^(urn:uuid:|uuid:)', ''), '[{}()-]', '', 'g') AS hb FROM raw),
named AS (
  SELECT *, CASE WHEN regexp_full_match(ha, '[0-9a-f]{32}') THEN ha[1:8]||'-'||ha[9:12]||'-'||ha[13:16]||'-'||ha[17:20]||'-'||ha[21:32] ELSE nullif(a, '') END AS key,
    CASE WHEN regexp_full_match(hb, '[0-9a-f]{32}') THEN hb[1:8]||'-'||hb[9:12]||'-'||hb[13:16]||'-'||hb[17:20]||'-'||hb[21:32] ELSE nullif(b, '') END AS reply FROM hexed),
once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(key, delivery_id::VARCHAR) ORDER BY ts NULLS LAST, delivery_id) AS rn FROM named) WHERE rn = 1 AND session_id IS NOT NULL),
m AS MATERIALIZED (SELECT o.*, p.role FROM once o LEFT JOIN p ON o.sender_id = p.participant_id),
r AS MATERIALIZED (SELECT x.session_id, x.delivery_id, y.delivery_id AS target, coalesce(y.ts = x.ts AND y.delivery_id <> x.delivery_id, false) AS tied
  FROM m x LEFT JOIN m y ON x.session_id = y.session_id AND x.reply = y.key WHERE x.reply IS NOT NULL),
d AS (
  SELECT delivery_id, 1 AS depth FROM r WHERE tied AND target NOT IN (SELECT delivery_id FROM r WHERE tied)
  UNION ALL SELECT r.delivery_id, d.depth + 1 FROM r JOIN d ON r.target = d.delivery_id WHERE r.tied),
o AS (SELECT m.*, coalesce(d.depth, 0) AS depth, row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS LAST, coalesce(d.depth, 0), m.delivery_id) AS pos FROM m LEFT JOIN d USING (delivery_id)),
s AS (
  SELECT session_id FROM o GROUP BY 1
  HAVING bool_and(role IS NOT NULL) AND count(*) FILTER (NOT blank AND role = 'human') > 0 AND count(*) FILTER (NOT blank AND role = 'agent') > 0
    AND coalesce(max(pos) FILTER (NOT blank AND role = 'human' AND wants), 0) < max(pos) FILTER (NOT blank AND role = 'agent')),
sound AS (SELECT session_id FROM s WHERE session_id NOT IN (SELECT session_id FROM r WHERE target IS NULL))
"""

SQL = {
    "p5_found": _TURNS + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos)::INT AS turn_no, key AS message_id FROM o WHERE NOT blank AND session_id IN (SELECT session_id FROM sound)",
    "p5_sessions": _TURNS + "SELECT session_id, count(*) AS turns, count(*) FILTER (role = 'human') AS human_turns, count(*) FILTER (role = 'agent') AS agent_turns FROM o WHERE NOT blank AND session_id IN (SELECT session_id FROM sound) GROUP BY 1",
    "p5_channels": """WITH r AS (SELECT delivery_id AS d, sender_id, msg_timestamp AS ts FROM ingest_messages WHERE sender_id IS NOT NULL), g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sender_id ORDER BY ts NULLS LAST, d) AS gap FROM r),
        c AS (SELECT 2 * quantile_disc(gap, 0.9) AS gap FROM g WHERE ts IS NOT NULL AND gap IS NOT NULL), p AS (SELECT g.sender_id, ts, sum(CASE WHEN g.gap > c.gap THEN 1 ELSE 0 END) OVER (PARTITION BY sender_id ORDER BY ts NULLS LAST, d) + 1 AS part FROM g, c)
        SELECT sender_id, part::BIGINT AS part, count(*) AS messages, min(ts) AS begins FROM p GROUP BY 1, 2""",
}
