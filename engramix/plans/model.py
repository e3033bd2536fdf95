"""The driver tables seen as nodes and edges of the memory model, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.functions.ids import canonical_message_id
from engramix.functions.text import canonical_name
from engramix.operators.sources import first_messages
from engramix.sources.tables import read


def messages(spark, folder, *columns):
    """One row for each message (of its deliveries the first): key, at, delivery_id and ``columns``."""
    m = read(spark, folder, "ingest_messages", "delivery_id", "message_id", "msg_timestamp", *columns)
    return first_messages(m.select(canonical_message_id(F.col("message_id")).alias("key"), F.col("msg_timestamp").alias("at"), "delivery_id", *columns), "key", "at", "delivery_id", *columns)


def mentions(spark, folder, *columns):
    """Recognised spans with the key of their message and their canonical name."""
    s = read(spark, folder, "ner_spans", "span_id", "message_id", "text", "entity_type", *columns).where("text is not null")
    return s.select("span_id", canonical_message_id(F.col("message_id")).alias("key"), canonical_name(F.col("text")).alias("name"), F.upper("entity_type").alias("entity_type"), *columns)


def artifacts(spark, folder, *columns):
    """Artifacts with the key of the message that triggered them."""
    a = read(spark, folder, "ingest_artifacts", "artifact_id", "session_id", "triggered_by_message_id", "produced_by_action_id", *columns)
    return a.withColumn("triggered_by_message_id", canonical_message_id(F.col("triggered_by_message_id")))


_BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]+"
_NAME = r"lower(regexp_replace(trim(regexp_replace({0}, '[\s\x{{0B}}]+', ' ', 'g')), '^[!-/:-@\[-`{{-~\s]+|[!-/:-@\[-`{{-~\s]+$', '', 'g'))"


def sql_key(column: str) -> str:
    """canonical_message_id in SQL."""
    bare = f"lower(regexp_replace({column}, '{_BLANK}', '', 'g'))"
    h = f"regexp_replace(regexp_replace({bare}, '^(urn:uuid:|uuid:)', ''), '[{{}}()-]', '', 'g')"
    dashed = "||'-'||".join(f"({h})[{a}:{b}]" for a, b in ((1, 8), (9, 12), (13, 16), (17, 20), (21, 32)))
    return f"(CASE WHEN regexp_full_match({h}, '[0-9a-f]{{32}}') THEN {dashed} ELSE nullif({bare}, '') END)"


def sql_name(column: str) -> str:
    """canonical_name in SQL."""
    return _NAME.format(column)


def sql_messages(*columns: str) -> str:
    """The view ``messages`` as a common table expression m; ``at`` is sent here."""
    more = "".join(f", {c}" for c in columns)
    return f"""m AS (SELECT key, sent, delivery_id{more} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sent NULLS LAST, delivery_id) AS rn
        FROM (SELECT {sql_key('message_id')} AS key, msg_timestamp AS sent, delivery_id{more} FROM ingest_messages) WHERE key IS NOT NULL) WHERE rn = 1)"""


def sql_mentions(*columns: str) -> str:
    more = "".join(f", {c}" for c in columns)
    return f"n AS (SELECT span_id, {sql_key('message_id')} AS key, {sql_name('text')} AS name, upper(entity_type) AS entity_type{more} FROM ner_spans WHERE text IS NOT NULL)"


def sql_artifacts(*columns: str) -> str:
    more = "".join(f", {c}" for c in columns)
    return f"a AS (SELECT artifact_id, session_id, {sql_key('triggered_by_message_id')} AS triggered, produced_by_action_id AS action{more} FROM ingest_artifacts)"
