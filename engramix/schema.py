"""Typed tables of the memory graph: one schema for each label and edge type."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampNTZType(), "v": T.ArrayType(T.FloatType()), "m": T.MapType(T.StringType(), T.StringType()), "y": T.BinaryType(), "as": T.ArrayType(T.StringType())}
#: Half-open interval in epoch milliseconds; an open end is LONG_MAX.
LONG_MAX = (1 << 63) - 1
INTERVAL = T.StructType([T.StructField(n, T.LongType()) for n in ("lo", "hi")] + [T.StructField(n, T.StringType()) for n in ("lo_granularity", "hi_granularity", "lo_certainty", "hi_certainty")])


def _table(columns: str) -> T.StructType:
    fields = [T.StructField("nid", T.LongType(), False)]
    for column in columns.split():
        name, _, kind = column.partition(":")
        fields.append(T.StructField(name, INTERVAL if kind == "i" else _KINDS[kind or "s"]))
    return T.StructType(fields)


#: Columns of each label, with a letter for other types than string.
LABELS = {
    "Participant": _table("participant_id kind name capabilities:as metadata:m first_seen:t last_seen:t"),
    "Goal": _table("goal_id title status metrics:m guardrails owner_id deadline:t completed_at:t embedding:v"),
    "Task": _table("task_id title status priority completed_at:t embedding:v"),
    "Session": _table("session_id topic summary started_at:t ended_at:t embedding:v"),
    "Message": _table("message_id content content_type timestamp:t category source_id revision_id redacted:b visibility embedding:v"),
    "Action": _table("action_id action_type input output status started_at:t ended_at:t duration_ms:l error tool_name payload_hash embedding:v"),
    "Episode": _table("episode_id action_type outcome state delta importance:d timestamp:t embedding:v"),
    "Artifact": _table("artifact_id kind path content mime_type hash size:l language superseded_at:t retired_at:t visibility embedding:v"),
    "ArtifactContent": _table("content_id bytes:y uri mime size:l"),
    "Chunk": _table("chunk_id text index:l start:l end:l token_count:l chunk_type language symbol_name speaker heading context address search_text modality metadata:m embedding:v"),
    "Page": _table("page_id number:l text"),
    "Block": _table("block_id kind text index:l"),
    "Entity": _table("entity_id name entity_type first_seen:t last_seen:t frequency:l confidence:d invalidation_count:l unstable:b embedding:v"),
    "Observation": _table("observation_id content subject predicate object temporal_phrase temporal_anchor:t observed_at:t confidence:d visibility redacted:b embedding:v"),
    "Fact": _table("fact_id subject predicate object confidence:d observation_count:l valid_at:i source_rule visibility invalidation_reason invalidated_at:t embedding:v"),
    "Topic": _table("topic_id name summary member_count:l embedding:v"),
    "Summary": _table("summary_id content created_at:t embedding:v"),
    "Procedure": _table("procedure_id name status precondition effectiveness:d success_count:l failure_count:l"),
    "Rule": _table("rule_id name source status confidence:d missed_cycles:l last_matched:t"),
    "Pattern": _table("pattern_id kind description support:l"),
    "ConsolidationCycle": _table("cycle_id agent_id started_at:t completed_at:t processed:l created:l invalidated:l"),
    "DeadLetter": _table("letter_id step error payload retries:l max_retries:l"),
    "Organization": _table("org_id name"),
    "Team": _table("team_id name"),
    "KnowledgeBaseStats": _table("has_image:b has_audio:b has_video:b embedding_model embedding_dimension:l"),
    "Source": _table("source_id name uri first_seen:t last_seen:t retired_at:t"),
}
#: Endpoints of the edge types; '*' for any label. Every edge has src and dst, and may have a weight or gap.
EDGES = {
    "SENT_BY": ("Message", "Participant"), "ADDRESSED_TO": ("Message", "Participant"), "IN_SESSION": ("Message", "Session"), "NEXT": ("Message", "Message"), "OBSERVED_IN": ("Observation", "Message"), "OBSERVED_DURING": ("Observation", "Session"),
    "ABOUT": ("Observation", "*"), "SUPPORTED_BY": ("Fact", "Observation"), "DERIVED_BY": ("Fact", "Rule"), "DERIVED_FROM": ("*", "*"), "INVALIDATES": ("Fact", "Fact"), "SHARED_FROM": ("Fact", "Fact"), "CONTRADICTED_BY": ("Fact", "Episode"), "HAS_CHUNK": ("*", "Chunk"),
    "MENTIONS": ("*", "Entity"), "PERFORMED_BY": ("Action", "Participant"), "TRIGGERED_BY": ("Action", "Message"), "PRODUCED": ("Action", "Artifact"), "NEXT_ACTION": ("Action", "Action"), "RECORDED_BY": ("Episode", "Participant"), "INVOLVES": ("Episode", "*"), "FOLLOWED_BY": ("Episode", "Episode"),
    "CREATED_BY": ("Artifact", "Participant"), "MODIFIED_BY": ("Artifact", "Participant"), "ATTACHED_TO": ("Artifact", "Message"), "HAS_CONTENT": ("Artifact", "ArtifactContent"), "HAS_PAGE": ("Artifact", "Page"), "CONTAINS": ("Page", "Block"), "NEXT_IN_READING_ORDER": ("Block", "Block"),
    "FOR_TASK": ("Session", "Task"), "FOR_GOAL": ("Session", "Goal"), "PARTICIPATED_IN": ("Participant", "Session"), "OWNED_BY": ("Goal", "Participant"), "PARENT_GOAL": ("Goal", "Goal"), "PART_OF": ("Task", "Goal"), "ASSIGNED_TO": ("Task", "Participant"), "DEPENDS_ON": ("Task", "Task"), "SUBTASK_OF": ("Task", "Task"),
    "SUMMARIZES": ("Summary", "*"), "BELONGS_TO": ("*", "Topic"), "OPERATES_ON": ("Procedure", "*"), "USED_IN": ("Procedure", "Episode"), "SUPERSEDES": ("Rule", "Rule"), "COVERS": ("Rule", "Episode"), "PROCESSED": ("ConsolidationCycle", "Observation"), "INVOLVED": ("ConsolidationCycle", "*"),
    "CREATED": ("ConsolidationCycle", "Fact"), "REINFORCED": ("ConsolidationCycle", "Fact"), "INVALIDATED": ("ConsolidationCycle", "Fact"), "PROMOTED": ("ConsolidationCycle", "Procedure"), "APPLIED_RULE": ("ConsolidationCycle", "Rule"), "MEMBER_OF": ("Participant", "*"), "PART_OF_TEAM": ("Participant", "Team"), "TEAM_IN_ORG": ("Team", "Organization"), "FROM_SOURCE": ("*", "Source"),
}
EDGE = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False), T.StructField("etype", T.StringType(), False), T.StructField("weight", T.DoubleType()), T.StructField("gap_ms", T.LongType())])


def check_label(label: str) -> str:
    if label not in LABELS:
        raise ValueError(f"unknown label: {label}")
    return label


def check_edge(etype: str) -> str:
    if etype not in EDGES:
        raise ValueError(f"unknown edge type: {etype}")
    return etype


def check_property(label: str, name: str) -> str:
    if name not in LABELS[check_label(label)].fieldNames():
        raise ValueError(f"unknown property of {label}: {name}")
    return name
