"""An agent's memory as a program uses it: sessions that take turns, tool calls and sources, and verbs over all of them.

Rows are gathered on the driver only as they are given (a turn, a unit of turns); everything else is a table of the
engine, and every verb replaces tables by others.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix.api import Engine
from engramix.functions.lexical import merged_json
from engramix.functions.text import canonical_name, cap_chars, fact_id, laplace, token_count
from engramix.operators import changes, derive, sources, temporal
from engramix.operators.chunking import CHUNKERS, Limits, chunk_table
from engramix.operators.predicates import Viewer

# Tokens above which the output of a tool becomes an artifact of its own.
OVERFLOW = 256
SCHEMAS = {
    "messages": "message_id string, session_id string, sender_id string, addressed_to array<string>, content string, content_type string, at timestamp_ntz, category string, source_id string, revision_id string, visibility string, redacted boolean",
    "actions": "action_id string, session_id string, message_id string, tool_name string, input string, output string, payload_hash string, artifact_id string, started_at timestamp_ntz",
    "artifacts": "artifact_id string, session_id string, message_id string, path string, kind string, content string, content_id string, source_id string, revision_id string, visibility string",
    "chunks": "chunk_id string, owner string, owner_kind string, index int, text string",
    "episodes": "episode_id string, agent_id string, action_type string, outcome string, importance double, state map<string,string>, at timestamp_ntz",
    "observations": "observation_id string, session_id string, subject string, predicate string, object string, content string, observed_at timestamp_ntz, visibility string",
    "goals": "goal_id string, title string, status string, metrics map<string,string>, parent string, owner_id string, at timestamp_ntz",
    "tasks": "task_id string, goal_id string, title string, status string, depends_on array<string>, at timestamp_ntz",
    "members": "member string, group string",
    "sources": "source_id string, name string, retired_at timestamp_ntz",
}


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class Conflict(ValueError):
    """A turn with a known identifier but another content."""


class Agent:
    """Verbs of one agent over the tables of an engine."""

    def __init__(self, engine: Engine, agent_id: str):
        self.engine, self.agent_id = engine, agent_id
        for name, schema in SCHEMAS.items():
            if name not in engine.tables:
                engine.tables[name] = engine.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        return self.engine.tables[name]

    def _add(self, name: str, rows: list[dict]) -> None:
        columns = self.table(name).columns
        fresh = self.engine.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], self.table(name).schema)
        self.engine.tables[name] = self.table(name).unionByName(fresh)

    def session(self, session_id: str) -> "Session":
        return Session(self, session_id)

    # Facts, episodes and observations.
    def assert_fact(self, subject: str, predicate: str, obj: str | None, at: datetime | None = None, visibility: str | None = None) -> DataFrame:
        """The table of facts with one more observation of this fact."""
        self.add_observation(subject, predicate, obj, at=at, visibility=visibility)
        return self.engine.consolidate()

    def invalidate_facts(self, ids: list[str], at: datetime | None = None) -> DataFrame:
        """Facts of these ids marked as invalid since ``at``."""
        gone = self.engine.spark.createDataFrame([(i,) for i in ids], "fact_id string")
        f = self.table("facts")
        old = F.col("invalidated_at") if "invalidated_at" in f.columns else F.lit(None).cast("timestamp_ntz")
        marked = f.join(gone.withColumn("__g", F.lit(True)), "fact_id", "left")
        self.engine.tables["facts"] = marked.withColumn("invalidated_at", F.when(F.col("__g"), F.coalesce(old, F.lit(at or _now()).cast("timestamp_ntz"))).otherwise(old)).drop("__g")
        return self.table("facts")

    def record_episode(self, action_type: str, outcome: str | None = None, importance: float | None = None, state: dict | None = None, at: datetime | None = None) -> str:
        key = f"ep-{uuid.uuid4().hex}"
        self._add("episodes", [{"episode_id": key, "agent_id": self.agent_id, "action_type": action_type, "outcome": outcome, "importance": importance, "state": state or {}, "at": at or _now()}])
        return key

    def record_query_episode(self, query: str, items: int, answered: bool) -> str:
        return self.record_episode("query", "success" if answered else "failure", 0.5, {"query": query, "items": str(items)})

    def episode_chain(self, max_gap_ms: int = 3_600_000) -> DataFrame:
        """FOLLOWED_BY edges of this agent's episodes."""
        return temporal.chain(self.table("episodes").where(F.col("agent_id") == self.agent_id), ["agent_id"], "at", "episode_id", max_gap_ms)

    def add_observation(self, subject: str, predicate: str, obj: str | None, content: str | None = None, session_id: str | None = None, at: datetime | None = None, visibility: str | None = None) -> str:
        key = f"obs-{uuid.uuid4().hex}"
        self._add("observations", [{"observation_id": key, "session_id": session_id, "subject": subject, "predicate": predicate, "object": obj, "content": content or " ".join(x for x in (subject, predicate, obj) if x), "observed_at": at or _now(), "visibility": visibility}])
        return key

    def procedures(self, least: int = 3) -> DataFrame:
        """Pairs of successful actions that followed each other, with how often and their effectiveness by counts."""
        e = self.table("episodes")
        found = derive.followed_pairs(e, "agent_id", "action_type", F.col("outcome") == "success", "at", "episode_id", least=least)
        tried = e.groupBy("agent_id", F.col("action_type").alias("next_action")).agg(F.count_if(F.col("outcome") == "success").alias("good"), F.count_if(F.col("outcome") == "failure").alias("bad"))
        return found.join(tried, ["agent_id", "next_action"]).withColumn("effectiveness", F.try_divide("good", F.col("good") + F.col("bad")))

    # Goals and tasks.
    def create_goal(self, goal_id: str, title: str, metrics: dict | None = None, parent: str | None = None) -> str:
        self._add("goals", [{"goal_id": goal_id, "title": title, "status": "active", "metrics": metrics or {}, "parent": parent, "owner_id": self.agent_id, "at": _now()}])
        return goal_id

    def create_task(self, task_id: str, goal_id: str, title: str, depends_on: list[str] | None = None) -> str:
        self._add("tasks", [{"task_id": task_id, "goal_id": goal_id, "title": title, "status": "active", "depends_on": depends_on or [], "at": _now()}])
        return task_id

    def complete_goal(self, goal_id: str, metrics: dict | None = None) -> DataFrame:
        """Goals with this one completed; its metrics are merged, later ones win."""
        add = F.create_map(*[F.lit(str(x)) for pair in (metrics or {}).items() for x in pair]) if metrics else F.create_map().cast("map<string,string>")
        hit = F.col("goal_id") == goal_id
        self.engine.tables["goals"] = self.table("goals").withColumn("metrics", F.when(hit, merged_json(F.col("metrics"), add)).otherwise(F.col("metrics"))).withColumn("status", F.when(hit, "completed").otherwise(F.col("status")))
        return self.table("goals")

    def goal_tree(self, goal_id: str) -> DataFrame:
        """Tasks of a goal and of all goals under it."""
        from engramix.operators.graph import descendants

        under = descendants(self.table("goals"), "goal_id", "parent").where(F.col("root") == goal_id).select(F.col("node").alias("goal_id"))
        return self.table("tasks").join(under, "goal_id", "left_semi").orderBy("task_id")

    # Groups and visibility.
    def add_member(self, member: str, group: str) -> None:
        self.remove_member(member, group)
        self._add("members", [{"member": member, "group": group}])

    def remove_member(self, member: str, group: str) -> None:
        self.engine.tables["members"] = self.table("members").where(~((F.col("member") == member) & (F.col("group") == group)))

    def viewer(self, participant: str) -> Viewer:
        """Groups named team:x or org:x that a participant belongs to, also through a team."""
        m = self.table("members")
        own = [r["group"] for r in m.where(F.col("member") == participant).select("group").distinct().collect()]
        over = [r["group"] for r in m.where(F.col("member").isin(own)).select("group").distinct().collect()] if own else []
        named = lambda kind: sorted({g.split(":", 1)[1] for g in own + over if g.startswith(kind)})
        return Viewer(participant, named("team:"), named("org:"))

    # Sources and privacy.
    def retire_source(self, source_id: str, at: datetime | None = None) -> DataFrame:
        gone = self.engine.spark.createDataFrame([(source_id,)], "source_id string")
        self.engine.tables["sources"] = changes.retire(self.table("sources"), gone, F.lit(at or _now()).cast("timestamp_ntz"))
        return self.table("sources")

    def restore_source(self, source_id: str) -> DataFrame:
        gone = self.engine.spark.createDataFrame([(source_id,)], "source_id string")
        self.engine.tables["sources"] = changes.retire(self.table("sources"), gone, F.lit(None).cast("timestamp_ntz"))
        return self.table("sources")

    def delete_session(self, session_id: str) -> None:
        gone = self.engine.spark.createDataFrame([(session_id,)], "session_id string")
        for name in ("messages", "actions", "artifacts", "observations"):
            self.engine.tables[name] = changes.without(self.table(name), gone, "session_id")
        owned = self.table("chunks").where(~((F.col("owner_kind") == "session") & (F.col("owner") == session_id)))
        self.engine.tables["chunks"] = owned

    def delete_artifact(self, artifact_id: str) -> None:
        gone = self.engine.spark.createDataFrame([(artifact_id,)], "artifact_id string")
        self.engine.tables["artifacts"] = changes.without(self.table("artifacts"), gone, "artifact_id")
        self.engine.tables["chunks"] = self.table("chunks").where(~((F.col("owner_kind") == "artifact") & (F.col("owner") == artifact_id)))

    def forget_participant(self, participant: str, name: str | None = None) -> None:
        """Nothing that this participant sent, and no observation about the name, is left."""
        people = self.engine.spark.createDataFrame([(participant, name)], "participant_id string, name string")
        self.engine.tables["messages"] = changes.without(self.table("messages"), people, "sender_id", "participant_id")
        if name:
            about = (canonical_name(F.col("subject")) == canonical_name(F.lit(name))) | (canonical_name(F.col("object")) == canonical_name(F.lit(name)))
            self.engine.tables["observations"] = self.table("observations").where(~F.coalesce(about, F.lit(False)))

    def purge(self) -> None:
        for name, schema in SCHEMAS.items():
            self.engine.tables[name] = self.engine.spark.createDataFrame([], schema)
        self.engine.tables.pop("facts", None)

    def artifact_bytes(self, artifact_id: str) -> bytes | None:
        row = self.table("artifacts").where(F.col("artifact_id") == artifact_id).select(F.encode("content", "utf-8").alias("b")).first()
        return None if row is None or row["b"] is None else bytes(row["b"])

    def outline(self, artifact_id: str, depth: int = 2, most: int = 50) -> list[tuple[str, str]]:
        row = self.table("artifacts").where(F.col("artifact_id") == artifact_id).select("content").first()
        return sources.outline_of(row["content"], depth, most) if row and row["content"] else []

    def read(self, artifact_id: str, address: str, most: int = 512) -> str | None:
        """The part of an artifact at an address, cut to ``most`` tokens."""
        row = self.table("artifacts").where(F.col("artifact_id") == artifact_id).select("content").first()
        span = sources.span_of(row["content"], address) if row and row["content"] else None
        return sources.cut_to_tokens(row["content"][slice(*span)], most)[0] if span else None


class Session:
    """One session of an agent: takes turns and tool calls, and is finalised and summarised."""

    def __init__(self, agent: Agent, session_id: str):
        self.agent, self.session_id = agent, session_id
        self._waiting: list[dict] = []

    def _fresh(self, turns: list[dict]) -> list[dict]:
        """Turns that aren't written yet; Conflict for a known identifier with another content."""
        given: dict[str, dict] = {}
        for t in turns:
            row = {"message_id": f"msg-{uuid.uuid4().hex}", "content_type": "text", "at": _now(), "addressed_to": [], "redacted": False} | t | {"session_id": self.session_id}
            other = given.setdefault(row["message_id"], row)
            if other["content"] != row["content"]:
                raise Conflict(row["message_id"])
        known = self.agent.table("messages").where(F.col("message_id").isin(list(given))).select("message_id", "content").collect()
        for r in known:
            if given[r["message_id"]]["content"] != r["content"]:
                raise Conflict(r["message_id"])
        return [row for key, row in given.items() if key not in {r["message_id"] for r in known}]

    def observe(self, sender_id: str, content: str, **turn) -> str | None:
        """Writes one turn; its identifier, or None for one that was there before."""
        fresh = self._fresh([{"sender_id": sender_id, "content": content} | turn])
        if fresh:
            self.agent._add("messages", fresh)
        return fresh[0]["message_id"] if fresh else None

    def commit_unit(self, turns: list[dict]) -> int:
        """Writes all turns or, if one is in conflict, none; how many were new."""
        fresh = self._fresh(turns)
        if fresh:
            self.agent._add("messages", fresh)
        return len(fresh)

    def submit(self, sender_id: str, content: str, **turn) -> int:
        """Queues a turn until ``flush``; how many wait."""
        self._waiting.append({"sender_id": sender_id, "content": content} | turn)
        return len(self._waiting)

    def flush(self) -> int:
        done = self.commit_unit(self._waiting)
        self._waiting = []
        return done

    def ingest(self, content: str, path: str | None = None, chunker: str | None = None, **more) -> str:
        """Writes a source as an artifact with its chunks; equal contents share one content id."""
        key = more.pop("artifact_id", None) or f"art-{uuid.uuid4().hex}"
        self.agent._add("artifacts", [{"artifact_id": key, "session_id": self.session_id, "path": path, "kind": more.pop("kind", "document"), "content": content} | more])
        self.agent.engine.tables["artifacts"] = self.agent.table("artifacts").withColumn("content_id", F.sha2(F.encode("content", "utf-8"), 256))
        one = self.agent.engine.spark.createDataFrame([(key, content)], "artifact_id string, content string")
        self._chunk(one, "artifact_id", "content", "artifact", chunker)
        return key

    def _chunk(self, items: DataFrame, key: str, text: str, kind: str, chunker: str | None = None) -> None:
        made = chunk_table(items, key, text, Limits(), chunker=chunker if chunker in CHUNKERS else None)
        rows = made.select("chunk_id", F.col(key).alias("owner"), F.lit(kind).alias("owner_kind"), "index", "text")
        self.agent.engine.tables["chunks"] = self.agent.table("chunks").unionByName(rows)

    def observe_tool(self, tool_name: str, given: str, output: str, message_id: str | None = None, at: datetime | None = None) -> str:
        """Writes a tool call; an output above OVERFLOW tokens becomes an artifact, and the action keeps its first line."""
        key = f"act-{uuid.uuid4().hex}"
        large = self.agent.engine.spark.range(1).select(token_count(F.lit(output)).alias("n")).first()["n"] > OVERFLOW
        artifact = self.ingest(output, kind="tool_result", message_id=message_id) if large else None
        hashed = self.agent.engine.spark.range(1).select(F.sha2(F.lit(output), 256).alias("h")).first()["h"]
        self.agent._add("actions", [{"action_id": key, "session_id": self.session_id, "message_id": message_id, "tool_name": tool_name, "input": given, "output": output.split("\n", 1)[0][:200] if large else output, "payload_hash": hashed, "artifact_id": artifact, "started_at": at or _now()}])
        return key

    def tool_calls(self, tool_name: str | None = None, limit: int = 20) -> DataFrame:
        """The newest actions of the session, of one tool if named."""
        a = self.agent.table("actions").where(F.col("session_id") == self.session_id)
        return (a.where(F.col("tool_name") == tool_name) if tool_name else a).orderBy(F.col("started_at").desc(), "action_id").limit(limit)

    def transcript(self) -> DataFrame:
        """Turns that aren't redacted, in order."""
        m = self.agent.table("messages").where((F.col("session_id") == self.session_id) & ~F.coalesce("redacted", F.lit(False)))
        return temporal.positions(m, ["session_id"], "at", "message_id").orderBy("position")

    def finalize(self) -> int:
        """Writes the chunks of the session's transcript anew; how many there are. A single session's text is put together in one task."""
        line = F.concat(F.coalesce("sender_id", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")))
        text = self.transcript().groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
        self.agent.engine.tables["chunks"] = self.agent.table("chunks").where(~((F.col("owner_kind") == "session") & (F.col("owner") == self.session_id)))
        self._chunk(text, "session_id", "text", "session", "text")
        return self.agent.table("chunks").where((F.col("owner_kind") == "session") & (F.col("owner") == self.session_id)).count()

    def summarize(self, most: int = 40, chars: int = 2000) -> str:
        """The first claims observed in the session, else the begin of its transcript."""
        o = self.agent.table("observations").where(F.col("session_id") == self.session_id)
        found = derive.first_claims(o, "session_id", "content", "observed_at", "observation_id", most, chars).first()
        if found:
            return found["summary"]
        lines = [r["content"] or "" for r in self.transcript().select("content").limit(most).collect()]
        return self.agent.engine.spark.range(1).select(cap_chars(F.lit(" ".join(lines)), chars).alias("s")).first()["s"]

    def forget_turn(self, message_id: str) -> None:
        """The turn keeps its place, but not its content."""
        gone = self.agent.engine.spark.createDataFrame([(message_id,)], "message_id string")
        m = self.agent.table("messages")
        self.agent.engine.tables["messages"] = changes.redact(m.drop("redacted"), gone, "message_id", ["content"]).join(m.select(F.col("message_id").alias("__m"), F.col("redacted").alias("__r")), F.col("message_id") == F.col("__m")).withColumn("redacted", F.col("redacted") | F.coalesce("__r", F.lit(False))).select(*m.columns)

    def delete_turn(self, message_id: str) -> None:
        gone = self.agent.engine.spark.createDataFrame([(message_id,)], "message_id string")
        self.agent.engine.tables["messages"] = changes.without(self.agent.table("messages"), gone, "message_id")


def scoped_fact_id(subject: str, predicate: str, obj: str | None, scope: str | None = None):
    """The id of a fact as a Column, and the confidence of a number of observations as ``laplace`` gives it."""
    return fact_id(F.lit(subject), F.lit(predicate), F.lit(obj), F.lit(scope)), laplace
