"""Writing and deleting as pure functions over tables: what a batch adds, and what a removal takes along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramix.functions.text import visibility


def message_edges(messages: DataFrame, known: DataFrame | None = None, key: str = "message", at: str = "at") -> DataFrame:
    """(etype, src, dst): the edges that messages bring along.

    ``messages`` has key, sender, session, to (array) and a time. SENT_BY, IN_SESSION and ADDRESSED_TO by what a row names; NEXT to the
    message before it in the session. Null ends give no edge, repeated ones one. ``known`` (key) are messages written before, which bring none again.
    """
    from engramix.operators.temporal import chain

    fresh = messages if known is None else messages.join(known.select(key).distinct(), key, "left_anti")
    arms = [
        fresh.select(F.lit("SENT_BY").alias("etype"), F.col(key).cast("string").alias("src"), F.col("sender").alias("dst")),
        fresh.select(F.lit("IN_SESSION").alias("etype"), F.col(key).cast("string").alias("src"), F.col("session").alias("dst")),
        fresh.select(F.lit("ADDRESSED_TO").alias("etype"), F.col(key).cast("string").alias("src"), F.explode("to").alias("dst")),
        chain(fresh.where("session is not null"), ["session"], at, key).select(F.lit("NEXT").alias("etype"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")),
        fresh.where("session is not null").select(F.lit("PARTICIPATED_IN").alias("etype"), F.col("sender").alias("src"), F.col("session").alias("dst")),
    ]
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm)
    return out.where("src is not null and dst is not null").distinct()


def ingest_outcome(rows: DataFrame, key: str, payload: Column, order: list[str]) -> DataFrame:
    """(key, outcome, copies): 'new' for a key that came once, 'replay' if all copies carry one payload, 'conflict' if they don't.

    Payloads are compared by their hash, null ones as equal; keys are combined before the shuffle.
    """
    hashed = rows.where(F.col(key).isNotNull()).select(key, F.coalesce(F.sha2(payload, 256), F.lit("")).alias("h"), F.struct(*order).alias("o"))
    found = hashed.groupBy(key).agg(F.count("*").alias("copies"), F.min("h").alias("low"), F.max("h").alias("high"), F.min("o").alias("first"))
    outcome = F.when(F.col("copies") == 1, "new").when(F.col("low") == F.col("high"), "replay").otherwise("conflict")
    return found.select(key, outcome.alias("outcome"), "copies", F.col("first").alias("kept"))


def accepted_units(rows: DataFrame, unit: str, good: Column) -> DataFrame:
    """Rows of those units (such as batches) all of whose rows are good: a unit is taken whole or not at all."""
    bad = rows.where(~F.coalesce(good, F.lit(False))).select(unit).distinct()
    return rows.where(F.col(unit).isNotNull()).join(bad, unit, "left_anti")


def content_table(items: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """((content_id, content, size, uses), (key, content_id)): contents stored once, and which item has which; null contents aren't stored."""
    hashed = items.where(F.col(content).isNotNull()).select(F.col(key), F.sha2(F.encode(content, "utf-8"), 256).alias("content_id"), F.col(content).alias("content"))
    stored = hashed.groupBy("content_id").agg(F.first("content").alias("content"), F.count("*").alias("uses")).withColumn("size", F.octet_length("content"))
    return stored, hashed.select(key, "content_id")


def source_spans(rows: DataFrame, source: str, at: str) -> DataFrame:
    """(source, first_seen, last_seen, rows) of every source."""
    return rows.where(F.col(source).isNotNull()).groupBy(source).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("rows"))


def retire(sources: DataFrame, gone: DataFrame, at: Column, source: str = "source_id") -> DataFrame:
    """``sources`` with ``retired_at``: set for those of ``gone``, as it was for others; ``at`` null restores them."""
    marked = sources.join(gone.select(F.col(source).alias("__g")).distinct(), F.col(source) == F.col("__g"), "left")
    old = F.col("retired_at") if "retired_at" in sources.columns else F.lit(None).cast("timestamp_ntz")
    return marked.withColumn("retired_at", F.when(F.col("__g").isNotNull(), at).otherwise(old)).drop("__g")


def with_visibility(rows: DataFrame, changes: DataFrame, key: str, final: Column | None = None) -> DataFrame:
    """``rows`` with the visibility of ``changes`` (key, visibility) laid over, blank and 'public' as null; rows where ``final`` holds, such as redacted ones, stay."""
    new = changes.select(F.col(key).alias("__k"), visibility(F.col("visibility")).alias("__v"), F.lit(True).alias("__set"))
    joined = rows.join(new, F.col(key) == F.col("__k"), "left")
    may = F.coalesce(F.col("__set"), F.lit(False)) & ~F.coalesce(final, F.lit(False)) if final is not None else F.coalesce(F.col("__set"), F.lit(False))
    return joined.withColumn("visibility", F.when(may, F.col("__v")).otherwise(F.col("visibility"))).drop("__k", "__v", "__set")


def owned_visibility(chunks: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """``chunks`` with the visibility of their owner; those without one keep theirs."""
    of = owners.select(F.col(owner).alias("__o"), visibility(F.col("visibility")).alias("__v"))
    return chunks.join(of, F.col(owner) == F.col("__o"), "left").withColumn("visibility", F.when(F.col("__o").isNotNull(), F.col("__v")).otherwise(F.col("visibility"))).drop("__o", "__v")


def without(rows: DataFrame, gone: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """``rows`` whose ``key`` isn't among those of ``gone`` (column ``by``); null keys stay."""
    ids = gone.select(F.col(by or key).alias("__gone")).where("__gone is not null").distinct()
    return rows.join(ids, F.col(key) == F.col("__gone"), "left_anti")


def delete_sessions(sessions: DataFrame, messages: DataFrame, artifacts: DataFrame, mentions: DataFrame, supports: DataFrame | None = None) -> dict[str, DataFrame]:
    """What is left when ``sessions`` (session_id) go: messages, artifacts, mentions, and the facts that lose all support.

    ``messages`` has message, session_id; ``artifacts`` artifact_id, session_id, message and content_id; ``mentions`` message; ``supports`` fact_id, message.
    Artifacts go with the session that holds them or the message that triggered them; their contents stay while another artifact has them.
    """
    doomed = messages.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select("message")
    kept_messages = without(messages, sessions, "session_id")
    kept_artifacts = without(without(artifacts, sessions, "session_id"), doomed, "message")
    out = {"messages": kept_messages, "artifacts": kept_artifacts, "mentions": without(mentions, doomed, "message"), "contents": kept_artifacts.where("content_id is not null").select("content_id").distinct()}
    if supports is not None:
        marked = supports.join(doomed.distinct().withColumn("__d", F.lit(True)), "message", "left")
        out["facts"] = marked.groupBy("fact_id").agg(F.count_if(F.col("__d").isNull()).alias("left")).withColumn("invalidated", F.col("left") == 0)
    return out


def forget_participants(people: DataFrame, messages: DataFrame, facts: DataFrame, mentions: DataFrame) -> dict[str, DataFrame]:
    """What is left when ``people`` (participant_id, name) are forgotten: nothing they sent, and no fact about them.

    ``messages`` has message, sender; ``facts`` a subject and object as canonical names; ``mentions`` message and name. They are no longer addressed.
    """
    ids = people.select("participant_id").where("participant_id is not null").distinct()
    names = people.select(F.col("name")).where("name is not null").distinct()
    sent = messages.join(ids, messages["sender"] == ids["participant_id"], "left_semi").select("message")
    kept = without(messages, people, "sender", "participant_id")
    about = without(without(facts, names, "subject", "name"), names, "object", "name")
    return {"messages": kept, "facts": about, "mentions": without(without(mentions, sent, "message"), names, "name")}


def redact(rows: DataFrame, gone: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``redacted``: those of ``gone`` keep their place, but their ``columns`` become null."""
    marked = rows.join(gone.select(F.col(key).alias("__g")).distinct(), F.col(key) == F.col("__g"), "left")
    hit = F.col("__g").isNotNull()
    return marked.select(*[F.when(~hit, F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns], hit.alias("redacted"))


def stale_facts(facts: DataFrame, current: DataFrame) -> DataFrame:
    """Open facts of a (subject, predicate, scope) of ``current`` whose object is another one; ``facts`` has fact_id, s, p, scope, o and open."""
    now = current.select(F.col("s").alias("cs"), F.col("p").alias("cp"), F.col("scope").alias("cscope"), F.col("o").alias("co"))
    on = (F.col("s") == F.col("cs")) & (F.col("p") == F.col("cp")) & F.col("scope").eqNullSafe(F.col("cscope"))
    return facts.where("open").join(now, on).where(~F.col("o").eqNullSafe(F.col("co"))).select("fact_id", "s", "p", F.col("o").alias("old"), F.col("co").alias("new"))


def invalidated(facts: DataFrame, stale: DataFrame, at_ms: Column) -> tuple[DataFrame, DataFrame]:
    """(``facts`` with the intervals of stale ones closed, (etype, src, dst) from the new fact to the old): ``stale`` has fact_id and by."""
    marks = stale.groupBy("fact_id").agg(F.min("by").alias("__by")).withColumnRenamed("fact_id", "__f")
    marked = facts.join(marks, F.col("fact_id") == F.col("__f"), "left")
    closed = marked.withColumn("hi", F.when(F.col("__f").isNotNull(), F.greatest(F.col("lo"), F.least("hi", at_ms))).otherwise(F.col("hi"))).drop("__f", "__by")
    return closed, stale.where("by is not null").select(F.lit("INVALIDATES").alias("etype"), F.col("by").alias("src"), F.col("fact_id").alias("dst")).distinct()


def cycle_audit(cycle: str, processed: DataFrame, created: DataFrame, reinforced: DataFrame, closed: DataFrame) -> DataFrame:
    """(etype, src, dst): a consolidation cycle with what it processed, created, reinforced and invalidated; each table has one column."""
    arms = [df.select(F.lit(etype).alias("etype"), F.lit(cycle).alias("src"), F.col(df.columns[0]).cast("string").alias("dst")) for etype, df in (("PROCESSED", processed), ("CREATED", created), ("REINFORCED", reinforced), ("INVALIDATED", closed))]
    return arms[0].unionByName(arms[1]).unionByName(arms[2]).unionByName(arms[3]).distinct()


def mean_vectors(chunks: DataFrame, owner: str, vector: str, dimension: int, missing: DataFrame) -> DataFrame:
    """(owner, mean): the mean of the chunks' vectors of every owner of ``missing`` that has any."""
    from engramix.operators.derive import vector_mean

    return vector_mean(chunks.join(missing.select(owner).distinct(), owner, "left_semi"), [owner], vector, dimension)
