"""Conversations rebuilt from message rows.

Rows are grouped by channel (session id), put in order, optionally split at
inactivity gaps, given the role of their speaker, and dropped as a whole where the
conversation is broken, empty or lacks replies. All steps are joins, aggregates
combined before the shuffle, and windows over (session, day), so that a session that
holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.functions.ids import bare_id, canonical_message_id
from engramix.session import cut, discard

#: Any character that is neither white space nor invisible (zero-width, soft hyphen).
VISIBLE = r"[^\s\p{Z}\x{85}\x{AD}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]"


def is_blank(content: Column) -> Column:
    return ~F.coalesce(content.rlike(VISIBLE), F.lit(False))


def roles(participants: DataFrame) -> DataFrame:
    """(participant_id, role): kind without blanks and in lower case; of repeated ids the smallest kind."""
    role = F.lower(F.trim("kind"))
    return participants.where("participant_id is not null").groupBy("participant_id").agg(F.coalesce(F.min(role), F.lit("")).alias("role"))


def one_per_message(messages: DataFrame, participants: DataFrame) -> DataFrame:
    """One narrow row per message: session_id, ts, delivery, key, reply, blank, role, asks.

    Of the rows with the same identifier the smallest (timestamp, delivery id) stays; rows
    without an identifier stand for themselves. Texts aren't shuffled, only whether they are blank.
    """
    known = roles(participants)
    agents = known.where("role = 'agent'").agg(F.coalesce(F.collect_set("participant_id"), F.array().cast("array<string>"))).scalar()
    to = F.filter(F.coalesce("addressed_to", F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    narrow = messages.select(
        canonical_message_id(F.col("message_id")).alias("key"),
        F.struct(
            F.col("msg_timestamp").isNull().alias("late"),
            F.col("msg_timestamp").alias("ts"),
            F.col("delivery_id").alias("delivery"),
            F.nullif(F.trim("session_id"), F.lit("")).alias("session_id"),
            F.col("sender_id").alias("sender_id"),
            canonical_message_id(F.try_element_at("metadata", F.lit("reply_to"))).alias("reply"),
            is_blank(F.col("content")).alias("blank"),
            ((F.size(to) == 0) | F.arrays_overlap(to, agents)).alias("wants"),
        ).alias("row"),
    )
    own = F.when(F.col("key").isNull(), F.col("row.delivery"))
    first = narrow.groupBy("key", own.alias("own")).agg(F.min("row").alias("row")).select("key", "row.*").where("session_id is not null")
    joined = first.join(known, first["sender_id"] == known["participant_id"], "left")
    return joined.select("session_id", "late", "ts", "delivery", "key", "reply", "blank", "role", (F.coalesce(F.col("role") == "human", F.lit(False)) & ~F.col("blank") & F.col("wants")).alias("asks"))


def _tie_depths(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """(delivery, depth): how many answers a message is behind, among messages of its own time.

    Only answers with the time of what they answer take part. Each round doubles how far they look back, so a chain of n
    answers takes log2(n) rounds. Circles of answers, and what answers into them, have no depth.
    """
    state = cut(replies.where("same_time").select("delivery", F.col("target").alias("back"), F.lit(1).alias("depth"), F.lit(True).alias("open")))
    for _ in range(state.count().bit_length() + 1):
        onward = state.select(F.col("delivery").alias("d"), F.col("back").alias("b"), F.col("depth").alias("n"))
        fresh = cut(state.join(onward, state["back"] == onward["d"], "left").select("delivery", F.coalesce("b", "back").alias("back"), (F.col("depth") + F.coalesce("n", F.lit(0))).alias("depth"), F.col("d").isNotNull().alias("open")))
        discard(state)
        state = fresh
        if state.where("open").isEmpty():
            break
    return state.where("not open").select("delivery", "depth")


def rebuild(messages: DataFrame, participants: DataFrame) -> DataFrame:
    """(session_id, turn_no, message_id, role, ts): the turns of every sound session, in order.

    Turns are the messages that aren't blank. A session is dropped as a whole when it has no
    turn; when any of its messages has a sender that is null or unknown, or answers a message
    that isn't in the session; when humans or agents are missing among its turns; or when
    nothing of an agent follows the last human turn that asks for a reply (addressed to nobody
    or to an agent). Order: timestamp (null last), at equal times an answer after what it
    answers, then delivery id. Nulls in any column, blank texts, repeated rows and empty tables
    are covered by these rules; columns other than those named are not read.
    """
    rows = cut(one_per_message(messages, participants))
    asked = rows.where("reply is not null").select("session_id", "late", "ts", "delivery", "reply")
    there = rows.where("key is not null").select(F.col("session_id").alias("s"), F.col("key"), F.col("late").alias("l"), F.col("ts").alias("t"), F.col("delivery").alias("target"))
    replies = cut(
        asked.join(there, (asked["session_id"] == there["s"]) & (asked["reply"] == there["key"]), "left").select(
            "session_id", "delivery", "target", (F.col("target").isNotNull() & (F.col("target") != F.col("delivery")) & F.col("ts").eqNullSafe(F.col("t"))).alias("same_time")
        )
    )
    depths = _tie_depths(rows, replies)
    rows = rows.join(depths, "delivery", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    broken = replies.groupBy("session_id").agg(F.max(F.col("target").isNull()).alias("broken"))
    order = F.struct("late", "ts", "depth", "delivery")
    turn = ~F.col("blank")
    sound = (
        rows.groupBy("session_id")
        .agg(
            F.max(F.col("role").isNull()).alias("stranger"),
            F.count_if(turn & (F.col("role") == "human")).alias("humans"),
            F.count_if(turn & (F.col("role") == "agent")).alias("agents"),
            F.max(F.when(F.col("asks"), order)).alias("asked"),
            F.max(F.when(turn & (F.col("role") == "agent"), order)).alias("answered"),
        )
        .where("not stranger and humans > 0 and agents > 0 and (asked is null or answered > asked)")
        .join(broken.where("broken"), "session_id", "left_anti")
        .select("session_id")
    )
    turns = rows.where(turn).join(sound, "session_id", "left_semi").withColumn("day", F.to_date("ts"))
    days = turns.groupBy("session_id", "late", "day").agg(F.count("*").alias("n"))
    before = W.partitionBy("session_id").orderBy("late", "day").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("session_id").alias("s"), F.col("late").alias("l"), F.col("day").alias("d"), "before")
    within = F.row_number().over(W.partitionBy("session_id", "late", "day").orderBy("ts", "depth", "delivery"))
    placed = turns.withColumn("within", within).join(days, (F.col("session_id") == F.col("s")) & (F.col("late") == F.col("l")) & F.col("day").eqNullSafe(F.col("d")))
    return placed.select("session_id", (F.col("before") + F.col("within")).cast("int").alias("turn_no"), F.col("key").alias("message_id"), "role", "ts")


def _with_gaps(rows: DataFrame, channel: list[str], ts: str, tie: str) -> DataFrame:
    """``rows`` with ``__gap``, the microseconds since the row before of the channel, null for the first and for rows without a time.

    Rows are sorted within days; the first of a day gets its gap from the last time of the days before, of which there is one row each.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    dated = rows.withColumn("__late", F.col(ts).isNull()).withColumn("__day", F.to_date(ts)).withColumn("__at", at)
    before = W.partitionBy(*channel).orderBy("__late", "__day").rowsBetween(W.unboundedPreceding, -1)
    days = dated.groupBy(*channel, "__late", "__day").agg(F.max("__at").alias("__last")).withColumn("__prior", F.max("__last").over(before)).drop("__last")
    renamed = days.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(channel)], F.col("__late").alias("__l"), F.col("__day").alias("__d"), "__prior")
    on = (F.col("__late") == F.col("__l")) & F.col("__day").eqNullSafe(F.col("__d"))
    for i, c in enumerate(channel):
        on = on & F.col(c).eqNullSafe(F.col(f"__c{i}"))
    within = W.partitionBy(*channel, "__late", "__day").orderBy("__at", tie)
    return dated.withColumn("__back", F.lag("__at").over(within)).join(renamed, on).withColumn("__gap", F.col("__at") - F.coalesce("__back", "__prior"))


def calibrated_gap(rows: DataFrame, channel: list[str], ts: str = "ts", share: float = 0.99, factor: float = 2.0, tie: str = "delivery") -> float:
    """Seconds of inactivity that end a conversation: ``factor`` times the ``share`` quantile of the gaps within channels.

    0.0 where no channel has two rows.
    """
    gaps = _with_gaps(rows.where(F.col(ts).isNotNull()), channel, ts, tie).where("__gap is not null")
    found = gaps.agg(F.percentile_approx(F.col("__gap") / 1e6, share, 10_000)).first()[0]
    return factor * (found or 0.0)


def split_at_gaps(rows: DataFrame, channel: list[str], gap_seconds: float, ts: str = "ts", tie: str = "delivery") -> DataFrame:
    """``rows`` with ``part``: 1 for the first conversation of a channel, one more after each gap above ``gap_seconds``.

    Rows without a timestamp belong to the last part. Parts are numbered within days, with those of the days before added.
    """
    marked = _with_gaps(rows, channel, ts, tie).withColumn("__opens", F.when(F.col("__gap") > gap_seconds * 1e6, 1).otherwise(0))
    before = W.partitionBy(*channel).orderBy("__late", "__day").rowsBetween(W.unboundedPreceding, -1)
    days = marked.groupBy(*channel, "__late", "__day").agg(F.sum("__opens").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    renamed = days.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(channel)], F.col("__late").alias("__kl"), F.col("__day").alias("__kd"), "__before")
    on = (F.col("__late") == F.col("__kl")) & F.col("__day").eqNullSafe(F.col("__kd"))
    for i, c in enumerate(channel):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    upto = F.sum("__opens").over(W.partitionBy(*channel, "__late", "__day").orderBy("__at", tie))
    return marked.withColumn("__upto", upto).join(renamed, on).select(*rows.columns, (F.col("__before") + F.col("__upto") + 1).alias("part"))
