"""Intervals, decay, windows and time phrases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.operators import temporal as T
from engramix.schema import LONG_MAX
from engramix.sources.tables import read


def _order_intervals(spark, folder):
    """Each order of a customer holds until the next one; the last is open."""
    o = read(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    nxt = F.lead(T.millis(F.col("o_orderdate"))).over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select("o_orderkey", "o_custkey", T.millis(F.col("o_orderdate")).alias("lo"), F.coalesce(nxt, F.lit(LONG_MAX)).alias("hi"))


def interval_contains(spark, folder):
    """Orders in force at a point in time."""
    i = _order_intervals(spark, folder)
    at = T.millis(F.to_timestamp_ntz(F.lit("1995-06-17 00:00:00")))
    return i.where(T.contains(F.struct("lo", "hi"), at)).select("o_orderkey", "o_custkey", "lo")


def interval_overlap(spark, folder):
    """For each line, the orders of its customer that hold within 10 days from its shipping."""
    i = _order_intervals(spark, folder)
    line = read(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").join(i.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    shipped = line.select("o_custkey", "l_orderkey", "l_linenumber", T.millis(F.col("l_shipdate")).alias("lo"), (T.millis(F.col("l_shipdate")) + 10 * T.DAY_MS).alias("hi"))
    return T.overlap_join(shipped, i, ["o_custkey"], 180 * T.DAY_MS).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("overlapping"))


def relevance_decay(spark, folder):
    """Importance of events halved every 7 days, those at or below 0.2."""
    e = read(spark, folder, "events", "event_id", "user_id", "value", "ts")
    now = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    score = T.decayed(F.least(F.lit(1.0), F.col("value") / 100), F.col("ts"), now, 7.0)
    return e.select("event_id", "user_id", F.round(score + 1e-9, 6).alias("relevance")).where("relevance <= 0.2")


def rolling_errors(spark, folder):
    """Most errors of a user within 7 days, where there are more than 4."""
    e = read(spark, folder, "events", "event_id", "user_id", "ts", "event_type").where("event_type = 'error'")
    return T.rolling_count(e, ["user_id"], "ts", 7).groupBy("user_id").agg(F.max("recent").alias("most")).where("most > 4")


def activity_sessions(spark, folder):
    """Sessions of users by gaps of two hours."""
    e = read(spark, folder, "events", "event_id", "user_id", "ts")
    return T.sessions_by_gap(e, ["user_id"], "ts", "event_id", 7_200_000).groupBy("user_id", "part").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def tumbling_counts(spark, folder):
    e = read(spark, folder, "events", "ts", "event_type", "value")
    return e.groupBy(F.date_trunc("DAY", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


PHRASES = ("met her yesterday", "due tomorrow", "do it today", "seen last weekend", "two days ago", "in 3 weeks", "on Monday", "next friday it is", "this tuesday", "last week", "last month", "next year", "born in May", "in December", "a post-friday mood", "nothing here", "10 months ago", "last year")


def phrase_points(spark, folder):
    """Every phrase resolved against the time of each message."""
    m = read(spark, folder, "ingest_messages", "delivery_id", "msg_timestamp")
    p = spark.createDataFrame(list(enumerate(PHRASES)), "phrase_no int, phrase string")
    joined = m.withColumn("phrase_no", F.explode(F.sequence(F.lit(0), F.lit(len(PHRASES) - 1)))).join(F.broadcast(p), "phrase_no")
    r = T.resolve_phrase(F.col("phrase"), F.col("msg_timestamp"))
    return joined.select("delivery_id", "phrase_no", r.alias("r")).where("r is not null").select("delivery_id", "phrase_no", F.col("r.point").alias("point"), F.col("r.granularity").alias("granularity"))


def message_phrases(spark, folder):
    """The first time phrase of every message, resolved against its own time: its window, by granularity and day."""
    m = read(spark, folder, "ingest_messages", "content", "msg_timestamp").where("content is not null and msg_timestamp is not null")
    r = m.select(T.resolve_phrase(F.col("content"), F.col("msg_timestamp")).alias("r")).where("r is not null")
    lo, hi = T.phrase_window(F.col("r.point"), F.col("r.granularity"))
    return r.select(F.col("r.granularity").alias("granularity"), lo.cast("timestamp_ntz").alias("since"), hi.cast("timestamp_ntz").alias("until")).groupBy("granularity", "since", "until").agg(F.count("*").alias("messages"))


def interval_states(spark, folder):
    """Orders of customers before, overlapping or after the middle of 1998, and how certain their begins are."""
    i = _order_intervals(spark, folder)
    window = F.struct(T.millis(F.to_timestamp_ntz(F.lit("1998-03-01 00:00:00"))).alias("lo"), T.millis(F.to_timestamp_ntz(F.lit("1998-09-01 00:00:00"))).alias("hi"))
    own = F.struct("lo", "hi")
    state = F.when(T.before(own, window), "before").when(T.overlaps(own, window), "overlaps").otherwise("after")
    counted = i.groupBy("o_custkey").agg(F.count("*").alias("n"))
    opened = T.upgraded(F.struct("lo", "hi", F.lit("day").alias("lo_granularity"), F.lit("approximate").alias("lo_certainty")), F.col("n"), 12)
    return i.join(counted, "o_custkey").groupBy(state.alias("state"), opened["lo_certainty"].alias("certainty")).agg(F.count("*").alias("orders"))


QUERIES = {f.__name__: f for f in (message_phrases, interval_states, interval_contains, interval_overlap, relevance_decay, rolling_errors, activity_sessions, tumbling_counts, phrase_points)}

_MS = "(epoch_us({0}) // 1000)"
_INTERVALS = f"i AS (SELECT o_orderkey, o_custkey, {_MS.format('o_orderdate')} AS lo, coalesce(lead({_MS.format('o_orderdate')}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 9223372036854775807) AS hi FROM orders)"
_AT = _MS.format("TIMESTAMP '1995-06-17'")

SQL = {
    "interval_contains": f"WITH {_INTERVALS} SELECT o_orderkey, o_custkey, lo FROM i WHERE lo <= {_AT} AND {_AT} < hi",
    "interval_overlap": f"""WITH {_INTERVALS}, w AS (SELECT o_custkey, l_orderkey, l_linenumber, {_MS.format('l_shipdate')} AS lo, {_MS.format('l_shipdate')} + 864000000 AS hi FROM lineitem JOIN i ON l_orderkey = o_orderkey)
        SELECT l_orderkey, l_linenumber, count(*) AS overlapping FROM w JOIN i ON w.o_custkey = i.o_custkey AND w.lo < i.hi AND i.lo < w.hi AND i.lo < i.hi GROUP BY 1, 2""",
    "relevance_decay": f"""SELECT event_id, user_id, relevance FROM (SELECT event_id, user_id, round(least(1.0, value / 100) * exp(-ln(2.0) / 7.0 * (({_MS.format("TIMESTAMP '2024-02-01'")} - {_MS.format('ts')}) // 86400000)) + 1e-9, 6) AS relevance FROM events) WHERE relevance <= 0.2""",
    "rolling_errors": f"""SELECT user_id, max(recent) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY {_MS.format('ts')} RANGE BETWEEN 604800000 PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error') GROUP BY 1 HAVING max(recent) > 4""",
    "activity_sessions": f"""WITH g AS (SELECT event_id, user_id, ts, CASE WHEN {_MS.format('ts')} - lag({_MS.format('ts')}) OVER w > 7200000 THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, event_id, (sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1)::BIGINT AS part FROM g) SELECT user_id, part, count(*) AS events, min(event_id) AS first_event FROM s GROUP BY 1, 2""",
    "tumbling_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "phrase_points": """WITH m AS (SELECT delivery_id, msg_timestamp AS t, (isodow(msg_timestamp) - 1)::INT AS wd FROM ingest_messages), r AS (
        SELECT delivery_id, unnest([
          {'n': 0, 'p': t - INTERVAL 1 DAY, 'g': 'day'}, {'n': 1, 'p': t + INTERVAL 1 DAY, 'g': 'day'}, {'n': 2, 'p': t, 'g': 'day'}, {'n': 3, 'p': t - INTERVAL 7 DAY, 'g': 'week'}, {'n': 4, 'p': t - INTERVAL 2 DAY, 'g': 'day'},
          {'n': 5, 'p': t + INTERVAL 21 DAY, 'g': 'week'}, {'n': 6, 'p': t - to_days(CASE WHEN wd = 0 THEN 7 ELSE wd END), 'g': 'day'}, {'n': 7, 'p': t + to_days(CASE WHEN wd = 4 THEN 7 ELSE (4 - wd + 7) % 7 END), 'g': 'day'}, {'n': 8, 'p': t + to_days(1 - wd), 'g': 'day'},
          {'n': 9, 'p': t - INTERVAL 7 DAY, 'g': 'week'}, {'n': 10, 'p': t - INTERVAL 30 DAY, 'g': 'month'}, {'n': 11, 'p': t + INTERVAL 1 YEAR, 'g': 'year'},
          {'n': 12, 'p': make_date(year(t) - CASE WHEN month(t) > 5 THEN 0 ELSE 1 END, 5, 1)::TIMESTAMP + (t - date_trunc('day', t)), 'g': 'month'}, {'n': 13, 'p': make_date(year(t) - CASE WHEN month(t) > 12 THEN 0 ELSE 1 END, 12, 1)::TIMESTAMP + (t - date_trunc('day', t)), 'g': 'month'},
          {'n': 16, 'p': t - INTERVAL 300 DAY, 'g': 'month'}, {'n': 17, 'p': t - INTERVAL 1 YEAR, 'g': 'year'}]) AS x FROM m)
        SELECT delivery_id, x.n::INT AS phrase_no, x.p::TIMESTAMP AS point, x.g AS granularity FROM r""",
    "interval_states": f"""WITH {_INTERVALS}, c AS (SELECT o_custkey, count(*) AS n FROM i GROUP BY 1) SELECT CASE WHEN hi <= {_MS.format("TIMESTAMP '1998-03-01'")} THEN 'before' WHEN lo < {_MS.format("TIMESTAMP '1998-09-01'")} AND {_MS.format("TIMESTAMP '1998-03-01'")} < hi THEN 'overlaps' ELSE 'after' END AS state,
        CASE WHEN n >= 12 THEN 'definite' ELSE 'approximate' END AS certainty, count(*) AS orders FROM i JOIN c USING (o_custkey) GROUP BY 1, 2""",
}
