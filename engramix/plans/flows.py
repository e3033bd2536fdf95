"""Whole flows: recall over questions, and the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.operators import recall as R
from engramix.operators.predicates import Viewer
from engramix.sources.tables import read


def recall_cascade(spark, folder):
    """Every view that asks something and whose id is divisible by 20, answered from all views and facts, as seen by one participant."""
    from engramix.plans.recalls import facts, questions, views

    items = views(spark, folder).drop("session_id").unionByName(facts(spark, folder), allowMissingColumns=True)
    found = R.recall(items, questions(spark, folder), R.Settings(limit=10, budget=400), viewer=Viewer("user-005", ["t1", "t3"]))
    return found.select("query_id", "nid", "label", "tokens", F.round("score", 6).alias("score"))


def session_windows(spark, folder):
    """Sessions of users by event time, closing after an hour without events."""
    e = read(spark, folder, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.session_window("ts", "1 hour"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.unix_millis("session_window.start").alias("started_ms"), "events")


QUERIES = {f.__name__: f for f in (recall_cascade, session_windows)}

SQL = {
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS started_ms, count(*) AS events FROM s GROUP BY user_id, part""",
}
