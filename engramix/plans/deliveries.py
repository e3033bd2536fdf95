"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.operators.deliveries import Seen, accept, duplicate_deliveries
from engramix.session import cut
from engramix.sources.tables import read


def p7_found(spark, folder):
    rows = read(spark, folder, "ingest_messages", "delivery_id", "message_id", "msg_timestamp")
    return duplicate_deliveries(rows)


def _order_numbers(spark, folder):
    """Every order as a delivery of its customer's number in the sequence of its priority, by quarters: customers come again."""
    o = read(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return o.select(F.col("o_orderkey").alias("delivery_id"), F.concat(F.lower("o_orderpriority"), F.lit(":"), F.col("o_custkey").cast("string")).alias("message_id"), F.col("o_orderdate").alias("msg_timestamp"), F.quarter("o_orderdate").alias("batch"))


def p7_sequences(spark, folder):
    """The rows to be removed where identifiers are producer sequences: those of contested numbers are compared."""
    return duplicate_deliveries(_order_numbers(spark, folder))


def p7_ranges(spark, folder):
    """Seen ranges of each producer after four batches, each accepted on top of the ranges of those before, and how many rows they accepted."""
    orders = _order_numbers(spark, folder)
    seen, taken = Seen.empty(spark), None
    for batch in range(1, 5):
        accepted, after = accept(orders.where(F.col("batch") == batch), seen)
        counted = accepted.select(F.regexp_replace(F.substring_index("message_id", ":", 1), r"\s", "").alias("producer"))
        taken = counted if taken is None else taken.unionByName(counted)
        seen = Seen(cut(after.ranges), after.keys)
    ranges = seen.ranges.groupBy("producer").agg(F.count("*").alias("ranges"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.sum(F.col("hi") - F.col("lo") + 1).alias("numbers"))
    return ranges.join(taken.groupBy("producer").agg(F.count("*").alias("accepted")), "producer")


QUERIES = {"p7_found": p7_found, "p7_sequences": p7_sequences, "p7_ranges": p7_ranges}

SQL = {
    "p7_found": r"""
        WITH bare AS (
          SELECT delivery_id, msg_timestamp, lower(regexp_replace(message_id, '[\s\x{00A0}\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]+', '', 'g')) AS b
          FROM ingest_messages WHERE message_id IS NOT NULL),
        keyed AS (
          SELECT *, regexp_replace(regexp_replace(b, '^(urn:)?(uuid:)?', ''), '[{}()-]', '', 'g') AS h FROM bare WHERE b <> ''),
        ranked AS (
          SELECT delivery_id, row_number() OVER (
            PARTITION BY CASE WHEN regexp_full_match(h, '[0-9a-f]{32}') THEN h ELSE b END
            ORDER BY msg_timestamp ASC NULLS LAST, delivery_id) AS rn FROM keyed)
        SELECT delivery_id FROM ranked WHERE rn > 1""",
    "p7_sequences": "SELECT o_orderkey AS delivery_id FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n > 1",
    "p7_ranges": """WITH n AS (SELECT DISTINCT regexp_replace(lower(o_orderpriority), '\s', '', 'g') AS producer, o_custkey AS k FROM orders),
        g AS (SELECT producer, k, k - row_number() OVER (PARTITION BY producer ORDER BY k) AS island FROM n)
        SELECT producer, count(DISTINCT island) AS ranges, min(k) AS first, max(k) AS last, count(*) AS numbers, count(*) AS accepted FROM g GROUP BY 1""",
}
