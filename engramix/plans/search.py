"""Retrieval, fusion and diversification over documents, embeddings and scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.functions.text import token_count
from engramix.operators import fusion, retrieval
from engramix.sources.tables import read

QUESTION = "the budget sheet and the room booking"


def _question(spark, text=QUESTION):
    return spark.range(1).select(F.lit(1).cast("long").alias("query_id"), F.lit(text).alias("query"))


def bm25_documents(spark, folder):
    scored = retrieval.bm25(read(spark, folder, "documents", "doc_id", "text"), _question(spark), "doc_id", "text")
    return retrieval.top_k(scored, 50, ["query"], "doc").select(F.col("doc").alias("doc_id"), F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


def bm25_passages(spark, folder):
    """All eval questions against all passages: a table of queries."""
    items = read(spark, folder, "eval_items", "item_id", "question", "passage")
    scored = retrieval.bm25(items, items.select(F.col("item_id").alias("query_id"), F.col("question").alias("query")), "item_id", "passage")
    return retrieval.top_k(scored, 5, ["query"], "doc").select("query", "doc", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


def vector_nearest(spark, folder):
    """Every vector whose id is divisible by 20 against all vectors."""
    e = read(spark, folder, "embeddings", "vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.exact_nearest(e, q, 5, "vec_id", "embedding").select("query", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


def hybrid_search(spark, folder):
    """BM25 over documents and cosine over vectors of the same ids, fused by reciprocal ranks."""
    text = retrieval.bm25(read(spark, folder, "documents", "doc_id", "text"), _question(spark), "doc_id", "text").select(F.col("doc").alias("id"), "score")
    e = read(spark, folder, "embeddings", "vec_id", "embedding")
    near = retrieval.exact_nearest(e, e.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 100, "vec_id", "embedding").select("id", "score")
    lists = retrieval.top_k(text.withColumn("list", F.lit("text")), 100, ["list"], "id").select("list", "id", "score").unionByName(near.select(F.lit("vector").alias("list"), "id", F.round("score", 6).alias("score")))
    fused = fusion.rrf(lists.withColumn("query", F.lit(1)), ["query"], "list", "id")
    return fused.select("id", F.round("fused", 9).alias("fused"))


def _hits(spark, folder):
    s = read(spark, folder, "scored_rows", "query_id", "channel", "node_id", "label", "score").where("score is not null and not isnan(score)")
    return s.withColumn("score", F.when(F.col("channel") == "l2_distance", -F.col("score")).otherwise(F.col("score"))).groupBy("query_id", "channel", "node_id").agg(F.max("score").alias("score"), F.max(F.lower("label")).alias("label"))


def rrf_channels(spark, folder):
    """Reciprocal rank fusion of all channels, ranks from 0, times the weight of the tier."""
    hits = _hits(spark, folder)
    fused = fusion.rrf(hits, ["query_id"], "channel", "node_id", base=0)
    labels = hits.groupBy("query_id", "node_id").agg(F.max("label").alias("label"))
    return fused.join(labels, ["query_id", "node_id"]).select("query_id", "node_id", F.round(F.col("fused") * fusion.tier_weight(F.col("label")), 9).alias("score"))


def rrf_weighted(spark, folder):
    weight = F.when(F.col("channel") == "fulltext", 2.0).otherwise(1.0)
    return fusion.rrf(_hits(spark, folder).withColumn("w", weight), ["query_id"], "channel", "node_id", base=1, weight="w").select("query_id", "node_id", F.round("fused", 9).alias("fused"))


def max_merge(spark, folder):
    """Rows of all channels merged by node at their best normalised score."""
    normal = fusion.minmax(_hits(spark, folder), ["query_id", "channel"])
    return normal.groupBy("query_id", "node_id").agg(F.round(F.max("normal"), 6).alias("score"), F.count("*").alias("channels"))


def late_interaction_band(spark, folder):
    hits = _hits(spark, folder).where("channel in ('dense', 'maxsim')")
    wide = hits.groupBy("query_id", "node_id").agg(F.max(F.when(F.col("channel") == "dense", F.col("score"))).alias("score"), F.max(F.when(F.col("channel") == "maxsim", F.col("score"))).alias("late")).where("score is not null")
    return fusion.maxsim_band(wide, ["query_id"], "late").select("query_id", "node_id", F.round("banded", 6).alias("banded"))


def sparse_search(spark, folder):
    """Dot product of term weights (log of frequency) of documents with a weighted query."""
    terms = retrieval.postings(read(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").select("doc", "term", F.ln(F.col("tf") + 1.0).alias("weight"))
    q = spark.createDataFrame([(1, "budget", 2.0), (1, "planner", 1.5), (1, "chor", 1.0)], "query long, term string, weight double")
    return retrieval.top_k(retrieval.sparse_dot(terms, q), 100, ["query"], "doc").select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def coverage_score(spark, folder):
    r = read(spark, folder, "recall_items", "query_id", "kind", "score").where("score is not null and not isnan(score)")
    return fusion.coverage(r.withColumn("tier", fusion.tier_of(F.col("kind"))), "query_id", "tier", facets=4).select("query_id", F.round("coverage", 6).alias("coverage"))


def budget_packed(spark, folder):
    """The best items of each query that fit a token budget; oversized ones are skipped."""
    r = read(spark, folder, "recall_items", "query_id", "item_no", "score", "token_count").where("score is not null and not isnan(score) and token_count is not null")
    return fusion.pack(r, "query_id", "item_no", "token_count", limit=20, budget=1200)


def mmr_diversified(spark, folder):
    r = read(spark, folder, "recall_items", "query_id", "item_no", "content", "score").where("score is not null and not isnan(score)")
    return fusion.mmr(r, "query_id", "item_no", "content", limit=10)


def reranked_sigmoid(spark, folder):
    """Logits of the reranker as probabilities, the ten best of each query."""
    from engramix.functions.text import sigmoid

    s = _hits(spark, folder).where("channel = 'reranker'").withColumn("p", sigmoid(F.col("score")))
    return retrieval.top_k(s, 10, ["query_id"], "node_id", "p").select("query_id", "node_id", F.round("p", 6).alias("p"))


def context_lines(spark, folder):
    """Numbered context of the five best items of each query, in one text."""
    r = read(spark, folder, "recall_items", "query_id", "item_no", "kind", "content", "score").where("score is not null and not isnan(score)")
    best = retrieval.top_k(r, 5, ["query_id"], "item_no")
    line = F.concat(F.col("rank").cast("string"), F.lit(". ["), F.coalesce("kind", F.lit("")), F.lit("] "), F.coalesce("content", F.lit("")))
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"), F.sum(token_count(F.coalesce("content", F.lit("")))).alias("tokens"))


QUERIES = {f.__name__: f for f in (bm25_documents, bm25_passages, vector_nearest, hybrid_search, rrf_channels, rrf_weighted, max_merge, late_interaction_band, sparse_search, coverage_score, budget_packed, mmr_diversified, reranked_sigmoid, context_lines)}

_TERMS = "unnest(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> ''))"
_BM25 = f"""t AS (SELECT doc_id AS doc, {_TERMS.format('text')} AS term FROM documents), dl AS (SELECT doc, count(*) AS dl FROM t GROUP BY 1), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    q AS (SELECT DISTINCT {_TERMS.format(f"'{QUESTION}'")} AS term), h AS (SELECT doc, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
    b AS (SELECT doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN df USING (term) JOIN dl USING (doc), s GROUP BY 1)"""
_HITS = """h AS (SELECT query_id, channel, node_id, max(CASE WHEN channel = 'l2_distance' THEN -score ELSE score END) AS score, max(lower(label)) AS label FROM scored_rows WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3)"""
_R = "FROM recall_items WHERE score IS NOT NULL AND NOT isnan(score)"
_TIER = "CASE {0} WHEN 'fact' THEN 1.0 WHEN 'topic' THEN 1.0 WHEN 'procedure' THEN 0.9 WHEN 'episode' THEN 0.7 WHEN 'message' THEN 0.4 WHEN 'action' THEN 0.4 ELSE 0.5 END"
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"

SQL = {
    "bm25_documents": f"WITH {_BM25} SELECT doc AS doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc)::INT AS rank, round(score, 6) AS score FROM b QUALIFY rank <= 50",
    "bm25_passages": f"""WITH t AS (SELECT item_id AS doc, {_TERMS.format('passage')} AS term FROM eval_items), dl AS (SELECT doc, count(*) AS dl FROM t GROUP BY 1), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
        q AS (SELECT DISTINCT item_id AS query, {_TERMS.format('question')} AS term FROM eval_items), h AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
        b AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc), s GROUP BY 1, 2)
        SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc)::INT AS rank, round(score, 6) AS score FROM b QUALIFY rank <= 5""",
    "vector_nearest": f"""SELECT query, vec_id, round(score, 5) AS score FROM (SELECT a.vec_id AS query, b.vec_id, {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) <= 5""",
    "hybrid_search": f"""WITH {_BM25}, v AS (SELECT b.vec_id AS id, {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 1),
        v100 AS (SELECT id, round(score, 6) AS score FROM v QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, id) <= 100),
        r AS (SELECT doc AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS k FROM b QUALIFY k <= 100 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM v100)
        SELECT id, round(sum(1.0 / (60 + k)), 9) AS fused FROM r GROUP BY 1""",
    "rrf_channels": f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY round(score, 9) DESC, node_id) - 1 AS k FROM h)
        SELECT query_id, node_id, round(sum(1.0 / (60 + k)) * {_TIER.format('max(label)')}, 9) AS score FROM r GROUP BY 1, 2""",
    "rrf_weighted": f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY round(score, 9) DESC, node_id) AS k FROM h)
        SELECT query_id, node_id, round(sum(CASE WHEN channel = 'fulltext' THEN 2.0 ELSE 1.0 END / (60 + k)), 9) AS fused FROM r GROUP BY 1, 2""",
    "max_merge": f"""WITH {_HITS}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM h WINDOW w AS (PARTITION BY query_id, channel))
        SELECT query_id, node_id, round(max(CASE WHEN hi - lo > 1e-12 THEN (score - lo) / (hi - lo) ELSE score END), 6) AS score, count(*) AS channels FROM m GROUP BY 1, 2""",
    "late_interaction_band": f"""WITH {_HITS}, w AS (SELECT query_id, node_id, max(score) FILTER (channel = 'dense') AS score, max(score) FILTER (channel = 'maxsim') AS late FROM h GROUP BY 1, 2),
        x AS (SELECT *, max(late) OVER p AS top, max(score) OVER p AS best FROM w WHERE score IS NOT NULL WINDOW p AS (PARTITION BY query_id))
        SELECT query_id, node_id, round(coalesce(CASE WHEN late IS NOT NULL AND top > 0 THEN 0.5 + 0.5 * late / top ELSE 0.4995 * score / nullif(best, 0) END, 0), 6) AS banded FROM x""",
    "sparse_search": f"""WITH t AS (SELECT doc_id AS doc, {_TERMS.format('text')} AS term FROM documents), w AS (SELECT doc, term, ln(count(*) + 1.0) AS weight FROM t WHERE term IN ('budget', 'planner', 'chor') GROUP BY 1, 2),
        s AS (SELECT doc AS doc_id, sum(weight * CASE term WHEN 'budget' THEN 2.0 WHEN 'planner' THEN 1.5 ELSE 1.0 END) AS score FROM w GROUP BY 1)
        SELECT doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) <= 100""",
    "coverage_score": f"""SELECT query_id, round(0.4 * least(count(*) / 4.0, 1) + 0.3 * least(greatest(avg(score), 0), 1) + 0.3 * count(DISTINCT CASE kind WHEN 'fact' THEN 1 WHEN 'topic' THEN 1 WHEN 'procedure' THEN 2 WHEN 'episode' THEN 3 WHEN 'message' THEN 5 WHEN 'action' THEN 5 ELSE 4 END) / 5, 6) AS coverage {_R} GROUP BY 1""",
    "budget_packed": f"""WITH RECURSIVE r AS (SELECT query_id, item_no, token_count AS t, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_no) AS k {_R} AND token_count IS NOT NULL),
        f AS (SELECT query_id, item_no, t, k, t <= 1200 AS kept, CASE WHEN t <= 1200 THEN 1200 - t ELSE 1200 END AS room FROM r WHERE k = 1
          UNION ALL SELECT r.query_id, r.item_no, r.t, r.k, r.t <= f.room, CASE WHEN r.t <= f.room THEN f.room - r.t ELSE f.room END FROM f JOIN r ON r.query_id = f.query_id AND r.k = f.k + 1 WHERE r.k <= 20)
        SELECT query_id, item_no, t AS tokens FROM f WHERE kept""",
    "reranked_sigmoid": f"WITH {_HITS} SELECT query_id, node_id, round(1 / (1 + exp(-score)), 6) AS p FROM h WHERE channel = 'reranker' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(-score)), 9) DESC, node_id) <= 10",
    "context_lines": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_no) AS k {_R} QUALIFY k <= 5)
        SELECT query_id, string_agg(k || '. [' || coalesce(kind, '') || '] ' || coalesce(content, ''), chr(10) ORDER BY k) AS context,
          sum(ceil(len(list_filter(regexp_split_to_array(trim(coalesce(content, '')), '\\s+'), lambda x: x <> '')) * 1.3))::BIGINT AS tokens FROM b GROUP BY 1""",
}
