"""Scalar text functions, extraction, chunking, visibility and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.functions import text as T
from engramix.operators import chunking, evaluate, extract, retrieval
from engramix.operators.predicates import Viewer, admits
from engramix.sources.tables import read


def canonical_names(spark, folder):
    n = read(spark, folder, "ner_spans", "text").where("text is not null")
    return n.select(T.canonical_name(F.col("text")).alias("name")).groupBy("name").agg(F.count("*").alias("spellings"))


def informative_messages(spark, folder):
    m = read(spark, folder, "ingest_messages", "content", "content_type").where("content is not null")
    return m.groupBy("content_type", T.is_informative(F.col("content"), F.col("content_type")).alias("informative")).agg(F.count("*").alias("n"))


def message_tokens(spark, folder):
    m = read(spark, folder, "ingest_messages", "delivery_id", "content").where("content is not null")
    return m.select("delivery_id", T.token_count(F.col("content")).alias("tokens"), F.length(T.cap_chars(F.col("content"), 80)).alias("capped"))


def answer_types(spark, folder):
    i = read(spark, folder, "eval_items", "item_id", "question")
    return i.select("item_id", T.answer_type(F.col("question")).alias("answer_type"))


def search_texts(spark, folder):
    """Search tokens of all messages: identifiers whole and in parts."""
    m = read(spark, folder, "ingest_messages", "delivery_id", "content").where("content is not null")
    return m.select("delivery_id", T.search_text(F.col("content")).alias("search_text"))


def artifact_languages(spark, folder):
    a = read(spark, folder, "ingest_artifacts", "artifact_id", "path")
    return a.select("artifact_id", T.language_of(F.col("path")).alias("language"))


def visible_messages(spark, folder):
    """What one viewer may see, by kind of visibility."""
    m = read(spark, folder, "ingest_messages", "visibility")
    viewer = Viewer("user-005", ["t1", "t3"], ["o1"])
    return m.groupBy(F.coalesce(F.substring_index(T.visibility(F.col("visibility")), ":", 1), F.lit("public")).alias("scheme")).agg(F.count("*").alias("rows"), F.count_if(admits(F.col("visibility"), viewer)).alias("admitted"))


def rule_entities(spark, folder):
    m = read(spark, folder, "ingest_messages", "delivery_id", "content")
    found = extract.entities(m, "delivery_id", "content")
    return found.where(extract.admitted(F.col("entity_type"), F.col("confidence"), F.col("surface"))).groupBy("entity_type").agg(F.count("*").alias("entities"), F.sum("mentions").alias("mentions"))


def rule_observations(spark, folder):
    m = read(spark, folder, "ingest_messages", "delivery_id", "content", "content_type", "sender_id").where("content is not null")
    return extract.observations(m, "delivery_id", "content", "content_type", "sender_id").groupBy("delivery_id").agg(F.count("*").alias("observations"), F.round(F.sum("confidence"), 4).alias("confidence"))


def question_literals(spark, folder):
    m = read(spark, folder, "ingest_messages", "delivery_id", "content").where("content is not null")
    return m.select("delivery_id", F.array_join(extract.literals(F.col("content")), "|").alias("literals")).where("literals <> ''")


def artifact_chunks(spark, folder):
    """Chunks of all artifacts by the kind of their content."""
    a = read(spark, folder, "ingest_artifacts", "artifact_id", "content", "path").withColumn("language", T.language_of(F.col("path")))
    return chunking.chunk_table(a, "artifact_id", "content", language="language").select("artifact_id", "index", "kind", "tokens", F.length("text").alias("chars"))


def passage_f1(spark, folder):
    """Token F1 of each answer against its passage and question."""
    i = read(spark, folder, "eval_items", "item_id", "question", "passage", "answer").where("answer is not null")
    return i.select("item_id", F.round(evaluate.token_f1(F.col("question"), F.col("passage")), 6).alias("f1"), evaluate.contains_answer(F.col("passage"), F.col("answer")).alias("contained"))


def retrieval_quality(spark, folder):
    """Recall, NDCG and MRR of BM25 over the passages, each question's own passage being right."""
    items = read(spark, folder, "eval_items", "item_id", "question", "passage", "question_type")
    scored = retrieval.bm25(items, items.select(F.col("item_id").alias("query_id"), F.col("question").alias("query")), "item_id", "passage")
    ranked = retrieval.top_k(scored, 10, ["query"], "doc").select("query", F.col("doc").alias("item"), "rank")
    right = items.select(F.col("item_id").alias("query"), F.col("item_id").alias("item"))
    m = evaluate.ranking_measures(ranked, right, "query", "item", "rank", 10).join(items.select(F.col("item_id").alias("query"), "question_type"), "query")
    return evaluate.summary(m, ["question_type"], ["recall", "ndcg", "mrr", "hit"]).select("question_type", "n", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr", "hit")])


def label_neighbours(spark, folder):
    """Share of the five nearest vectors that carry the label of the query."""
    e = read(spark, folder, "embeddings", "vec_id", "embedding", "label")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = retrieval.exact_nearest(e, q, 6, "vec_id", "embedding").where("query <> id")
    a, b = e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), e.select(F.col("vec_id").alias("id"), "label")
    return near.join(a, "query").join(b, "id").groupBy("query").agg(F.round(F.avg(F.when(F.col("ql") == F.col("label"), 1.0).otherwise(0.0)), 6).alias("same_label"))


QUERIES = {f.__name__: f for f in (canonical_names, informative_messages, message_tokens, answer_types, search_texts, artifact_languages, visible_messages, rule_entities, rule_observations, question_literals, artifact_chunks, passage_f1, retrieval_quality, label_neighbours)}

_NAME = r"lower(regexp_replace(trim(regexp_replace(text, '[\s\x{0B}]+', ' ', 'g')), '^[!-/:-@\[-`{-~\s]+|[!-/:-@\[-`{-~\s]+$', '', 'g'))"
_WORDS = r"len(list_filter(regexp_split_to_array(trim({0}, ' '), '[\s\x{{0B}}]+'), lambda w: w <> ''))"
_FILLERS = ", ".join("'" + f.replace("'", "''") + "'" for f in T.FILLERS)
_ANS = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the', 'and'))"

SQL = {
    "canonical_names": f"SELECT {_NAME} AS name, count(*) AS spellings FROM ner_spans WHERE text IS NOT NULL GROUP BY 1",
    "informative_messages": f"""SELECT content_type, coalesce(lower(content_type) NOT IN ('system', 'error'), true) AND {_WORDS.format('content')} >= 5 AND lower(trim(regexp_replace(trim(content, ' '), '[!-/:-@\\[-`{{-~]+$', ''), ' ')) NOT IN ({_FILLERS})
          AND NOT (trim(content, ' ') LIKE '%?' AND {_WORDS.format('content')} < 8) AS informative, count(*) AS n FROM ingest_messages WHERE content IS NOT NULL GROUP BY 1, 2""",
    "message_tokens": f"SELECT delivery_id, ceil({_WORDS.format('content')} * 1.3)::BIGINT AS tokens, CASE WHEN length(content) > 80 THEN 81 ELSE length(content) END::INT AS capped FROM ingest_messages WHERE content IS NOT NULL",
    "answer_types": "SELECT item_id, CASE " + " ".join(f"WHEN regexp_matches(lower(trim(question)), '{p}') THEN '{k}'" for p, k in T.ANSWER_TYPES) + " END AS answer_type FROM eval_items",
    "artifact_languages": "SELECT artifact_id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in T.LANGUAGES.items()) + " END AS language FROM ingest_artifacts",
    "visible_messages": """WITH m AS (SELECT trim(coalesce(visibility, '')) AS v FROM ingest_messages), s AS (SELECT v, CASE WHEN v = '' OR lower(v) = 'public' THEN 'public' ELSE split_part(v, ':', 1) END AS scheme, split_part(v, ':', -1) AS r FROM m)
        SELECT scheme, count(*) AS rows, count(*) FILTER (v IN ('', 'public') OR (v LIKE 'private:%' AND r = 'user-005') OR (v LIKE 'team:%' AND r IN ('t1', 't3')) OR (v LIKE 'org:%' AND r = 'o1')) AS admitted FROM s GROUP BY 1""",
    "passage_f1": f"""WITH t AS (SELECT item_id, {_ANS.format('question')} AS p, {_ANS.format('passage')} AS g, array_to_string({_ANS.format('passage')}, ' ') AS c, array_to_string({_ANS.format('answer')}, ' ') AS a FROM eval_items WHERE answer IS NOT NULL),
        u AS (SELECT *, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))) AS common FROM t)
        SELECT item_id, round(CASE WHEN common > 0 THEN 2.0 * common / (len(p) + len(g)) ELSE 0 END, 6) AS f1, a <> '' AND contains(' ' || c || ' ', a) AS contained FROM u""",
    "retrieval_quality": r"""WITH t AS (SELECT item_id AS doc, unnest(list_filter(regexp_split_to_array(lower(passage), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')) AS term FROM eval_items), dl AS (SELECT doc, count(*) AS dl FROM t GROUP BY 1), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
        q AS (SELECT DISTINCT item_id AS query, unnest(list_filter(regexp_split_to_array(lower(question), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')) AS term FROM eval_items), h AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
        b AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc), s GROUP BY 1, 2),
        r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS k FROM b QUALIFY k <= 10), m AS (SELECT item_id, question_type, min(k) AS k FROM eval_items LEFT JOIN r ON query = item_id AND doc = item_id GROUP BY 1, 2)
        SELECT question_type, count(*) AS n, round(avg(CASE WHEN k IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1 / log2(k + 1), 0)), 6) AS ndcg, round(avg(coalesce(1.0 / k, 0)), 6) AS mrr, round(avg(CASE WHEN k IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit FROM m GROUP BY ROLLUP (question_type)""",
    "label_neighbours": """WITH g AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
        s AS (SELECT a.vec_id AS query, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (a.n * b.n) AS score FROM g a, g b WHERE a.vec_id % 20 = 0),
        k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) <= 6) SELECT query, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS same_label FROM k WHERE query <> id GROUP BY 1""",
}
