"""The retrieval cascade over a table of questions: intent, a compact first phase, and a second one that expands what the first doesn't cover."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramix.functions.text import answer_type, canonical_name, search_terms, token_count
from engramix.operators import fusion, graph, retrieval
from engramix.operators.extract import literals
from engramix.operators.predicates import Viewer, admits, allowed
from engramix.operators.temporal import millis, phrase_window, resolve_phrase
from engramix.session import cut

# Words of a question that find nothing.
STOP = (
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "at", "for", "by", "with", "from", "as", "is", "are", "was", "were", "be", "been", "do", "does", "did", "has", "have", "had", "it", "its", "this", "that", "these", "those",
    "i", "you", "he", "she", "we", "they", "my", "your", "our", "their", "what", "who", "when", "where", "why", "how", "which", "whether", "not", "no", "so", "if", "then", "there", "about", "can", "could", "will", "would", "please",
)
# How many of each kind the first phase takes.
COMPACT = {"fact": 20, "procedure": 10, "topic": 5}
# Weights of relations when activation spreads.
EDGE_WEIGHTS = {"ABOUT": 1.0, "MENTIONS": 1.0, "SUPPORTED_BY": 0.9, "OBSERVED_IN": 0.7, "HAS_CHUNK": 0.5, "IN_SESSION": 0.3, "RECORDED_BY": 0.3, "FOLLOWED_BY": 0.3}


@dataclass(frozen=True)
class Settings:
    candidates: int = 50
    limit: int = 20
    budget: int = 2000
    trade: float = 0.7
    duplicate: float = 0.85
    rrf_k: float = 60.0
    coverage: float = 0.75
    least_items: int = 3
    cap: int = 3
    session_share: float = 0.1
    type_factor: float = 1.2
    compact: dict = field(default_factory=lambda: dict(COMPACT))

    def checked(self) -> "Settings":
        """These settings; ValueError if one of them makes no sense."""
        if not (0 < self.limit <= self.candidates and self.budget > 0 and 0 <= self.trade <= 1 and 0 < self.duplicate <= 1 and self.rrf_k > 0 and 0 <= self.coverage <= 1 and self.cap >= 0 and self.type_factor > 0):
            raise ValueError("settings out of range: the limit is at most the number of candidates, shares lie within 0 and 1")
        return self


def keywords(question: Column) -> Column:
    """The distinct terms of a question that may find something; all terms where none is left."""
    terms = F.array_distinct(search_terms(question))
    told = F.filter(terms, lambda t: ~t.isin(*STOP))
    return F.when(F.size(told) > 0, told).otherwise(terms)


def intents(questions: DataFrame, asked_at: str | None = None) -> DataFrame:
    """``questions`` (query_id, query) with what they ask: keywords, literals, wanted (kind of answer), names, and the window lo, hi (milliseconds) of a time phrase."""
    q = F.col("query")
    names = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(r"(?<![.!?] )(?<!^)(\p{Lu}[\p{L}\p{M}'’-]+(?: \p{Lu}[\p{L}\p{M}'’-]+)*)"), F.lit(1)), canonical_name))
    known = questions.withColumn("keywords", keywords(q)).withColumn("literals", literals(q)).withColumn("wanted", answer_type(q)).withColumn("names", names)
    if asked_at is None:
        return known.withColumn("lo", F.lit(None).cast("long")).withColumn("hi", F.lit(None).cast("long"))
    r = resolve_phrase(q, F.col(asked_at))
    lo, hi = phrase_window(r["point"], r["granularity"])
    return known.withColumn("lo", millis(lo)).withColumn("hi", millis(hi))


def asked(intent: DataFrame) -> DataFrame:
    """(query_id, query) with only the keywords, as full-text search takes them."""
    return intent.select("query_id", F.array_join("keywords", " ").alias("query"))


def compact(items: DataFrame, intent: DataFrame, settings: Settings = Settings(), found: DataFrame | None = None) -> DataFrame:
    """(query, nid, label, score, rank): the best facts, procedures and topics of each question by full text; scores s / (1 + s) lie within 0 and 1.

    Kinds that the settings don't name take no part. ``found`` are the terms of the items (``retrieval.found_terms`` with the label), where they are known.
    """
    limits = F.create_map(*[F.lit(x) for pair in settings.compact.items() for x in pair])
    kinds = F.col("label").isin(*settings.compact)
    asks = retrieval.asked_terms(asked(intent))
    if found is None:
        found = retrieval.found_terms(items.where(kinds), asks, "nid", "content", "label", broadcast=True)
    ranked = retrieval.bm25_best(found.where(kinds), asks, max(settings.compact.values()), "label", bounded=True).withColumnRenamed("doc", "nid")
    return ranked.where(F.col("rank") <= F.try_element_at(limits, F.col("label"))).select("query", "nid", "label", "score", "rank")


def covered(first: DataFrame, intent: DataFrame, settings: Settings = Settings(), unstable: DataFrame | None = None) -> DataFrame:
    """(query, items, coverage, enough): whether the first phase answers a question.

    Facets are the keywords of the question. ``unstable`` (name) are entities that changed too often of late; a question that
    names one is never covered.
    """
    asks = intent.select(F.col("query_id").alias("query"), F.greatest(F.size("keywords"), F.lit(1)).alias("facets"), "names")
    sums = first.groupBy("query").agg(F.count("*").alias("items"), F.avg("score").alias("mean"), F.count_distinct(fusion.tier_of(F.col("label"))).alias("tiers"))
    joined = asks.join(sums, "query", "left")
    share = F.least(F.coalesce("items", F.lit(0)) / F.col("facets"), F.lit(1.0))
    score = 0.4 * share + 0.3 * F.least(F.greatest(F.coalesce("mean", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) + 0.3 * F.coalesce("tiers", F.lit(0)) / 5
    out = joined.select("query", F.coalesce("items", F.lit(0)).alias("items"), score.alias("coverage"), "names")
    enough = (F.col("coverage") >= settings.coverage) & (F.col("items") >= settings.least_items)
    if unstable is not None:
        drifting = out.select("query", F.explode("names").alias("name")).join(unstable.select("name").distinct(), "name", "left_semi").select("query").distinct().withColumn("drifts", F.lit(True))
        out = out.join(drifting, "query", "left")
        enough = enough & F.col("drifts").isNull()
    return out.select("query", "items", "coverage", enough.alias("enough"))


def temporal_hits(items: DataFrame, intent: DataFrame, at: str = "at", bucket_ms: int = 86_400_000) -> DataFrame:
    """(query, nid, score 1.0) of items whose time lies in the window of a question: an equi-join on days, so no pairs outside are formed."""
    windows = intent.where("lo is not null and hi > lo").select(F.col("query_id").alias("query"), "lo", "hi").withColumn("day", F.explode(F.sequence(F.floor(F.col("lo") / bucket_ms), F.floor((F.col("hi") - 1) / bucket_ms))))
    placed = items.where(F.col(at).isNotNull()).select("nid", millis(F.col(at)).alias("t")).withColumn("day", F.floor(F.col("t") / bucket_ms))
    return placed.join(windows, "day").where("t >= lo and t < hi").select("query", "nid", F.lit(1.0).alias("score"))


def asked_exactly(intent: DataFrame) -> DataFrame:
    """(query_id, query) with only the literals, of questions that have any."""
    return intent.where(F.size("literals") > 0).select("query_id", F.array_join("literals", " ").alias("query"))


def literal_hits(items: DataFrame, intent: DataFrame) -> DataFrame:
    """(query, nid, score): full text by the literals of a question, where it has any."""
    return retrieval.bm25(items, asked_exactly(intent), "nid", "content").select("query", F.col("doc").alias("nid"), "score")


def seeds(intent: DataFrame, named: DataFrame) -> DataFrame:
    """(query, node): the nodes (name, node) that the names of a question name."""
    return intent.select(F.col("query_id").alias("query"), F.explode("names").alias("name")).join(named.select("name", "node").distinct(), "name").select("query", "node").distinct()


def graph_hits(edges: DataFrame, start: DataFrame, dropped: DataFrame | None = None, damping: float = 0.85, rounds: int = 3, weights: dict | None = None) -> DataFrame:
    """(query, nid, score): activation that spreads from the seeds of each question, without the seeds and the nodes of ``dropped`` (node)."""
    spread = graph.activation(edges, start, damping, rounds, weights or EDGE_WEIGHTS)
    out = spread.join(start, ["query", "node"], "left_anti")
    if dropped is not None:
        out = out.join(dropped.select("node").distinct(), "node", "left_anti")
    return out.select("query", F.col("node").alias("nid"), "score")


def session_boost(scored: DataFrame, first: DataFrame, support: DataFrame, belongs: DataFrame, share: float) -> DataFrame:
    """``scored`` (query, nid, score) with ``share`` of the scores of the facts added that the item's session supports.

    ``support`` (nid of the fact, session) and ``belongs`` (nid of the item, session); a fact counts once for a session.
    """
    held = first.where("label = 'fact'").select("query", F.col("nid").alias("fact"), F.col("score").alias("s"))
    of = support.select(F.col("nid").alias("fact"), "session").distinct()
    by_session = held.join(of, "fact").groupBy("query", "session").agg(F.sum("s").alias("boost"))
    boosts = by_session.join(belongs.select("nid", "session").distinct(), "session").groupBy("query", "nid").agg(F.sum("boost").alias("boost"))
    joined = scored.join(boosts, ["query", "nid"], "left")
    return joined.withColumn("score", F.col("score") + share * F.coalesce("boost", F.lit(0.0))).drop("boost")


def type_boost(scored: DataFrame, intent: DataFrame, mentions: DataFrame, factor: float) -> DataFrame:
    """``scored`` with the score times ``factor`` where an entity that the item mentions (nid, kind) is of the kind that the question wants."""
    wanted = intent.where("wanted is not null").select(F.col("query_id").alias("query"), F.col("wanted").alias("kind"))
    fits = scored.join(wanted, "query").join(mentions.select("nid", "kind").distinct(), ["nid", "kind"], "left_semi").select("query", "nid").withColumn("fits", F.lit(True))
    joined = scored.join(fits.distinct(), ["query", "nid"], "left")
    return joined.withColumn("score", F.when(F.col("fits"), F.col("score") * factor).otherwise(F.col("score"))).drop("fits")


def fused_lists(lists: list[tuple[str, DataFrame, float]], settings: Settings = Settings()) -> DataFrame:
    """(query, nid, fused): ranked lists (name, rows of query, nid, score; weight) as one, by weighted reciprocal ranks; each list counts its best candidates."""
    arms = [retrieval.top_k(rows, settings.candidates, ["query"], "nid").select(F.lit(name).alias("list"), "query", "nid", "score", F.lit(float(weight)).alias("w")) for name, rows, weight in lists]
    return fusion.rrf(reduce(DataFrame.unionByName, arms), ["query"], "list", "nid", k=settings.rrf_k, base=0, weight="w")


def with_first(second: DataFrame, first: DataFrame, cap: int) -> DataFrame:
    """(query, nid, score): the second phase and the ``cap`` best facts of the first, of each item its better score."""
    best = retrieval.top_k(first.where("label = 'fact'").select("query", "nid", "score"), cap, ["query"], "nid").select("query", "nid", "score")
    return second.select("query", "nid", "score").unionByName(best).groupBy("query", "nid").agg(F.max("score").alias("score"))


def recall(
    items: DataFrame,
    questions: DataFrame,
    settings: Settings = Settings(),
    allow: DataFrame | None = None,
    viewer: Viewer | None = None,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    edges: DataFrame | None = None,
    named: DataFrame | None = None,
    unstable: DataFrame | None = None,
    redacted: DataFrame | None = None,
) -> DataFrame:
    """(query_id, position, nid, label, content, score, tokens): the items that answer each question.

    ``items`` has nid, label, content and visibility, and may have a time ``at``; ``questions`` query_id, query and may have ``asked_at``.
    Scope, visibility and redaction (``redacted``, nid) restrict the candidates before any ranking. A question that its best
    facts, procedures and topics cover is answered by them. All others ask full text, literals, the time that they name, vectors and the graph, where
    these are given; the lists are fused by reciprocal ranks, weighed by tier and joined by the best facts. Near copies are thinned and the rest is packed into the token budget.
    """
    settings.checked()
    seen = allowed(items, allow, "nid")
    if redacted is not None:
        seen = seen.join(redacted.select("nid").distinct(), "nid", "left_anti")
    if viewer is not None:
        seen = seen.where(admits(F.col("visibility"), viewer))
    intent = cut(intents(questions, "asked_at" if "asked_at" in questions.columns else None))
    terms = retrieval.asked_terms(asked(intent)).unionByName(retrieval.asked_terms(asked_exactly(intent)))
    found = retrieval.found_terms(seen, terms, "nid", "content", "label", broadcast=True)
    first = cut(compact(seen, intent, settings, found))
    gate = cut(covered(first, intent, settings, unstable))
    enough = gate.where("enough").select("query")
    open_ = intent.join(enough, intent["query_id"] == enough["query"], "left_anti")
    best = lambda asks: retrieval.bm25_best(found, retrieval.asked_terms(asks), settings.candidates).select("query", F.col("doc").alias("nid"), "score")
    lists: list[tuple[str, DataFrame, float]] = [("text", best(asked(open_)), 1.0), ("literals", best(asked_exactly(open_)), 2.0)]
    if "at" in items.columns and "asked_at" in questions.columns:
        lists.append(("time", temporal_hits(seen, open_), 1.0))
    if vectors is not None and query_vectors is not None:
        near = retrieval.exact_nearest(vectors.join(seen.select("nid"), "nid", "left_semi"), query_vectors, settings.candidates, "nid", "embedding")
        lists.append(("vector", near.select("query", F.col("id").alias("nid"), "score").join(enough, "query", "left_anti"), 1.0))
    if edges is not None and named is not None:
        lists.append(("graph", graph_hits(edges, seeds(open_, named)).join(seen.select("nid"), "nid", "left_semi"), 1.0))
    labelled = seen.select("nid", "label")
    second = fused_lists(lists, settings).join(labelled, "nid").select("query", "nid", (F.col("fused") * F.coalesce(fusion.tier_weight(F.col("label")), F.lit(0.5))).alias("score"))
    both = with_first(second, first.join(enough, "query", "left_anti"), settings.cap).unionByName(first.join(enough, "query", "left_semi").select("query", "nid", "score"))
    scored = cut(both.join(seen.select("nid", "label", "content"), "nid"))
    kept = fusion.mmr(scored, "query", "nid", "content", trade=settings.trade, duplicate=settings.duplicate, limit=settings.limit)
    chosen = cut(scored.join(kept, ["query", "nid"]).withColumn("tokens", token_count(F.col("content"))))
    packed = fusion.pack(chosen, "query", "nid", "tokens", limit=settings.limit, budget=settings.budget)
    out = packed.join(chosen.select("query", "nid", "label", "content", "score", "position"), ["query", "nid"])
    return out.select(F.col("query").alias("query_id"), "position", "nid", "label", "content", "score", "tokens")
