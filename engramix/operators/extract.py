"""Entities and observations by rules, as JVM expressions and table functions."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramix.functions.text import FACT, PREFERENCE, canonical_name, is_informative, sentences

# What the rules recognise, with type and confidence; group 1 where there is one is the entity.
ENTITY_RULES = (
    (r"https?://[^\s<>\[\]()]+", 0, "url", 0.95),
    (r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b", 0, "email", 0.95),
    (r"\b\d{4}[-/]\d{2}[-/]\d{2}(?:T\d{2}:\d{2}(?::\d{2})?(?:Z|[+\-]\d{2}:?\d{2})?)?\b", 0, "date", 0.9),
    (r"(?i)\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4}\b", 0, "date", 0.85),
    (r"\b\d+(?:\.\d+)?\s*(?:kg|g|mg|lb|oz|km|m|cm|mm|mi|ft|in|MB|GB|TB|KB|ms|s|min|hrs?|%|px)\b", 0, "measurement", 0.85),
    (r"(?i)\bI\s+(?:prefer|like|love|hate|dislike|enjoy)\s+(.{2,40}?)(?:[.,;!?\n]|$)", 1, "preference", 0.7),
    (r"\"([^\"]{2,60})\"", 1, "quoted", 0.6),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", 1, "person", 0.7),
)


#: What a text must hold for an entity of a kind to be in it.
SIGNS = {"url": ("http",), "email": ("@",), "preference": ("prefer", "like", "love", "hate", "enjoy"), "quoted": ('"',)}


def _typed(kind: str, confidence: float):
    return lambda x: F.struct(F.lit(kind).alias("entity_type"), F.trim(x).alias("surface"), F.lit(confidence).alias("confidence"))


def entities(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entity_type, surface, name, confidence, mentions) of each text by the rules above, in the JVM.

    Of a capitalised sequence nothing is kept that overlaps another entity: those are blanked first.
    """
    arms = []
    masked = F.col("t")
    for pattern, group, kind, confidence in ENTITY_RULES:
        source = masked if kind == "person" else F.col("t")
        # A pattern only runs over texts that hold a sign of it; all others are left as they are.
        may = reduce(operator.or_, [F.contains(F.lower("t"), F.lit(sign)) for sign in SIGNS[kind]]) if kind in SIGNS else F.col("t").rlike(r"\d") if kind in ("date", "measurement") else F.lit(True)
        found = F.when(may, F.regexp_extract_all(source, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))
        arms.append(F.transform(found, _typed(kind, confidence)))
        if kind != "person":
            masked = F.when(may, F.regexp_replace(masked, pattern, " # ")).otherwise(masked)
    spread = rows.select(rows[id_col].alias("id"), rows[text_col].alias("t")).where("t is not null").select("id", F.explode(F.flatten(F.array(*arms))).alias("e")).select("id", "e.*")
    name = F.when(F.col("entity_type") == "person", canonical_name(F.col("surface"))).when(F.col("entity_type") == "url", F.col("surface")).otherwise(F.lower("surface"))
    return spread.withColumn("name", name).where("name <> ''").groupBy("id", "entity_type", "name").agg(F.min("surface").alias("surface"), F.max("confidence").alias("confidence"), F.count("*").alias("mentions")).withColumnRenamed("id", id_col)


def admitted(kind: Column, confidence: Column, surface: Column, other_least: float = 0.9) -> Column:
    """Dates, measures, preferences and quotations are no entities; others need ``other_least``; persons don't begin with a filler."""
    filler = F.lower(F.substring_index(F.trim(surface), " ", 1)).isin("hey", "hi", "hello", "thanks", "congrats", "wow", "ok", "okay", "yes", "no", "sure", "bye")
    return ~kind.isin("date", "measurement", "preference", "quoted") & F.when(kind == "other", confidence >= other_least).when(kind == "person", ~filler).otherwise(True)


def self_contained(sentence: Column, subject: Column) -> Column:
    """A leading pronoun replaced by the subject."""
    out = sentence
    for pattern, tail in ((r"(?i)^I'm\b", " is"), (r"(?i)^I've\b", " has"), (r"(?i)^I'll\b", " will"), (r"(?i)^I'd\b", " would"), (r"(?i)^(She|He)'s\b", " is"), (r"(?i)^They're\b", " are"), (r"(?i)^(She|He|They|It|I)\b", "")):
        out = F.when(out.rlike(pattern), F.concat(subject, F.lit(tail), F.regexp_replace(out, pattern, ""))).otherwise(out)
    return out


def observations(messages: DataFrame, id_col: str, text_col: str, kind_col: str, speaker_col: str) -> DataFrame:
    """(id, sentence_no, content, confidence): informative sentences that state a fact (0.7) or a preference (0.7), or have at least four words (0.6)."""
    kept = messages.where(is_informative(F.col(text_col), F.col(kind_col)))
    one = kept.select(F.col(id_col).alias("id"), F.col(speaker_col).alias("speaker"), F.posexplode(sentences(F.col(text_col))).alias("sentence_no", "s"))
    strong = F.col("s").rlike(FACT) | F.col("s").rlike(PREFERENCE)
    found = one.where(strong | (F.size(F.split("s", r"\s+")) >= 4)).where(~F.col("s").endswith("?"))
    return found.select(F.col("id").alias(id_col), "sentence_no", self_contained(F.col("s"), F.coalesce("speaker", F.lit("someone"))).alias("content"), F.when(strong, 0.7).otherwise(0.6).alias("confidence"))


def literals(question: Column) -> Column:
    """Quoted phrases, and words that are evidently identifiers, in order, each once."""
    quoted = F.regexp_extract_all(question, F.lit(r"[\"“`]([^\"”`]+)[\"”`]"), F.lit(1))
    rest = F.regexp_replace(question, r"[\"“`][^\"”`]+[\"”`]", " ")
    words = F.transform(F.split(rest, r"\s+"), lambda w: F.regexp_replace(w, r"^[?,.!;:()\[\]'\"]+|[?,.!;:()\[\]'\"]+$", ""))
    odd = lambda w: (w != "") & (w.rlike(r"\d") | w.rlike(r"[\p{L}\p{N}].*[_\-./:@#].*[\p{L}\p{N}]") | w.rlike(r"\p{Ll}\p{Lu}") | w.rlike(r"^(?=(?:[^A-Z]*[A-Z]){2})[A-Z0-9]+$"))
    return F.array_distinct(F.filter(F.concat(F.transform(quoted, F.trim), F.filter(words, odd)), lambda w: w != ""))


def suppressed(spans: DataFrame, stronger: DataFrame, doc: str, start: str, end: str, confidence: str) -> DataFrame:
    """``spans`` without those that overlap a span of ``stronger`` in the same document that is at least as certain; ends are exclusive."""
    by = stronger.select(F.col(doc).alias("__d"), F.col(start).alias("__a"), F.col(end).alias("__b"), F.col(confidence).alias("__c"))
    return spans.join(by, (F.col(doc) == F.col("__d")) & (F.col("__a") < F.col(end)) & (F.col(start) < F.col("__b")) & (F.col("__c") >= F.col(confidence)), "left_anti")
