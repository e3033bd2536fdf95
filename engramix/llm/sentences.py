"""Sentence units of every document, across languages and scripts.

One pass over the corpus counts the evidence: which words stand at unambiguous starts and which
within sentences, and what follows marked words ('approx.', 'Ping!'), from which joins tell after
which of them the sentence goes on. Frequent words are broadcast; of the others a second pass tells
which a document may ask for, and a join brings them to it. Each document is split with its own
evidence first and that of the corpus where it has none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix.llm.sentence_rules import Evidence, asked, end_at, marked_words, sentences, small_of, starter_counts
from engramix.session import cut, discard

#: A word that holds one in so many of all counted occurrences is broadcast, so these are at most twice as many words; the others are joined.
SHARE = 200_000
WORD, MARK = 0, 1


def _counts(texts: DataFrame) -> DataFrame:
    """(kind, word, follows, small, n): 0 and 1 for words at starts and within; 2 and 3 for marked words before a small word, or none, and before one with a capital."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts, inside, marks = Counter(), Counter(), Counter()
            for t in batch["t"]:
                starter_counts(t, starts, inside)
                marks.update(marked_words(t))
            rows = [(kind, word, None, None, n) for kind, found in enumerate((starts, inside)) for word, n in found.items()]
            rows += [(2 + capital, key, w, small_of(w) if w and w[:1].isupper() else None, n) for (key, w, capital), n in marks.items()]
            yield pd.DataFrame(rows, columns=["kind", "word", "follows", "small", "n"])

    found = texts.mapInPandas(run, "kind int, word string, follows string, small string, n long")
    return cut(found.groupBy("kind", "word", "follows", "small").agg(F.sum("n").alias("n")))


def _sums(rows: DataFrame, of: int, first) -> DataFrame:
    """(of, word, a, b): how often ``first`` holds for a word and how often it doesn't."""
    return rows.groupBy("word").agg(F.sum(F.when(first, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(first, 0).otherwise(F.col("n"))).alias("b")).select(F.lit(of).alias("of"), "word", "a", "b")


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(of, word, a, b) of all words in column ``t`` of ``texts``: a word at starts and within sentences; a marked word after which it goes on and begins anew."""
    counted = _counts(texts)
    words = cut(_sums(counted.where("kind < 2"), WORD, F.col("kind") == 0))
    held = words.select(F.col("word").alias("follows"), "a", "b")
    small = words.select(F.col("word").alias("small"), F.col("b").alias("b_small"))
    # As Evidence.begins tells it of a word by the corpus alone.
    begins = F.coalesce(F.col("b_small") > F.coalesce("b", F.lit(0)), F.lit(False)) | F.coalesce(F.col("a") > F.col("b") * 0.5, F.lit(False))
    marks = counted.where("kind >= 2").join(held, "follows", "left").join(small, "small", "left").where((F.col("kind") == 3) | ~begins)
    out = cut(words.unionByName(_sums(marks, MARK, (F.col("kind") == 2) | ~begins)))
    discard(counted, words)
    return out


def evidence(texts: DataFrame) -> tuple[Evidence, DataFrame]:
    """Evidence of the whole corpus in column ``t`` of ``texts``: of the frequent words, and (of, word, a, b) of all others."""
    counts = corpus_counts(texts)
    totals = {r["of"]: (r["a"] / SHARE, r["b"] / SHARE) for r in counts.groupBy("of").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    frequent = F.lit(False)
    for of, (a, b) in totals.items():
        frequent |= (F.col("of") == of) & ((F.col("a") > 0) & (F.col("a") >= a) | (F.col("b") > 0) & (F.col("b") >= b))
    return _evidence((r["of"], r["word"], r["a"], r["b"]) for r in counts.where(frequent).collect()), counts.where(~frequent)


def _evidence(rows) -> Evidence:
    starts, inside, marks = {}, {}, {}
    for of, word, a, b in rows:
        if of == WORD:
            starts[word], inside[word] = a, b
        else:
            marks[word, 0], marks[word, 1] = a, b
    return Evidence(starts, inside, marks, holds=True)


class _Both:
    """Counts of the words joined to a document, and of those that are broadcast."""

    def __init__(self, own: Mapping, shared: Mapping):
        self.own, self.shared = own, shared

    def get(self, word, default=None):
        found = self.own.get(word)
        return self.shared.get(word, default) if found is None else found


def _joined(own: Evidence, shared: Evidence) -> Evidence:
    return Evidence(_Both(own.starts, shared.starts), _Both(own.inside, shared.inside), _Both(own.marks, shared.marks), holds=True)


def _asked(texts: DataFrame, rare: DataFrame, shared) -> DataFrame:
    """(h, found): by the hash of a text, those of the ``rare`` words that it may ask for. Texts of one hash share theirs, which harms none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            rows = []
            for h, t in zip(batch["h"].tolist(), batch["t"]):
                words, marks = asked(t)
                rows += [(h, WORD, w) for w in words if w not in known.starts] + [(h, MARK, w) for w in marks if (w, 0) not in known.marks]
            yield pd.DataFrame(rows, columns=["h", "of", "word"])

    found = texts.mapInPandas(run, "h long, of int, word string").join(rare, ["of", "word"])
    return found.groupBy("h").agg(F.collect_set(F.struct("of", "word", "a", "b")).alias("found"))


def sentence_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, sentence_no from 1, end_at): where each unit of a document ends.

    ``end_at`` counts code points from the start of the text, white space left out; the last unit
    ends with the text. Documents that are null or hold nothing visible have no rows. Each row
    is split for itself, equal ids and texts too; other columns aren't read.
    """
    d = documents.where(documents[text_col].isNotNull()).select(documents[id_col].alias("d"), documents[text_col].alias("t"))
    frequent, rare = evidence(d.select("t"))
    shared = d.sparkSession.sparkContext.broadcast(frequent)
    if rare.isEmpty():
        held = d.withColumn("found", F.lit(None).cast("array<struct<of: int, word: string, a: bigint, b: bigint>>"))
    else:
        hashed = d.withColumn("h", F.xxhash64("t"))
        held = hashed.join(_asked(hashed.select("h", "t"), rare, shared), "h", "left").select("d", "t", "found")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, t, found in zip(batch["d"], batch["t"], batch["found"]):
                known = shared.value if found is None else _joined(_evidence((x["of"], x["word"], x["a"], x["b"]) for x in found), shared.value)
                rows += [(key, no, at) for no, at in enumerate(end_at(t, sentences(t, known)), 1)]
            yield pd.DataFrame(rows, columns=[id_col, "sentence_no", "end_at"])

    return held.mapInPandas(split, f"{id_col} {d.schema['d'].dataType.simpleString()}, sentence_no int, end_at int")
