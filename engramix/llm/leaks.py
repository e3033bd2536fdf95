"""Evaluation texts that leaked into a corpus.

Pigeonhole edit matching on words: a sentence of n words with a budget of k edits is split into
k + 1 pieces, of which at least one stands unchanged in any text within the budget. The pieces
of all items are looked up in each document in one pass of an automaton; around each hit
Myers' bit-parallel algorithm gives the edit distance. Verbatim runs of at least twelve words are
found by aligned blocks of six, one of which lies whole in any such run.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, SHARE = 12, 5
#: Items of one automaton; more of them are matched block by block.
BLOCK_ITEMS = 50_000
_DROP = regex.compile(r"\p{Cf}")
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
# Scripts written without spaces: each character, with its marks, counts as a word.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_ANY_UNSPACED = regex.compile(f"[{_UNSPACED}]")
_IDEOGRAPHS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]+")
_MIXED = regex.compile(rf"(?V1)[[{_UNSPACED}]--\p{{M}}]\p{{M}}*|[[\p{{L}}\p{{M}}\p{{N}}]--[{_UNSPACED}]]+")
_SENTENCE = regex.compile(r"(?<=[.!?…。！？।][\"'”’»)]*)\s+|\n+|(?<=[。！？])")


def words(text: str) -> list[str]:
    """Words in lower case; punctuation, white space and invisible characters only separate or vanish. In scripts without spaces every character is a word."""
    found = _WORDS.findall(unicodedata.normalize("NFKC", _DROP.sub("", text)).casefold())
    if text.isascii() or not _ANY_UNSPACED.search(text):
        return found
    out: list[str] = []
    for word in found:
        if word.isascii():
            out.append(word)
        elif _IDEOGRAPHS.fullmatch(word):
            out += word
        else:
            out += _MIXED.findall(word)
    return out


def myers(pattern: list[str], text: list[str]) -> int:
    """Smallest edit distance of ``pattern`` to any stretch of ``text``, by Myers' bit vectors."""
    m = len(pattern)
    if not m:
        return 0
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = at.get(w, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        hp = (minus | ~(d | plus)) & full
        hm = plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        best = min(best, score)
        hp = hp << 1 & full
        hm = hm << 1 & full
        plus = (hm | ~(d | hp)) & full
        minus = hp & d
    return best


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` stretches of nearly equal length that cover n words."""
    edges = [round(i * n / (budget + 1)) for i in range(budget + 2)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


class Matcher:
    """Finds which items leak into a text; made from (item id, passage) pairs."""

    def __init__(self, items: list[tuple[object, str]], run: int = RUN, share: int = SHARE):
        import ahocorasick

        self.run = run
        self.passages: list[tuple[object, list[str]]] = []
        self.sentences: list[tuple[object, list[str], int]] = []
        keys: dict[str, list[tuple[str, int, int]]] = {}

        def add(stretch: list[str], hit: tuple[str, int, int]) -> None:
            keys.setdefault(f" {' '.join(stretch)} ", []).append(hit)

        for item, passage in items:
            if not passage:
                continue
            ws = words(passage)
            block = run // 2
            for a in range(0, len(ws) - block + 1, block):
                add(ws[a : a + block], ("run", len(self.passages), a))
            self.passages.append((item, ws))
            for sentence in _SENTENCE.split(passage):
                s = words(sentence)
                if s:
                    budget = len(s) // share
                    for a, b in pieces(len(s), budget):
                        add(s[a:b], ("sentence", len(self.sentences), a))
                    self.sentences.append((item, s, budget))
        self.automaton = ahocorasick.Automaton()
        for key, hits in keys.items():
            self.automaton.add_word(key, (len(key), hits))
        self.ready = bool(keys)
        if self.ready:
            self.automaton.make_automaton()

    def items_in(self, text: str) -> set:
        ws = words(text)
        if not self.ready or not ws:
            return set()
        line = f" {' '.join(ws)} "
        found: set = set()
        tried: set = set()
        starts: dict[int, int] | None = None
        for end, (length, hits) in self.automaton.iter(line):
            if starts is None:
                starts, at = {}, 0
                for i, w in enumerate(ws):
                    starts[at] = i
                    at += len(w) + 1
            here = starts[end - length + 1]
            for kind, k, offset in hits:
                if kind == "run":
                    item, passage = self.passages[k]
                    if item not in found and self._runs(passage, ws, offset, here):
                        found.add(item)
                else:
                    item, sentence, budget = self.sentences[k]
                    place = (k, here - offset)
                    if item in found or place in tried:
                        continue
                    tried.add(place)
                    a = max(0, here - offset - budget)
                    if myers(sentence, ws[a : here - offset + len(sentence) + budget]) <= budget:
                        found.add(item)
        return found

    def _runs(self, passage: list[str], ws: list[str], p: int, d: int) -> bool:
        n = self.run // 2
        a = b = 0
        while p - a > 0 and d - a > 0 and passage[p - a - 1] == ws[d - a - 1]:
            a += 1
        while p + n + b < len(passage) and d + n + b < len(ws) and passage[p + n + b] == ws[d + n + b]:
            b += 1
        return a + n + b >= self.run


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", run: int = RUN, share: int = SHARE) -> DataFrame:
    """(doc_id, item_id), distinct: the item's passage leaked into the document.

    That is, ``run`` of its words stand there in a row, or a whole sentence of it with at most one word in
    ``share`` replaced, misspelt, dropped or added; in scripts without spaces characters count as words. Null or empty texts and passages never match;
    repeated rows give one result; other columns aren't read. Documents are read once for every
    BLOCK_ITEMS items and never shuffled: what travels is the items, in blocks of that size.
    """
    d = documents.where(documents[text].isNotNull()).select(documents[doc_id].alias("d"), documents[text].alias("t"))
    i = items.where(items[passage].isNotNull() & items[item_id].isNotNull()).select(items[item_id].alias("i"), items[passage].alias("p")).distinct()
    kinds = f"{doc_id} {d.schema['d'].dataType.simpleString()}, {item_id} {i.schema['i'].dataType.simpleString()}"
    blocks = max(1, -(-i.count() // BLOCK_ITEMS))
    out = None
    for b in range(blocks):
        held = d.sparkSession.sparkContext.broadcast([(r["i"], r["p"]) for r in i.where(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == b).collect()])

        def match(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            matcher = Matcher(held.value, run, share)
            for batch in batches:
                rows = [(key, item) for key, t in zip(batch["d"], batch["t"]) for item in matcher.items_in(t)]
                yield pd.DataFrame(rows, columns=[doc_id, item_id])

        part = d.mapInPandas(match, kinds)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
