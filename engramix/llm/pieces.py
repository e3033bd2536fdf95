"""Oversized texts cut into pieces at natural boundaries, with overlap.

A dynamic programme over boundary positions minimises the penalties of the cuts and the
imbalance of sizes, subject to the maximum length and the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 1500, 150
#: Kinds of boundary from the most to the least natural, each with its penalty; a position belongs to the first that fits.
KINDS = (
    (0.0, regex.compile(r"\n[^\S\n]*\n\s*|\n(?=#{1,6} |def |class |fn |func |function |@@ |diff )")),
    (0.6, regex.compile(r"\n+| | ")),
    (1.0, regex.compile(r"[.!?…۔؟][\"'”’»)\]]*\s+(?=[\p{Lu}\p{Lo}\p{N}\"'“‘«(¿¡\[])|[。！？｡]+[”’」』）]*|[।॥]\s*")),
    (2.0, regex.compile(r"[,;:،؛]\s+|[，、；：]")),
    (3.0, regex.compile(r"(?<=[}\])>])(?=[{\[(<])|\s+")),
    (5.0, regex.compile(r"(?<=\P{L})(?=\p{L})|(?<=[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])(?=[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])(?![\p{M}ะาำๅๆ])(?<![เแโใไ])")),
)
#: Penalty of a cut between any two characters.
ANYWHERE = 9.0
#: Weight of the squared relative deviation from the even size.
BALANCE = 4.0
#: Kinds of more than this penalty (between words, within words, anywhere) count only where no stronger boundary is within a third of a piece.
STRONG = 2.0
_JOINS = regex.compile(r"[\p{M}‍️]")


def _whole(text: str, at: int) -> int:
    """``at`` moved back so that no mark, joiner or modifier is cut from its base."""
    while 0 < at < len(text) and (_JOINS.match(text, at) or text[at - 1] == "‍" or (text[at - 1] == "\r" and text[at] == "\n")):
        at -= 1
    return at


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions within ``text`` (its end included) and their penalties.

    All boundaries down to clauses; those between words, within words and between any two characters only between
    neighbours that are further apart than ``reach``.
    """
    found: dict[int, float] = {0: 0.0, len(text): 0.0}
    gaps = [(0, len(text))]
    for penalty, pattern in KINDS:
        for a, b in gaps:
            for m in pattern.finditer(text, a, b):
                at = _whole(text, m.end())
                if a < at < b:
                    found.setdefault(at, penalty)
        if penalty < STRONG:
            continue
        edges = sorted(found)
        gaps = [(x, y) for x, y in zip(edges, edges[1:]) if y - x > reach]
        if not gaps:
            break
    for a, b in gaps:
        for at in range(a + 1, b):
            at = _whole(text, at)
            if a < at < b:
                found.setdefault(at, ANYWHERE)
    positions = np.array(sorted(found))
    return positions, np.array([found[p] for p in positions.tolist()])


_WORD = regex.compile(r"\S+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def overlap_starts(text: str, ends: list[int], overlap: int) -> np.ndarray:
    """Where a piece after a cut at each of ``ends`` begins: ``overlap`` characters back, or less to begin at a word.

    In scripts without spaces, and in text without breaks, any character begins a word.
    """
    if not overlap:
        return np.array(ends, dtype=np.int64)
    words = np.array([m.start() for m in _WORD.finditer(text)] + [len(text)])
    out = []
    for end, k in zip(ends, np.searchsorted(words, np.array(ends, dtype=np.int64) - overlap).tolist()):
        at = max(0, end - overlap)
        if words[k] < end and not _UNSPACED.match(text, at):
            at = int(words[k])
        out.append(_after(text, at, end))
    return np.array(out, dtype=np.int64)


def _after(text: str, at: int, end: int) -> int:
    while at < end and _JOINS.match(text, at):
        at += 1
    return at


def split(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, fresh, end) of each piece: the piece is text[start:end], and text[start:fresh] repeats the one before.

    The parts text[fresh:end] together are the text. Texts up to ``max_chars`` are one piece; the
    empty text has none. Raises ValueError where the overlap leaves no room.
    """
    if not 0 <= overlap < max_chars - 1:
        raise ValueError("overlap must be at least 0 and less than max_chars - 1")
    if len(text) <= max_chars:
        return [(0, 0, len(text))] if text else []
    room = max_chars - overlap
    at, penalty = boundaries(text, max(2, room // 3))
    n = len(at)
    starts = np.concatenate([[0], overlap_starts(text, at[1:-1].tolist(), overlap), [len(text)]])
    even = len(text) / np.ceil(len(text) / room)
    cost, back = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    cost[0] = 0.0
    lowest = np.searchsorted(starts, at - max_chars, side="left").tolist()
    scaled = at * (BALANCE**0.5 / even)
    beyond = (scaled - BALANCE**0.5).tolist()
    for j, (lo, far, weight) in enumerate(zip(lowest, beyond, penalty.tolist())):
        if lo >= j:
            continue
        off = far - scaled[lo:j]
        off *= off
        off += cost[lo:j]
        k = int(off.argmin())
        cost[j], back[j] = off[k] + weight, lo + k
    if not np.isfinite(cost[-1]):  # a cluster of marks longer than a piece: cut through it
        cuts = list(range(0, len(text), room)) + [len(text)]
        return [(max(0, a - overlap) if a else 0, a, b) for a, b in zip(cuts, cuts[1:])]
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = int(back[j])
    cuts = [0, *reversed(cuts)]
    return [(int(starts[a]), int(at[a]), int(at[b])) for a, b in zip(cuts, cuts[1:])]


def pieces(items: DataFrame, id_col: str, text_col: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, piece_no from 1, start_at, overlap, piece) of every item that has text.

    Items up to ``max_chars`` code points stay whole and never leave the JVM; longer ones are
    cut by ``split``. Null and empty texts have no pieces; a null id is kept. Rows with equal ids
    or texts are cut each for itself; columns other than the two named are not read.
    """
    if not 0 <= overlap < max_chars - 1:
        raise ValueError("overlap must be at least 0 and less than max_chars - 1")
    named = items.select(items[id_col].alias("id"), items[text_col].alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    length = F.length("text")
    short = named.where((length > 0) & (length <= max_chars)).select("id", F.lit(1).alias("piece_no"), F.lit(0).alias("start_at"), F.lit(0).alias("overlap"), F.col("text").alias("piece"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"]):
                for no, (start, fresh, end) in enumerate(split(text, max_chars, overlap), 1):
                    out.append((key, no, start, fresh - start, text[start:end]))
            yield pd.DataFrame(out, columns=["id", "piece_no", "start_at", "overlap", "piece"])

    long = named.where(length > max_chars).mapInPandas(cut_up, f"id {kind}, piece_no int, start_at int, overlap int, piece string")
    return short.unionByName(long).withColumnRenamed("id", id_col)
