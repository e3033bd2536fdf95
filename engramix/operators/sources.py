"""Sources and their chunks: ranges, owners, lineage, citations, outlines and reads by address."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix.operators.chunking import tokens


def line_chunks(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, index from 0, text): every line of each text as a chunk; null and empty texts have none."""
    kept = items.where(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    return kept.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("index", "text"))


def chunk_range(chunks: DataFrame, first: int, last: int, owners: DataFrame | None = None, owner: str = "artifact_id") -> DataFrame:
    """Chunks with an index from ``first`` to ``last``, both included; with ``owners`` only theirs."""
    found = chunks.where(F.col("index").between(first, last))
    return found if owners is None else found.join(owners.select(owner).distinct(), owner, "left_semi")


def first_messages(messages: DataFrame, key: str, at: str, tie: str, *columns: str) -> DataFrame:
    """One row for each message: of several deliveries the one with the smallest (time, tie); combined before the shuffle."""
    return messages.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(at).isNull().alias("late"), at, tie, *columns)).alias("m")).select(key, F.col(f"m.{at}").alias(at), F.col(f"m.{tie}").alias(tie), *[F.col(f"m.{c}").alias(c) for c in columns])


def owners(artifacts: DataFrame) -> DataFrame:
    """``artifacts`` with ``owner``: the message that triggered them, else their session, else themselves."""
    return artifacts.withColumn("owner", F.when(F.col("triggered_by_message_id").isNotNull(), "message").when(F.col("session_id").isNotNull(), "session").otherwise("artifact"))


def citations(items: DataFrame, query: str, source: str, score: str, tie: str) -> DataFrame:
    """(query, source, place): the distinct sources of each answer in order of their best item; null sources aren't cited."""
    best = items.where(F.col(source).isNotNull()).groupBy(query, source).agg(F.min(F.struct(-F.round(score, 9), F.col(tie))).alias("b"))
    listed = best.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("b", source))).alias("all"))
    return listed.select(query, F.posexplode("all").alias("place", "x")).select(query, F.col(f"x.{source}").alias(source), (F.col("place") + 1).alias("place"))


def escape_token(key: str) -> str:
    """A key as part of a JSON pointer."""
    return key.replace("~", "~0").replace("/", "~1")


def outline_of(text: str, depth: int = 2, most: int = 50) -> list[tuple[str, str]]:
    """(address, what is there): the members of a JSON text down to ``depth``, else the headings with their lines; at most ``most``."""
    out: list[tuple[str, str]] = []

    def kind(node) -> str:
        if isinstance(node, dict):
            return f"object of {len(node)}"
        return f"array of {len(node)}" if isinstance(node, list) else type(node).__name__

    def walk(node, path: str, level: int) -> None:
        if level > depth or len(out) >= most:
            return
        for key, child in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
            at = f"{path}/{escape_token(str(key))}"
            if len(out) < most:
                out.append((at, kind(child)))
                walk(child, at, level + 1)

    try:
        value = json.loads(text)
    except ValueError:
        value = None
    if isinstance(value, (dict, list)):
        walk(value, "", 1)
        return out
    for no, line in enumerate(text.split("\n"), 1):
        m = re.match(r"#{1,6}\s+(.+)", line)
        if m and len(out) < most:
            out.append((f"lines {no}-{no}", m.group(1).strip()))
    return out


def line_of(text: str, at: int) -> int:
    """Number of the line, from 1, in which the character at ``at`` stands."""
    return text.count("\n", 0, max(0, at)) + 1


def span_of(text: str, address: str) -> tuple[int, int] | None:
    """(start, end) of 'lines A-B', 'records A-B' (lines of text that isn't blank), 'rows A-B' (a header comes first), or a JSON pointer; None if it isn't there."""
    m = re.fullmatch(r"(lines|records|rows) (\d+)(?:-(\d+))?", address.strip())
    if m:
        kind, a, b = m.group(1), int(m.group(2)), int(m.group(3) or m.group(2))
        starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
        spans = [(s, e) for s, e in zip(starts, [*starts[1:], len(text)])]
        if kind != "lines":
            spans = [s for s in spans if text[slice(*s)].strip()][1 if kind == "rows" else 0 :]
        if not 1 <= a <= b or a > len(spans):
            return None
        return spans[a - 1][0], spans[min(b, len(spans)) - 1][1]
    if address.startswith("/") or address == "":
        decoder = json.JSONDecoder()
        at, end = 0, len(text)
        for token in (t.replace("~1", "/").replace("~0", "~") for t in address.split("/")[1:]):
            child = _member(decoder, text, at, token)
            if child is None:
                return None
            at, end = child
        return at, end
    return None


_BLANK = re.compile(r"\s*")


def _member(decoder: json.JSONDecoder, text: str, at: int, token: str) -> tuple[int, int] | None:
    """Span of the member or item ``token`` of the JSON value that begins at ``at``."""
    skip = lambda i: _BLANK.match(text, i).end()
    at = skip(at)
    if text[at : at + 1] not in ("{", "["):
        return None
    many, no, at = text[at] == "[", 0, skip(at + 1)
    try:
        while text[at] not in "]}":
            key = str(no)
            if not many:
                key, at = decoder.raw_decode(text, at)
                at = skip(at)
                if text[at] != ":":
                    return None
                at = skip(at + 1)
            _, end = decoder.raw_decode(text, at)
            if key == token:
                return at, end
            no, at = no + 1, skip(end)
            if text[at] == ",":
                at = skip(at + 1)
    except (ValueError, IndexError):
        return None
    return None


def cut_to_tokens(text: str, most: int) -> tuple[str, bool]:
    """(the longest beginning of at most ``most`` tokens, whether more follows); it ends at a line break where there is one."""
    if tokens(text) <= most:
        return text, False
    keep = 0
    for n, m in enumerate(re.finditer(r"\S+\s*", text), 1):
        if tokens("x " * n) > most:
            break
        keep = m.end()
    line = text.rfind("\n", 0, keep) + 1
    return text[: line or keep], True


def read_ranges(items: DataFrame, wanted: DataFrame, id_col: str, text_col: str, most: int = 512) -> DataFrame:
    """(id_col, address, line, text, more): the part of each text that ``wanted`` (id_col, address) names, cut to ``most`` tokens.

    Addresses that aren't there, null texts and unknown ids give no row.
    """
    kind = items.schema[id_col].dataType.simpleString()
    both = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").join(wanted.select(F.col(id_col).alias("id"), "address"), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, address in zip(batch["id"], batch["t"], batch["address"]):
                span = span_of(text, address)
                if span:
                    part, more = cut_to_tokens(text[span[0] : span[1]], most)
                    out.append((key, address, line_of(text, span[0]), part, more))
            yield pd.DataFrame(out, columns=[id_col, "address", "line", "text", "more"])

    return both.mapInPandas(run, f"{id_col} {kind}, address string, line int, text string, more boolean")


def outlines(items: DataFrame, id_col: str, text_col: str, depth: int = 2, most: int = 50) -> DataFrame:
    """(id_col, place, address, entry): the outline of each text; null texts have none."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, n, a, e) for key, text in zip(batch["id"], batch["t"]) for n, (a, e) in enumerate(outline_of(text, depth, most), 1)]
            yield pd.DataFrame(rows, columns=[id_col, "place", "address", "entry"])

    return items.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").mapInPandas(run, f"{id_col} {kind}, place int, address string, entry string")


def refreshed(existing: DataFrame, fresh: DataFrame, owner: str) -> DataFrame:
    """(owner, index, action, text): which chunks of each owner stay, are removed or are written when its text has grown.

    Chunks before the first that differs are kept; all old ones from there on are removed and the fresh ones written.
    """
    a = existing.select(owner, "index", F.col("text").alias("old"))
    b = fresh.select(owner, "index", F.col("text").alias("new"))
    both = a.join(b, [owner, "index"], "full")
    breaks = both.where(~F.col("old").eqNullSafe(F.col("new"))).groupBy(owner).agg(F.min("index").alias("at"))
    marked = both.join(breaks, owner, "left")
    kept = F.col("at").isNull() | (F.col("index") < F.col("at"))
    steps = F.when(kept, F.array(F.struct(F.lit("keep").alias("action"), F.col("old").alias("text")))).otherwise(
        F.filter(F.array(F.struct(F.lit("remove").alias("action"), F.col("old").alias("text")), F.struct(F.lit("write").alias("action"), F.col("new").alias("text"))), lambda x: x["text"].isNotNull())
    )
    return marked.select(owner, "index", F.explode(steps).alias("s")).select(owner, "index", "s.action", "s.text")
