"""Table functions that cut content into chunks with offsets, by kind of content."""

from __future__ import annotations

import csv
import io
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Limits:
    """Most and least tokens of a chunk, and tokens that it repeats of the one before."""

    most: int = 512
    least: int = 64
    overlap: int = 50


def tokens(text: str) -> int:
    return math.ceil(1.3 * len(text.split()))


_LEVELS = (re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?;])\s+"), re.compile(r"\s+"))
_HEADING = re.compile(r"^#{1,6}\s+(.+)$", re.M)


def _cut(text: str, a: int, b: int, level: int, most: int) -> list[tuple[int, int]]:
    """Spans of at most ``most`` tokens: split at the strongest separator, and weaker ones only within parts that are too large."""
    if tokens(text[a:b]) <= most:
        return [(a, b)]
    if level == len(_LEVELS):
        size = max(1, (b - a) * most // max(1, tokens(text[a:b])))
        return [(x, min(b, x + size)) for x in range(a, b, size)]
    out, start = [], a
    for m in _LEVELS[level].finditer(text, a, b):
        if m.end() > start and m.end() < b:
            out += _cut(text, start, m.end(), level + 1, most)
            start = m.end()
    return out + _cut(text, start, b, level + 1, most)


def text_chunks(text: str, limits: Limits = Limits()) -> list[dict]:
    """Chunks of prose: start and end are code points; the first heading within, else the last before it."""
    a, b = len(text) - len(text.lstrip()), len(text.rstrip())
    if a >= b:
        return []
    spans: list[list[int]] = []
    for x, y in _cut(text, a, b, 0, limits.most):
        if spans and tokens(text[spans[-1][0] : y]) <= limits.most:
            spans[-1][1] = y
        else:
            spans.append([x, y])
    small = 0
    while small < len(spans) and len(spans) > 1:  # a small chunk joins a neighbour where both fit
        if tokens(text[slice(*spans[small])]) < limits.least:
            for other in (small - 1, small + 1):
                if 0 <= other < len(spans):
                    lo, hi = min(small, other), max(small, other)
                    if tokens(text[spans[lo][0] : spans[hi][1]]) <= limits.most:
                        spans[lo : hi + 1] = [[spans[lo][0], spans[hi][1]]]
                        small = max(-1, lo - 1)
                        break
        small += 1
    heads = [(m.start(), m.group(1).strip()) for m in _HEADING.finditer(text)]
    out = []
    for i, (x, y) in enumerate(spans):
        start = x
        if i and limits.overlap:
            words = [m.start() for m in re.finditer(r"\S+", text[spans[i - 1][0] : x])]
            keep = max(1, int(limits.overlap / 1.3))
            start = spans[i - 1][0] + words[-min(keep, len(words))] if words else x
        inside = next((h for p, h in heads if x <= p < y), None)
        before = next((h for p, h in reversed(heads) if p < x), None)
        out.append({"start": start, "end": y, "text": text[start:y], "heading": inside or before, "address": None, "kind": "text"})
    return out


def json_chunks(text: str, limits: Limits = Limits()) -> list[dict]:
    """JSON cut into groups of members or items; each has the pointer of its first member."""
    value = json.loads(text)
    out: list[dict] = []

    def add(pairs: list[tuple[str, object]], many: bool) -> None:
        body = json.dumps(dict(pairs) if not many else [v for _, v in pairs], ensure_ascii=False)
        out.append({"start": None, "end": None, "text": body, "heading": None, "address": pairs[0][0] or "/", "kind": "json"})

    def walk(node: object, path: str) -> None:
        if not isinstance(node, (dict, list)) or tokens(json.dumps(node, ensure_ascii=False)) <= limits.most:
            add([(path, node)], False) if not isinstance(node, (dict, list)) else out.append({"start": None, "end": None, "text": json.dumps(node, ensure_ascii=False), "heading": None, "address": path or "/", "kind": "json"})
            return
        group: list[tuple[str, object]] = []
        many = isinstance(node, list)
        for key, child in enumerate(node) if many else node.items():
            at = f"{path}/{str(key).replace('~', '~0').replace('/', '~1')}"
            if tokens(json.dumps(child, ensure_ascii=False)) > limits.most:
                if group:
                    add(group, many)
                    group = []
                walk(child, at)
                continue
            if group and tokens(json.dumps([v for _, v in group] + [child], ensure_ascii=False)) > limits.most:
                add(group, many)
                group = []
            group.append((at, child))
        if group:
            add(group, many)

    walk(value, "")
    return out


def row_chunks(text: str, delimiter: str = ",", limits: Limits = Limits()) -> list[dict]:
    """Delimited rows as Markdown tables, each with the header, within the token limit."""
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if r]
    if not rows:
        return []
    cell = lambda c: c.replace("|", r"\|").replace("\n", " ")
    line = lambda r: "| " + " | ".join(map(cell, r)) + " |"
    head = [line(rows[0]), "|" + " --- |" * len(rows[0])]
    out: list[dict] = []
    group: list[str] = []
    first = 1
    for no, row in enumerate(rows[1:], 1):
        if group and tokens("\n".join(head + group + [line(row)])) > limits.most:
            out.append({"start": None, "end": None, "text": "\n".join(head + group), "heading": None, "address": f"rows {first}-{no - 1}", "kind": "rows"})
            group, first = [], no
        group.append(line(row))
    if group or len(rows) == 1:
        out.append({"start": None, "end": None, "text": "\n".join(head + group), "heading": None, "address": f"rows {first}-{len(rows) - 1}", "kind": "rows"})
    return out


class _Sections(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections: list[list] = [[None, []]]
        self.skip = 0
        self.head: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.head = []
        elif tag in ("p", "br", "li", "div", "tr", "section", "article"):
            self.sections[-1][1].append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch(r"h[1-6]", tag) and self.head is not None:
            self.sections.append([" ".join("".join(self.head).split()), []])
            self.head = None

    def handle_data(self, data):
        if not self.skip:
            (self.head if self.head is not None else self.sections[-1][1]).append(data)


def html_chunks(text: str, limits: Limits = Limits()) -> list[dict]:
    """Visible text of HTML by sections of headings, cut like prose."""
    parser = _Sections()
    parser.feed(text)
    out = []
    for heading, parts in parser.sections:
        body = re.sub(r"\n\s*\n\s*", "\n\n", re.sub(r"[ \t]+", " ", "".join(parts))).strip()
        for c in text_chunks(body, limits):
            out.append(c | {"start": None, "end": None, "heading": heading or c["heading"], "kind": "html"})
    return out


_SYMBOL = re.compile(r"^(?:@\w.*\n)*(?:pub(?:\(\w+\))? |export |async |static |public |private )*(?:def|class|fn|func|function|struct|enum|trait|impl|interface|type|module)\b[ \t]*([\w<>:]*)", re.M)


def code_chunks(text: str, limits: Limits = Limits()) -> list[dict]:
    """Code by its top-level definitions, all of it kept: what is too large is cut like prose, small ones are joined."""
    starts = [m for m in _SYMBOL.finditer(text) if not text[m.start() : m.start() + 1].isspace()]
    edges = sorted({0, *(m.start() for m in starts), len(text)})
    names = {m.start(): m.group(1) or None for m in starts}
    out: list[dict] = []
    for a, b in zip(edges, edges[1:]):
        for x, y in _cut(text, a, b, 0, limits.most):
            last = out[-1] if out else None
            if last and tokens(text[x:y]) < limits.least and tokens(text[last["start"] : y]) <= limits.most:
                last["end"], last["text"] = y, text[last["start"] : y]
            elif text[x:y].strip():
                out.append({"start": x, "end": y, "text": text[x:y], "heading": names.get(a), "address": None, "kind": "code"})
    return out


_LOG = re.compile(r"^\[?\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d")


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def detect(text: str, declared: str | None = None) -> str:
    """json, ndjson, diff, table, delimited, log, html or text, in this order; a declared type is only a hint."""
    t = text.strip()
    lines = [x for x in t.splitlines() if x.strip()][:50]
    if not lines:
        return "text"
    if t[0] in "{[" and _is_json(t):
        return "json"
    if len(lines) >= 2 and all(x.lstrip().startswith("{") and _is_json(x) for x in lines[:20]):
        return "ndjson"
    if any(x.startswith(("diff --git ", "@@ ")) for x in lines) and any(x.startswith(("--- ", "+++ ")) for x in lines):
        return "diff"
    if any(re.fullmatch(r"\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-*:?\s*", y) and "|" in x for x, y in zip(lines, lines[1:])):
        return "table"
    if re.match(r"(?is)<!doctype html|<html\b|<body\b", t):
        return "html"
    if delimiter(lines, bool(declared and re.search("csv|tab-separated|tsv", declared.lower()))):
        return "delimited"
    if len(lines) >= 3 and sum(bool(_LOG.match(x)) for x in lines) * 10 >= len(lines) * 6:
        return "log"
    return "text"


def delimiter(lines: list[str], declared: bool = False) -> str | None:
    """The first of comma, tab, semicolon and bar that gives 20 lines the same number of fields, two or more."""
    if len(lines) < (1 if declared else 2):
        return None
    for d in ",\t;|":
        counts = {len(r) for r in csv.reader(lines[:20], delimiter=d)}
        if len(counts) == 1 and counts.pop() >= 2:
            return d
    return None


def chunks_of(text: str, declared: str | None = None, language: str | None = None, limits: Limits = Limits()) -> list[dict]:
    """Chunks by the kind of the content."""
    if language and language not in ("markdown", "html", "json", "csv", "toml", "yaml"):
        return code_chunks(text, limits)
    kind = detect(text, declared)
    if kind == "json":
        return json_chunks(text, limits)
    if kind == "delimited":
        return row_chunks(text, delimiter([x for x in text.strip().splitlines() if x.strip()][:50], True) or ",", limits)
    if kind == "html":
        return html_chunks(text, limits)
    return [c | {"kind": kind} for c in text_chunks(text, limits)]


#: Chunkers that users add, by name; each takes (text, limits) and returns dicts like those above.
CHUNKERS: dict[str, Callable[[str, Limits], list[dict]]] = {"text": text_chunks, "json": json_chunks, "html": html_chunks, "code": code_chunks}


def chunk_table(items: DataFrame, id_col: str, text_col: str, limits: Limits = Limits(), declared: str | None = None, language: str | None = None, chunker: str | None = None) -> DataFrame:
    """(id_col, index, chunk_id, chunk_start, chunk_end, tokens, kind, heading, address, text); null and blank texts have no chunks."""
    given = items.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text", f"{f'`{declared}`' if declared else 'cast(null as string)'} as declared", f"{f'`{language}`' if language else 'cast(null as string)'} as language").where("text is not null")
    own = CHUNKERS[chunker] if chunker else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, d, lang in zip(batch["id"], batch["text"], batch["declared"], batch["language"]):
                for i, c in enumerate(own(text, limits) if own else chunks_of(text, d, lang, limits)):
                    rows.append((key, i, f"{key}:{i}", c["start"], c["end"], tokens(c["text"]), c["kind"], c["heading"], c["address"], c["text"]))
            frame = pd.DataFrame(rows, columns=["id", "index", "chunk_id", "chunk_start", "chunk_end", "tokens", "kind", "heading", "address", "text"])
            yield frame.astype({"chunk_start": "Int64", "chunk_end": "Int64"})

    kind = items.schema[id_col].dataType.simpleString()
    return given.mapInPandas(run, f"id {kind}, index int, chunk_id string, chunk_start long, chunk_end long, tokens int, kind string, heading string, address string, text string").withColumnRenamed("id", id_col)
