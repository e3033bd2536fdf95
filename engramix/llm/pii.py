"""Personal data in free text: found, and replaced by placeholders of its type.

A skip-chain conditional random field labels candidates: whole mail addresses, addresses and
numbers, and single words of names. Neighbouring words of a name are linked in a chain, repeated or
equally spelled candidates of a text by skip links, and loopy message passing settles all labels of a
text together. The weights are trained here, on all rows: numbers from those whose kind a word
before them names, words of names from recognised spans of persons, firms and places. Rows with the
same features are counted first, so that a fit reads each kind of row once, with its count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix.llm import pii_rules as R
from engramix.llm.name_forms import TITLES
from engramix.session import cut, discard

#: Distinct partners that make a word of persons a given name, and of firms a word of firms.
PARTNERS = 4
#: A word is common that is written small more than once in so many texts, and more than twice.
COMMON = 3000
#: Distinct rows up to which a fit is made on the driver; of more, every round sums the gradient over the executors.
HELD = 200_000
#: Stands between the features of a row.
SEP = "\x1f"


#: What a placeholder of any style names, by a part of its letters; the first that fits counts.
PLACEHOLDERS = (("mail", R.EMAIL), ("phone", R.PHONE), ("tel", R.PHONE), ("address", R.ADDRESS), ("person", R.NAME), ("name", R.NAME), ("id", R.ID))


def replaced(original: str, redacted: str) -> list[tuple[int, int, int]]:
    """(start, end, label) in ``original`` of what placeholders in ``redacted`` stand for; empty where the texts differ otherwise."""
    out, at, last, label = [], 0, 0, None
    for m in [*R._PLACEHOLDER.finditer(redacted), None]:
        part = redacted[last : m.start() if m else len(redacted)]
        found = original.find(part, at) if part else at if m else len(original)
        if found < 0 or (label is None and found != at):
            return []
        if label is not None:
            if m is None and part:
                found = len(original) - len(part)
                if found < at or original[found:] != part:
                    return []
            out.append((at, found, label))
        at = found + len(part)
        if m:
            letters = "".join(c for c in m.group().lower() if c.isalpha())
            label = next((kind for word, kind in PLACEHOLDERS if word in letters), R.OTHER)
            last = m.end()
    return [(a, b, k) for a, b, k in out if b > a and k != R.OTHER]


def _whole_weights(examples: list[tuple[list[str], bool]], counts: list[int] | None = None, hold: float = 10.0) -> dict[str, float]:
    """Weights of whole candidates by logistic regression; those from before count as ``hold`` labels."""
    index = {f: i for i, f in enumerate(sorted({*R.WHOLE, *(f for fs, _ in examples for f in fs)}))}
    x = np.zeros((len(examples), len(index)))
    for row, (features, _) in zip(x, examples):
        for f in features:
            row[index[f]] += 1
    y = np.array([right for _, right in examples], dtype=float)
    n = np.ones(len(examples)) if counts is None else np.array(counts, dtype=float)
    w = R.settled(lambda v: R.likelihood(x, np.zeros(len(x)), y, n, v), np.array([R.WHOLE.get(f, 0.0) for f in index]), hold)
    return {f: float(w[i]) for f, i in index.items()}


def _gradient(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, counts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the loss of a multinomial logistic regression; feature ``cols[k]`` is one of row ``rows[k]``."""
    logits = np.stack([np.bincount(rows, w[cols, c], len(labels)) for c in range(w.shape[1])], axis=1)
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(labels)), labels] -= 1
    p *= counts[:, None]
    return np.stack([np.bincount(cols, p[rows, c], len(w)) for c in range(w.shape[1])], axis=1)


def _softmax(gradient, size: int, classes: int, total: float, rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights of a multinomial logistic regression over sparse binary features, of which ``gradient`` sums the rows."""
    w = np.zeros((size, classes))
    grad2 = np.full((size, classes), 1e-6)
    for _ in range(rounds):
        grad = gradient(w) / total * 100 + decay * w
        grad2 += grad * grad
        w -= rate * grad / np.sqrt(grad2)
    return w


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values of the rows' lists."""
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.asarray(x, dtype=np.int64) for x in lists])


def _fit(rows: DataFrame, classes: int) -> dict[str, np.ndarray]:
    """{feature: weights} from rows (key: features joined by SEP, label, n: how often), all of them at any size."""
    rows = cut(rows.where("n > 0").groupBy("key", "label").agg(F.sum("n").cast("double").alias("n")))
    distinct, total = rows.agg(F.count("*"), F.sum("n")).first()
    if not distinct:
        return {}
    names = sorted(r["f"] for r in rows.select(F.explode(F.split("key", SEP)).alias("f")).distinct().collect())
    index = {f: i for i, f in enumerate(names)}
    if distinct <= HELD:
        held = rows.orderBy("key", "label").toPandas()
        at, cols = _flat([[index[f] for f in key.split(SEP)] for key in held["key"]])
        w = _softmax(lambda v: _gradient(at, cols, held["label"].to_numpy(), held["n"].to_numpy(), v), len(names), classes, total)
    else:
        shared = rows.sparkSession.sparkContext.broadcast(index)

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"cols": [[shared.value[f] for f in key.split(SEP)] for key in batch["key"]], "label": batch["label"], "n": batch["n"]})

        coded = cut(rows.mapInPandas(encode, "cols array<int>, label int, n double"))

        def gradient(v: np.ndarray) -> np.ndarray:
            now = rows.sparkSession.sparkContext.broadcast(v)

            def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                g = np.zeros_like(now.value)
                for batch in batches:
                    if len(batch):
                        g += _gradient(*_flat(batch["cols"].tolist()), batch["label"].to_numpy(), batch["n"].to_numpy(), now.value)
                i, c = np.nonzero(g)
                yield pd.DataFrame({"i": i, "c": c, "g": g[i, c]})

            found = coded.mapInPandas(sums, "i int, c int, g double").groupBy("i", "c").agg(F.sum("g").alias("g")).toPandas()
            now.destroy()
            out = np.zeros_like(v)
            out[found["i"], found["c"]] = found["g"]
            return out

        w = _softmax(gradient, len(names), classes, total)
        discard(coded)
    discard(rows)
    return {f: w[i] for f, i in index.items()}


def _frame(total: Counter, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(*key, n) for key, n in total.items()], columns=columns)


_COUNTED = ["kind", "key", "low", "label", "n"]


def _number_rows(text: str, m, label: int) -> list[tuple]:
    """Rows of a number of known kind, with and without the words around."""
    fs = R.number_features(text, *m.span())
    return [("number", SEP.join(x), "", (R.OTHER, R.PHONE, R.ID).index(label)) for x in (fs, [f for f in fs if f[0] in "sn"])]


def _counts(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(kind, key, low, label, n) over all rows: words of texts (label 1: small) and of spans of persons and firms, numbers that a word names, and texts."""

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, total = Counter(), Counter()
            for t in batch["t"]:
                words.update(R._TOKEN.findall(t))
                if R.has_numbers(t):
                    last = 0
                    for m in R._NUMBER.finditer(t):
                        label = R.seed_of(t, *m.span(), last)
                        last = m.end()
                        if label is not None:
                            total.update(_number_rows(t, m, label))
            for w, n in words.items():
                total["text", w, w.lower(), int(w.islower())] += n
            total["texts", "", "", 0] += len(batch)
            yield _frame(total, _COUNTED)

    def of_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = Counter()
            for text, kind, n in zip(batch["text"], batch["entity_type"], batch["n"].tolist()):
                tokens = R._TOKEN.findall(text)
                if kind in ("ORG", "LOC"):
                    for t in tokens:
                        total["word", t, t.lower(), 0] += n
                for t in tokens:
                    if t.lower() not in TITLES:
                        t = t.removesuffix("'s").removesuffix("’s")
                        total["person" if kind == "PERSON" else "firm", t, t.lower(), 0] += n
            yield _frame(total, _COUNTED)

    schema = "kind string, key string, low string, label int, n long"
    known = spans.where("text is not null and entity_type in ('PERSON', 'ORG', 'LOC')").groupBy("text", "entity_type").agg(F.count("*").alias("n"))
    both = texts.where("t is not null").select("t").mapInPandas(of_texts, schema).unionByName(known.mapInPandas(of_spans, schema))
    return cut(both.groupBy("kind", "key", "low", "label").agg(F.sum("n").alias("n")))


def _word_rows(counts: DataFrame, lows: DataFrame, lists: tuple) -> DataFrame:
    """(key, label, n): words of persons' spans are names; those of other spans and of texts, where no span has them, aren't."""
    shared = counts.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value[2]
        for batch in batches:
            total = Counter()
            for kind, key, p, f, n in zip(batch["kind"], batch["key"], batch["p"], batch["f"], batch["n"].tolist()):
                if kind == "text":
                    if len(key) < 2 or not (key[0].isupper() and not p or key in common):
                        continue
                    kind = "capital" if key[0].isupper() else "small"
                elif kind == "word" and p > f:
                    continue
                if key:
                    total[kind, SEP.join(R.token_features(key, *shared.value)), int(kind == "person")] += n
            yield _frame(total, ["kind", "key", "label", "n"])

    words = counts.where("kind in ('person', 'word', 'text')").join(lows.select("low", "p", "f"), "low").select("kind", "key", "p", "f", "n")
    rows = cut(words.mapInPandas(run, "kind string, key string, label int, n long").groupBy("kind", "key", "label").agg(F.sum("n").alias("n")))
    # Words of texts are many more than those of spans: with a capital they weigh as much together, and the common ones, many and alike, a quarter of that.
    of = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    spans, capital, small = of.get("person", 0) + of.get("word", 0), of.get("capital", 0), of.get("small", 0)
    share = min(1.0, spans / capital) if spans and capital else 1.0
    least = min(1.0, share * capital / 4 / small) if small else 1.0
    return rows.select("key", "label", (F.col("n") * F.when(F.col("kind") == "capital", share).when(F.col("kind") == "small", least).otherwise(1.0)).alias("n"))


def _examples(labelled: DataFrame) -> DataFrame:
    """(kind, key, low, label, n): numbers, mail addresses and addresses in the place of placeholders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = Counter()
            for text, xs in zip(batch["content"], batch["xs"]):
                for x in xs:
                    for a, b, kind in replaced(text, x["view"]) if x["view"] else ():
                        for pattern, own, spell in ((R._EMAIL, R.EMAIL, R.mail_features), (R._ADDRESS, R.ADDRESS, R.place_features)):
                            total.update(("whole", SEP.join(spell(m.group())), "", int(kind == own)) for m in pattern.finditer(text) if m.start() < b and a < m.end())
                        if kind in (R.PHONE, R.ID):
                            for m in R._NUMBER.finditer(text):
                                if m.start() < b and a < m.end():
                                    total.update(_number_rows(text, m, kind))
            yield _frame(total, _COUNTED)

    return cut(labelled.where(F.exists("xs", lambda x: x["view"].isNotNull())).mapInPandas(run, "kind string, key string, low string, label int, n long").groupBy("kind", "key", "low", "label").agg(F.sum("n").alias("n")))


def train(texts: DataFrame, spans: DataFrame, people: DataFrame, labelled: DataFrame | None = None) -> R.Model:
    """A model from all rows of ``texts`` (column t), ``spans`` (text, entity_type) and ``people`` (display_name).

    Given names are words of persons with at least PARTNERS different partners. ``labelled`` has texts (content) and what is
    known of each, as ``xs``, a list of structs: view, the text with placeholders, so that what was replaced labels candidates
    of all types; or kind, first and last, a span of words. With the names that were replaced the spans train the weights of
    the chain and skip links.
    """
    named = spans.where("text is not null and entity_type = 'PERSON'").select("text").unionByName(people.where("display_name is not null").select(F.col("display_name").alias("text")))
    words = F.filter(F.split(F.lower(F.regexp_replace("text", r"\(.*?\)|['’]s\b|[.,;]", " ")), r"[\s ]+"), lambda x: F.length(x) > 1)
    partners = named.select(words.alias("w")).where(F.size("w") == 2).select(F.explode(F.array(F.struct(F.col("w")[0].alias("a"), F.col("w")[1].alias("b")), F.struct(F.col("w")[1].alias("a"), F.col("w")[0].alias("b")))).alias("p")).select("p.*").distinct()
    known = partners.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= PARTNERS).select("a")

    counts = _counts(texts, spans)
    n_of = lambda test: F.sum(F.when(F.expr(test), F.col("n")).otherwise(0))
    lows = cut(counts.where("kind not in ('number', 'texts')").groupBy("low").agg(n_of("kind = 'person'").alias("p"), n_of("kind = 'firm'").alias("f"), n_of("kind = 'text' and label = 1").alias("s"), n_of("kind = 'text' and label = 0").alias("t")))
    all_given = {r["a"]: r["verb"] for r in known.join(lows.select(F.col("low").alias("a"), (F.col("s") > 3 * F.col("t")).alias("verb")), "a", "left").collect() if r["a"] not in TITLES}
    given = frozenset(w for w, verb in all_given.items() if not verb)  # 'will', 'may': words first
    firm = frozenset(r["low"] for r in lows.where((F.col("f") >= PARTNERS) & (F.col("f") > 2 * F.col("p"))).select("low").collect()) - all_given.keys()
    n_texts = counts.where("kind = 'texts'").agg(F.sum("n")).first()[0] or 0
    common = frozenset(r["low"] for r in lows.where((F.col("s") > 2) & (F.col("s") * COMMON > n_texts)).select("low").collect()) - given

    rows = _word_rows(counts, lows, (given, firm, common))
    word = {f: float(w[1] - w[0]) for f, w in _fit(rows, 2).items()}
    numbers = counts.where("kind = 'number'").select("key", "label", "n")
    whole = dict(R.WHOLE)
    if labelled is not None:
        examples = _examples(labelled)
        numbers = numbers.unionByName(examples.where("kind = 'number'").select("key", "label", "n"))
        found = examples.where("kind = 'whole'").orderBy("key", "label").collect()  # as many as there are features of them
        if found:
            whole = _whole_weights([(r["key"].split(SEP), bool(r["label"])) for r in found], [r["n"] for r in found])
    model = R.Model(given, firm, common, _fit(numbers, 3), word, whole)
    if labelled is not None:
        model.links = _fit_links(labelled, model)
    discard(counts, lows)
    return model


def _known_names(text: str, found: list, spans: list) -> list[tuple[int, int, bool]]:
    """(start, end, whether a name) of what was replaced in a text and of its spans (kind, first and last word) of persons, firms and places."""
    out = [(a, b, True) for a, b, kind in found if kind == R.NAME]
    words = [m.span() for m in R.WORDS.finditer(text)] if spans else []
    for kind, first, last in spans:
        if kind in ("PERSON", "ORG", "LOC") and 0 <= first < last <= len(words) and last - first > (kind == "PERSON"):
            out.append((words[first][0], words[last - 1][1], kind == "PERSON"))
    return out


def _link_rows(known_of: dict[str, list[tuple[int, int, bool]]], model: R.Model) -> np.ndarray:
    """What the words of known names in some texts tell of the links (see ``link_rows``)."""
    nodes = R.Nodes()
    known: dict[int, bool] = {}
    for d, (text, spans) in enumerate(sorted(known_of.items())):
        begin = len(nodes.doc)
        R.add_nodes(nodes, d, text, model)
        for i in range(begin, len(nodes.doc)):
            if nodes.scores[i][R.NAME] > R._NEVER:
                inside = [is_name for a, b, is_name in spans if a <= nodes.start[i] and nodes.end[i] <= b]
                if inside and len(nodes.key[i]) > 1 and nodes.key[i] not in TITLES:
                    known[i] = all(inside)
    return R.link_rows(nodes, known, model)


def _links(labelled: list, marked: list, model: R.Model) -> tuple[float, float, float]:
    """Link weights from names that were replaced and from spans of persons, firms and places in their texts."""
    known_of: dict[str, list[tuple[int, int, bool]]] = {}
    for text, found in labelled:
        known_of.setdefault(text, []).extend(_known_names(text, found, []))
    for text, *span in marked:
        known_of.setdefault(text, []).extend(_known_names(text, [], [span]))
    rows = _link_rows(known_of, model)
    return R.fit_links(lambda w: R.link_sums(rows, w), model) if len(rows) else model.links


def _fit_links(labelled: DataFrame, model: R.Model) -> tuple[float, float, float]:
    """The same from all rows of ``labelled``."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    columns = ["unary", "names", "sides", "same", "y"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known_of = {}
            for text, xs in zip(batch["content"], batch["xs"]):
                found = [f for x in xs if x["view"] for f in replaced(text, x["view"])]
                known = _known_names(text, found, sorted({(x["kind"], int(x["first"]), int(x["last"])) for x in xs if x["kind"]}))
                if known:
                    known_of.setdefault(text, []).extend(known)
            yield _frame(Counter(map(tuple, _link_rows(known_of, shared.value)[:, :5].tolist())), [*columns, "n"])

    rows = cut(labelled.mapInPandas(run, "unary double, names double, sides double, same double, y double, n long").groupBy(*columns).agg(F.sum("n").alias("n")))
    distinct = rows.count()
    if not distinct:
        return model.links
    if distinct <= HELD:
        held = rows.orderBy(*columns).toPandas().to_numpy(dtype=float)
        return R.fit_links(lambda w: R.link_sums(held, w), model)

    def sums(w: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame(enumerate(R.link_sums(batch.to_numpy(dtype=float), w)), columns=["i", "v"])

        total = np.zeros(13)
        for r in rows.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            total[r["i"]] = r["v"]
        return total

    return R.fit_links(sums, model)


def spans_of(rows: DataFrame, id_col: str, text_col: str, model: R.Model) -> DataFrame:
    """(id_col, start, end, pii_type, pii_value) of each piece of personal data; positions are code points from 0.

    Null and empty texts have none; each row counts for itself, equal ids and texts too; other columns aren't read.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["id"].tolist(), batch["text"].tolist()
            found = [(ids[d], a, b, R.LABELS[label], texts[d][a:b]) for d, a, b, label in R.find(texts, shared.value)]
            yield pd.DataFrame(found, columns=[id_col, "start", "end", "pii_type", "pii_value"])

    named = rows.select(rows[id_col].alias("id"), rows[text_col].alias("text")).where("text is not null")
    return named.mapInPandas(run, f"{id_col} {kind}, start int, end int, pii_type string, pii_value string")


def redact(rows: DataFrame, id_col: str, text_col: str, model: R.Model) -> DataFrame:
    """(id_col, text_col): every row with its text, in which personal data is replaced by '[EMAIL]', '[PHONE]' and so on."""
    kind = rows.schema[id_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if pd.isna(t) else t for t in batch["text"].tolist()]
            found: dict[int, list] = {}
            for d, a, b, label in R.find(texts, shared.value):
                found.setdefault(d, []).append((a, b, label))
            for d, spans in found.items():
                t, at, out = texts[d], 0, []
                for a, b, label in sorted(spans):
                    if a >= at:
                        out += [t[at:a], f"[{R.LABELS[label].upper()}]"]
                        at = b
                texts[d] = "".join([*out, t[at:]])
            yield pd.DataFrame({id_col: batch["id"], text_col: texts})

    return rows.select(rows[id_col].alias("id"), rows[text_col].alias("text")).mapInPandas(run, f"{id_col} {kind}, {text_col} string")
