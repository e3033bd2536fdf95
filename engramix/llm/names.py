"""Variant spellings of names, linked by entity.

1. Each distinct string is reduced to a form: folded tokens without order, titles, notes, legal
   forms and single letters. Strings of one form are one class, whatever its size.
2. Forms are blocked by what two forms of one entity must share: a whole token (or nickname of the same
   name) and, in names of three or four words, the first letters of all others but one. A block
   of any size is compared whole: cut into slices, and each slice with each other as a group of its own.
3. Forms within a block are compared token by token by longest-common-subsequence ratio; in large
   ones the letters of the token left over are compared first.
4. Names of initials ('Gray, K.G.', 'Wadan FH'), and names without the words in the middle of others, are attached to the one
   entity they can stand for. Names of one word count only where one of their spellings has a legal form.
5. Links are closed to entities.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.llm.name_forms import parse, spellings, stem
from engramix.operators.components import components
from engramix.session import cut

#: Forms of a slice of a block, and least share of a token's forms that stand beside the same form in the other spelling.
SLICE, BESIDE = 1000, 0.5


def forms_of(names: DataFrame) -> DataFrame:
    """(name, form, initials, words, in_order, legal): ``words`` are the sorted long tokens of the name and ``form`` the same joined by blanks.

    ``initials`` are its single letters or, of a token of two or three letters that stands last,
    its letters ('Wadan FH'). Names without letters have no row.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"]:
                tokens, legal = parse(name)
                words = [t for t in tokens if len(t) > 1]
                initials = "".join(t for t in tokens if len(t) == 1)
                if len(words) == 2 and not initials and 2 <= len(words[1]) <= 3 and len(words[0]) > 4 and words[1].upper() in name:
                    words, initials = words[:1], "#" + words[1]
                if words:
                    rows.append((name, " ".join(sorted(words)), initials, sorted(words), " ".join(words), legal))
            yield pd.DataFrame(rows, columns=["name", "form", "initials", "words", "in_order", "legal"])

    return names.mapInPandas(read, "name string, form string, initials string, words array<string>, in_order string, legal boolean")


def _block_keys(words: list[str]) -> Iterator[tuple[str, str]]:
    """(key, token left over): any two forms that ``spellings`` links share a key in which the pair that differs in spelling is left over.

    Equal tokens and nicknames have one ``stem``; other short forms begin alike. Names of more than
    four words have only a whole token as key, and no token left over.
    """
    for j, whole in enumerate(words):
        if len(words) > 4:
            yield f"{len(words)}|{stem(whole)}", ""
            continue
        for i, left in enumerate(words):
            if i != j:
                letters = [{w[0], stem(w)[0]} for k, w in enumerate(words) if k not in (i, j)]
                for some in {"".join(sorted(x)) for x in itertools.product(*letters)}:
                    yield f"{len(words)}|{stem(whole)}|{some}", left


def _keys(forms: DataFrame) -> DataFrame:
    def emit(batches):
        for batch in batches:
            out = []
            for form, words in zip(batch["form"], batch["words"]):
                out += [(form, key, left) for key, left in sorted(set(_block_keys(list(words))))]
            yield pd.DataFrame(out, columns=["form", "key", "left"])

    return forms.select("form", "words").mapInPandas(emit, "form string, key string, left string")


def _groups(forms: DataFrame) -> DataFrame:
    """(i, j, m): for each pair of slices of a block, the forms of both with their slice."""
    keyed = cut(_keys(forms))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / SLICE).alias("slices"))
    placed = keyed.join(sizes, "key").withColumn("at", F.pmod(F.xxhash64("form"), "slices"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    spread = spread.withColumn("i", F.least("at", "other")).withColumn("j", F.greatest("at", "other"))
    return spread.groupBy("key", "i", "j").agg(F.collect_list(F.struct("form", "left", "at")).alias("m")).where(F.size("m") > 1).select("i", "j", "m")


def _near(items: list[tuple[str, str, int]], across: bool, least: float) -> Iterator[tuple[str, str]]:
    """Pairs of forms whose tokens left over may be spellings or short forms of each other, by their letters only."""
    if len(items) <= 12 or not items[0][1]:
        yield from ((x[0], y[0]) for x, y in itertools.combinations(items, 2) if x[2] != y[2] or not across)
        return
    masks = np.array([functools.reduce(operator.or_, (1 << ord(c) % 64 for c in x[1])) for x in items], dtype=np.uint64)
    sizes = np.array([len(x[1]) for x in items])
    stems = np.array([hash(stem(x[1])) for x in items])
    sides = np.array([x[2] for x in items])
    for r in range(len(items) - 1):
        mine, rest = masks[r], masks[r + 1 :]
        most = np.maximum(2, (1 - least) * (sizes[r] + sizes[r + 1 :]) + 1e-9)
        both = mine & rest
        may = (np.bitwise_count(mine ^ rest) <= most) | (both == mine) | (both == rest) | (stems[r] == stems[r + 1 :])
        if across:
            may &= sides[r] != sides[r + 1 :]
        yield from ((items[r][0], items[r + 1 + k][0]) for k in np.flatnonzero(may))


def link_forms(forms: DataFrame, least: float) -> DataFrame:
    """(src, dst): forms that name the same entity, from comparisons within blocks.

    Two spellings of a token are one word if at least BESIDE of the forms of one of them stand beside the same
    form in the other spelling; a word of its own ('thomas' and 'tomas') has mostly other partners. A share doesn't change as the table grows.
    """
    def compare(batches):
        for batch in batches:
            seen, out = set(), []
            for i, j, members in zip(batch["i"], batch["j"], batch["m"]):
                items = sorted((m["form"], m["left"], m["at"]) for m in members)
                for f, g in _near(items, i != j, least):
                    if f == g or (f, g) in seen:
                        continue
                    seen.add((f, g))
                    out += [(f, g, *(way or (None, None))) for way in spellings(tuple(f.split(" ")), tuple(g.split(" ")), least)]
            yield pd.DataFrame(out, columns=["src", "dst", "t", "u"])

    return _confirmed(forms, cut(_groups(forms).mapInPandas(compare, "src string, dst string, t string, u string").distinct()))


def _confirmed(forms: DataFrame, found: DataFrame) -> DataFrame:
    """(src, dst) of the pairs that differ in no spelling, or in two spellings of one word."""
    counts = forms.select("form", F.explode(F.array_distinct("words")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    typed = found.where("t is not null")
    turned = typed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("u").alias("t"), F.col("t").alias("u"))
    beside = typed.unionByName(turned).groupBy("t", "u").agg(F.count_distinct("src").alias("k")).join(counts, "t")
    one = beside.where(F.col("k") >= BESIDE * F.col("n")).select(F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y")).distinct()
    kept = typed.select("src", "dst", F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y")).join(one, ["x", "y"]).select("src", "dst")
    return found.where("t is null").select("src", "dst").unionByName(kept).distinct()


def _shortened(parsed: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` with forms of two words joined to the one entity whose longer names begin and end with them ('Maria Lopez', 'Maria Elena Lopez').

    A form that fits several entities stays by itself.
    """
    order = F.split("in_order", " ")
    long = parsed.where("size(words) > 2").join(parts, "form").select(F.array_join(F.array_sort(F.array(order[0], F.element_at(order, -1))), " ").alias("short"), F.col("component").alias("target")).distinct()
    one = long.groupBy("short").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1")
    edges = parts.join(one, parts["form"] == one["short"]).where("component <> target").select(F.col("component").alias("src"), F.col("target").alias("dst")).distinct()
    merged = components(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))), cut(edges))
    return parts.join(merged.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left").select("form", F.coalesce("whole", "component").alias("component"))


def entities(names: DataFrame, least: float = 0.8) -> DataFrame:
    """(name, entity): every distinct name with the smallest form of the entity that it stands for.

    ``names`` has a column ``name``; nulls are ignored, repeated rows count once, other columns
    aren't read. A name that can stand for several entities, such as an initial with the family
    name of two people, forms an entity of its own, and so does a name without letters.
    """
    distinct = names.where("name is not null").select("name").distinct()
    parsed = cut(forms_of(distinct))
    whole = parsed.where("size(words) >= 2").select("form", "words").distinct()
    whole = cut(whole)
    parts = cut(_shortened(parsed, cut(components(whole, link_forms(whole, least), node="form"))))

    # Names with one word and initials: the family name (or first word) and the letters of the others.
    short = parsed.where("size(words) = 1 and initials <> ''").select("name", F.col("form").alias("word"), "initials")
    known = parsed.where("size(words) >= 2").join(parts, "form").select("component", "words", "in_order", F.when(~F.col("initials").startswith("#"), F.col("initials")).alias("middle"))
    held = known.select("component", "middle", F.split("in_order", " ").alias("order"), F.explode(F.array_distinct("words")).alias("word"))
    rest = F.filter("order", lambda x: x != F.col("word"))
    letters = F.array_join(F.transform(rest, lambda x: F.left(x, F.lit(1))), "")
    letters = held.select("word", "component", letters.alias("letters"), F.coalesce("middle", F.lit("")).alias("middle")).distinct()
    wanted = F.regexp_replace("initials", "#", "")
    fits = short.join(letters, "word").where(
        F.when(F.col("initials").startswith("#"), F.col("letters") == wanted).otherwise((F.length("letters") == 1) & (F.left(wanted, F.lit(1)) == F.col("letters")))
    )
    exact = fits.withColumn("full", (F.col("middle") != "") & (F.concat("letters", "middle") == wanted) & (F.length(wanted) > 1))
    votes = exact.groupBy("name", "component").agg(F.max("full").alias("full"))
    best = votes.withColumn("any", F.max("full").over(W.partitionBy("name"))).where("full = any")
    one = best.groupBy("name").agg(F.count("*").alias("n"), F.min("component").alias("component")).where("n = 1").select("name", "component")

    single = parsed.where("size(words) = 1 and initials = ''")
    firms = single.groupBy("form").agg(F.bool_or("legal").alias("firm")).where("firm").select("form", F.col("form").alias("component"))
    named = parsed.where("size(words) >= 2").join(parts, "form").select("name", "component").unionByName(one).unionByName(single.join(firms, "form").select("name", "component"))
    own = F.concat(F.lit("="), F.col("name"))
    return distinct.join(named, "name", "left").select("name", F.coalesce("component", own).alias("entity"))


def variant_pairs(names: DataFrame, least: float = 0.8) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: all pairs of different spellings of one entity.

    An entity with more than SLICE spellings is split into slices, and each slice meets each other under a key of its own, so
    that no task forms all pairs of a hot one.
    """
    found = cut(entities(names, least).where(~F.col("entity").startswith("=")))
    slices = found.groupBy("entity").agg(F.ceil(F.count("*") / SLICE).alias("slices")).where("slices > 1")
    placed = found.join(slices, "entity", "left").withColumn("slices", F.coalesce("slices", F.lit(1).cast("long"))).withColumn("at", F.pmod(F.xxhash64("name"), "slices"))
    left = placed.select("entity", F.col("name").alias("x"), F.col("at").alias("i"), F.explode(F.sequence("at", F.col("slices") - 1)).alias("j"))
    right = placed.select("entity", F.col("name").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), "at")).alias("i"), F.col("at").alias("j"))
    met = left.join(right, ["entity", "i", "j"]).where("i < j or x < y")
    return met.select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))
