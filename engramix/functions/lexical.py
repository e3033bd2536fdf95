"""Words of statements: predicates, objects, negation, names and templates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Auxiliary words before a verb; the first that fits is taken off.
PREFIXES = (
    "has_been_", "have_been_", "had_been_", "is_being_", "was_being_", "are_", "were_", "have_", "has_", "had_", "is_", "was_", "be_", "been_", "being_",
    "will_", "would_", "should_", "could_", "might_", "may_", "do_", "does_", "did_", "to_",
)
# Irregular forms of verbs.
IRREGULAR = {
    "got": "get", "gotten": "get", "went": "go", "gone": "go", "goes": "go", "said": "say", "says": "say", "saw": "see", "seen": "see", "sees": "see", "took": "take", "taken": "take", "takes": "take", "made": "make", "makes": "make",
    "had": "have", "has": "have", "did": "do", "done": "do", "does": "do", "was": "be", "were": "be", "been": "be", "is": "be", "are": "be", "am": "be", "came": "come", "comes": "come", "gave": "give", "given": "give", "gives": "give",
    "knew": "know", "known": "know", "knows": "know", "thought": "think", "thinks": "think", "told": "tell", "tells": "tell", "found": "find", "finds": "find", "brought": "bring", "brings": "bring", "bought": "buy", "buys": "buy",
    "ran": "run", "runs": "run", "ate": "eat", "eaten": "eat", "eats": "eat", "wrote": "write", "written": "write", "writes": "write", "read": "read", "reads": "read", "met": "meet", "meets": "meet", "lost": "lose", "loses": "lose",
    "won": "win", "wins": "win", "sent": "send", "sends": "send", "kept": "keep", "keeps": "keep", "felt": "feel", "feels": "feel", "left": "leave", "leaves": "leave", "heard": "hear", "hears": "hear", "held": "hold", "holds": "hold",
    "paid": "pay", "pays": "pay", "put": "put", "puts": "put", "set": "set", "sets": "set",
}
# Endings and what takes their place; the first that fits and leaves two letters counts.
SUFFIXES = (
    ("nning", "n"), ("tting", "t"), ("dding", "d"), ("pping", "p"), ("gging", "g"), ("bbing", "b"), ("mming", "m"), ("ying", "y"), ("ing", ""), ("nned", "n"), ("tted", "t"), ("dded", "d"), ("pped", "p"), ("gged", "g"), ("ied", "y"), ("ed", ""),
    ("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("oes", "o"), ("s", ""),
)
# Verbs that say little without an object of their own.
LIGHT = ("do", "make", "get", "have", "be", "go")
# Articles and prepositions at the begin of an object, and phrases that are no object.
LEADING = ("the", "a", "an", "in", "on", "at", "to", "of", "for", "with", "from", "by", "into", "onto", "upon", "about", "around", "before", "after", "over", "under")
EMPTY = (
    "i", "me", "my", "mine", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "it", "its", "we", "us", "our", "ours", "they", "them", "their", "theirs", "what", "who", "which", "thing", "things", "stuff", "something", "anything",
    "everything", "nothing", "yesterday", "today", "tomorrow", "now", "then", "this", "that", "these", "those",
)


def normal_predicate(col: Column) -> Column:
    """Lower case, words joined by underscores."""
    return F.regexp_replace(F.trim(F.lower(col)), r"[\s_\-]+", "_")


def lemma(col: Column) -> Column:
    """The base form of a predicate: one auxiliary before it is taken off; then irregular forms by table, others by their ending."""
    normal = normal_predicate(col)
    head = F.coalesce(F.nullif(F.regexp_extract(normal, rf"^(?:{'|'.join(PREFIXES)})(.+)$", 1), F.lit("")), normal)
    regular = F
    for ending, instead in SUFFIXES:
        rest = F.concat(F.substring(head, F.lit(1), F.length(head) - len(ending)), F.lit(instead))
        regular = regular.when(head.endswith(ending) & (F.length(rest) >= 2), rest)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair]), head), regular.otherwise(head))


_ASCII_MARKS = r"!-/:-@\[-`{-~"


def clean_object(col: Column) -> Column:
    """An object without marks and blanks around it and articles and prepositions before it; null where nothing or only a word that is no object is left."""
    bare = F.regexp_replace(col, rf"^[{_ASCII_MARKS}\s]+|[{_ASCII_MARKS}\s]+$", "")
    led = F.regexp_replace(bare, rf"(?i)^(?:(?:{'|'.join(LEADING)})(?:\s+|$))+", "")
    return F.when((led != "") & ~F.lower(led).isin(*EMPTY), led)


def light_only(predicate: Column, obj: Column) -> Column:
    """Whether a statement is a light verb with no object, or with one of which every word is none."""
    words = F.filter(F.split(F.lower(F.coalesce(obj, F.lit(""))), r"\s+"), lambda w: w != "")
    return predicate.isin(*LIGHT) & F.forall(words, lambda w: w.isin(*EMPTY))


def negated(text: Column) -> Column:
    """Whether a word of the text denies it."""
    return F.coalesce(F.lower(F.replace(text, F.lit("’"), F.lit("'"))).rlike(r"(?:^|[^\p{L}'])(?:not|never|no|nor)(?:$|[^\p{L}'])|n't(?:$|[^\p{L}])"), F.lit(False))


def entity_ref(col: Column) -> Column:
    """A name as a question mentions it: without marks after it and the possessive; null below two characters."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(col), r"[?.,!;:\"]+$", ""), r"(?:['’]s|['’])$", ""))
    return F.when(F.length(bare) >= 2, bare)


def render(template: str, **captures: Column) -> Column:
    """The template with {name} replaced by the captures (null ones by nothing), blanks squeezed."""
    out = F.lit(template)
    for name, value in captures.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\{\w+\}", ""), r"\s+", " "))


def embedding_text(at: Column, subject: Column, predicate: Column, obj: Column, fallback: Column) -> Column:
    """'[Month Year] subject predicate object', or the fallback where there is no object."""
    dated = F.concat(F.lit("["), F.date_format(at, "MMMM yyyy"), F.lit("] "))
    said = F.coalesce(F.concat_ws(" ", subject, F.replace(predicate, F.lit("_"), F.lit(" ")), obj), F.lit(""))
    return F.concat(F.coalesce(dated, F.lit("")), F.when(obj.isNotNull(), said).otherwise(F.coalesce(fallback, said)))


def dated_content(content: Column, phrase: Column, point: Column) -> Column:
    """The content with its time phrase replaced by the date it stands for."""
    return F.when(phrase.isNotNull() & (phrase != "") & point.isNotNull(), F.replace(content, phrase, F.date_format(point, "yyyy-MM-dd"))).otherwise(content)


# Abbreviations that a sentence doesn't end after.
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Gen", "Col", "Lt", "Sgt", "Capt", "Cmdr", "Adm", "Maj", "Rep", "Sen", "Gov", "Pres", "Rev", "Hon", "St", "Mt", "Ft", "Sr", "Jr", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec",
    "No", "Nos", "vs", "Fig", "approx", "Vol", "pp", "Ave", "Blvd",
)


def sentences_kept_whole(col: Column, least: int = 4) -> Column:
    """Sentences of at least ``least`` words; the whole text where none is left and it has so many.

    A sentence ends at . ! ? and closing marks before white space and what can begin another one, but not after an abbreviation, an initial or letters joined by stops.
    """
    marked = F.regexp_replace(col, rf"((?:^|[\s\"'(\[])(?:{'|'.join(ABBREVIATIONS)}|[A-Z]|[A-Za-z](?:\.[A-Za-z])+))\.([\"')\]”’]*\s)", "$1\x01$2")
    parts = F.transform(F.split(marked, r"(?<=[.!?][\"')\]”’]{0,4})\s+(?=[\p{Lu}0-9\"'(\[“‘])"), lambda s: F.trim(F.replace(s, F.lit("\x01"), F.lit("."))))
    enough = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least
    kept = F.filter(parts, enough)
    return F.when(F.size(kept) > 0, kept).when(enough(col), F.array(F.trim(col))).otherwise(F.array().cast("array<string>"))


def precondition_holds(rule: Column, state: Column) -> Column:
    """Whether every 'key=value' of a comma-separated rule is in the map ``state``; an empty or null rule holds always, a part without '=' never."""
    parts = F.filter(F.transform(F.split(F.coalesce(rule, F.lit("")), ","), F.trim), lambda p: p != "")
    return F.forall(parts, lambda p: F.coalesce(p.contains("=") & (F.try_element_at(state, F.trim(F.substring_index(p, "=", 1))) == F.trim(F.substr(p, F.instr(p, "=") + 1))), F.lit(False)))


# Dialogue acts that carry information.
INFORMATIVE = ("inform", "request", "confirm", "offer", "status")


def act_admits(acts: Column, chances: Column, least: float = 0.20) -> Column:
    """Whether an informative act has at least the chance ``least``, or is the likeliest one; ``acts`` and ``chances`` are arrays of one length."""
    some = F.exists(F.zip_with(acts, chances, lambda a, p: a.isin(*INFORMATIVE) & (p >= least)), lambda x: F.coalesce(x, F.lit(False)))
    top = F.try_element_at(acts, F.array_position(chances, F.array_max(chances)).cast("int"))
    return some | F.coalesce(top.isin(*INFORMATIVE), F.lit(False))


def merged_json(base: Column, add: Column) -> Column:
    """Two maps as one; where both have a key, that of ``add`` counts."""
    kept = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.coalesce(add, F.create_map().cast("map<string,string>")), k))
    return F.map_concat(kept, F.coalesce(add, F.create_map().cast("map<string,string>")))
