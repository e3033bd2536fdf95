"""Scalar text functions as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Greetings and fillers that carry no information.
FILLERS = (
    "hey", "hi", "hello", "hi there", "hey there", "howdy", "thanks", "thank you", "thx", "ty", "wow", "oh wow", "whoa", "congrats", "congratulations", "omg", "lol", "haha",
    "hehe", "lmao", "rofl", "ok", "okay", "k", "sure", "sure thing", "yes", "yeah", "yep", "yup", "nope", "no", "right", "exactly", "agreed", "absolutely", "no worries",
    "no problem", "np", "you're welcome", "yw", "sounds good", "sounds great", "cool", "nice", "got it", "understood", "roger", "copy that", "bye", "goodbye", "see you", "later",
    "ttyl",
)
# Patterns of the answer a question asks for, the first that fits counts.
ANSWER_TYPES = (
    (r"^(who|whose|by whom|with whom|to whom)\b", "person"),
    (r"\bwhich (person|friend|coworker|colleague|teacher|doctor|partner)\b", "person"),
    (r"\bwhat is (his|her|their) name\b", "person"),
    (r"^where\b|^from where\b|^to where\b", "location"),
    (r"\b(which|what) (city|country|place|state|park|address|venue|building|street|neighborhood|hotel|restaurant|cafe|store|airport)\b", "location"),
    (r"^when\b", "date"),
    (r"\bwhat (time|day|date|year|month|hour)\b", "date"),
    (r"\bhow long ago\b", "date"),
    (r"^how (many|much|long|old|far|tall|big|fast|heavy|deep|wide)\b", "measurement"),
    (r"\bhow many (days|years|months|weeks|hours|minutes|seconds|miles|km|kilometers)\b", "measurement"),
    (r"\b(which|what) (company|organization|firm|university|college|school|team|brand|agency)\b", "organization"),
    (r"\b(which|what) (movie|book|song|album|game|show|film|novel|poem|painting)\b", "other"),
)
# Phrases of an answer that declines.
ABSTAIN = (
    "no information", "not mentioned", "not available", "cannot be determined", "no evidence", "not in the conversation", "not discussed", "no record", "not specified",
    "not stated", "not provided", "does not mention", "doesn't mention", "does not specify", "doesn't specify", "does not state", "doesn't state", "does not provide",
    "doesn't provide", "no mention of", "no specific mention", "context does not", "is not present in", "is not specified", "not appear in", "cannot find", "no such information",
)
# Languages of code by extension.
LANGUAGES = {"py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby", "sh": "bash", "sql": "sql", "md": "markdown", "html": "html", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "csv": "csv"}
# Predicates of statements of fact and of preference.
FACT = r"(?i)\b(?:is|are|was|were|has|had|have|went to|works? at|lives? in|attended|started|completed|joined|left|moved to|studied at|graduated from|runs?|manages?|leads?|created|built|wrote|published)\b"
PREFERENCE = r"(?i)\b(?:prefer|like|love|hate|dislike|enjoy|don't like|interested in|passionate about|favorite)\b"

PUNCTUATION = r"!-/:-@\[-`{-~"


def canonical_name(col: Column) -> Column:
    """Trimmed, without ASCII punctuation at the ends, white space collapsed, lower case."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(col, r"\s+", " ")), rf"^[{PUNCTUATION}\s]+|[{PUNCTUATION}\s]+$", "")
    return F.lower(bare)


def object_key(col: Column) -> Column:
    return F.lower(F.trim(col))


def words(col: Column) -> Column:
    """Words split at white space."""
    return F.filter(F.split(F.trim(col), r"\s+"), lambda w: w != "")


def token_count(col: Column) -> Column:
    """Tokens estimated as 1.3 per word, rounded up."""
    return F.ceil(F.size(words(col)) * 1.3)


def search_terms(col: Column) -> Column:
    """Lower-case terms split at anything but letters, marks and digits of any script."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def word_set(col: Column) -> Column:
    """Distinct terms of more than one byte, for overlap measures."""
    return F.array_distinct(F.filter(search_terms(col), lambda w: F.octet_length(w) > 1))


def strip_thousands(col: Column) -> Column:
    """1,234,567 becomes 1234567; 1,2 stays."""
    return F.regexp_replace(col, r"(?<=\d),(?=\d{3}(?!\d))", "")


def search_text(col: Column) -> Column:
    """Search tokens: identifiers whole and, after them, in their parts."""
    tokens = F.transform(F.split(strip_thousands(col), r"[^\p{L}\p{N}_.:/@#+-]+"), lambda t: F.regexp_replace(t, r"^[.:\-/+#@]+|[.:\-/+#@]+$", ""))

    def with_parts(t: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(t, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", "_"), r"[_\-./:@#+]"), lambda p: (F.length(p) > 1) | p.rlike(r"^\d+$"))
        return F.when(F.size(parts) > 1, F.concat(F.array(t), parts)).otherwise(F.array(t))

    return F.array_join(F.flatten(F.transform(F.filter(tokens, lambda t: t != ""), with_parts)), " ")


def is_informative(content: Column, content_type: Column) -> Column:
    """Not of the system or an error, five words or more, no filler, no bare question."""
    text = F.trim(content)
    filler = F.lower(F.trim(F.regexp_replace(text, rf"[{PUNCTUATION}]+$", ""))).isin(*FILLERS)
    question = text.endswith("?") & (F.size(words(text)) < 8)
    return F.coalesce(~F.lower(content_type).isin("system", "error"), F.lit(True)) & (F.size(words(text)) >= 5) & ~filler & ~question


def answer_type(question: Column) -> Column:
    """Kind of answer that a question asks for, or null."""
    q = F.lower(F.trim(question))
    out = F
    for pattern, kind in ANSWER_TYPES:
        out = out.when(q.rlike(pattern), kind)
    return out


def abstains(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(ABSTAIN))


def cap_chars(col: Column, most: int) -> Column:
    return F.when(F.length(col) > most, F.concat(F.left(col, F.lit(most)), F.lit("…"))).otherwise(col)


def visibility(col: Column) -> Column:
    """Blank and 'public' mean the same as null."""
    v = F.trim(col)
    return F.when((v != "") & (F.lower(v) != "public"), v)


def fact_id(subject: Column, predicate: Column, obj: Column, scope: Column) -> Column:
    parts = F.concat_ws("|", F.coalesce(subject, F.lit("")), F.coalesce(predicate, F.lit("")), F.coalesce(obj, F.lit("")))
    return F.concat_ws("|", F.translate(parts, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), visibility(scope))


def laplace(n: Column) -> Column:
    n = F.greatest(n, F.lit(0))
    return (n + 1.0) / (n + 2.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def modality_of(mime: Column) -> Column:
    m = F.lower(F.trim(F.split(mime, ";")[0]))
    return (
        F.when(m.isin("text/html", "application/xhtml+xml", "application/xml", "text/xml"), "markup")
        .when(m.isin("application/json", "text/csv", "application/x-ndjson", "text/tab-separated-values"), "structured")
        .when(m.startswith("text/x-") | m.isin("application/javascript", "text/javascript"), "code")
        .when(m == "application/pdf", "pdf").when(m.startswith("text/"), "text").when(m.startswith("image/"), "image").when(m.startswith("audio/"), "audio").when(m.startswith("video/"), "video").otherwise("other")
    )


def mime_of(declared: Column, head: Column, path: Column) -> Column:
    """Declared type, else magic bytes of ``head`` (binary), else extension, else text or octet-stream."""
    hexed = F.hex(F.substring(head, 1, 12))
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_ext = F.try_element_at(F.create_map(*[F.lit(x) for pair in {"md": "text/markdown", "txt": "text/plain", "html": "text/html", "json": "application/json", "csv": "text/csv", "py": "text/x-python", "rs": "text/x-rust", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "mp3": "audio/mpeg", "mp4": "video/mp4"}.items() for x in pair]), ext)
    magic = F.when(hexed.startswith("25504446"), "application/pdf").when(hexed.startswith("89504E47"), "image/png").when(hexed.startswith("FFD8FF"), "image/jpeg").when(hexed.startswith("47494638"), "image/gif").when(hexed.startswith("504B0304"), "application/zip")
    return F.coalesce(F.nullif(declared, F.lit("")), magic, by_ext, F.when(F.is_valid_utf8(head), "text/plain"), F.lit("application/octet-stream"))


def strip_html(col: Column) -> Column:
    """Visible text of HTML: scripts, styles and comments dropped, tags removed, common entities decoded, blanks collapsed."""
    text = F.regexp_replace(F.regexp_replace(col, r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def redact_urls(col: Column) -> Column:
    """User info, query and fragment removed from URLs."""
    return F.regexp_replace(F.regexp_replace(col, r"(https?://)[^\s/@]+@", "$1"), r"(https?://[^\s?#]+)[?#][^\s]*", "$1")


def escape_cell(col: Column) -> Column:
    """Text safe within a Markdown table cell."""
    return F.regexp_replace(F.replace(col, F.lit("|"), F.lit(r"\|")), r"[\r\n]+", " ")


def sentences(col: Column) -> Column:
    """Plain split after . ! ? ; before white space, and at line breaks."""
    return F.filter(F.transform(F.split(col, r"(?<=[.!?;])\s+|\n+"), F.trim), lambda s: s != "")
