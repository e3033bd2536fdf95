"""Spellings of names reduced to comparable forms, and the comparison of two forms."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

# Titles and notes that don't belong to a name.
TITLES = frozenset("dr prof professor mr mrs ms miss sir mx frau herr sr sra srta señor señora mme mlle monsieur madame hr fr ing mag dipl".split())
# Legal forms of firms, without dots.
LEGAL = frozenset("ab aktiebolag ltd limited llc inc incorporated corp corporation gmbh ag kg sa sas sarl srl spa plc bv nv oy as aps co company pty kk".split())
# Legal forms of more than one word.
LEGAL_PHRASES = ("limited liability company", "limited liability co", "societe anonyme", "sociedad anonima", "gesellschaft mit beschrankter haftung", "gesellschaft mbh", "public limited company", "and co", "& co", "und co", "et cie")
# Short forms of given names.
NICKNAMES = {
    "abigail": "abby gail abbie", "alexander": "alex sasha xander al sandy", "anthony": "tony ant", "benjamin": "ben benny benji", "caroline": "caro carrie", "cassandra": "cass sandra cassie", "christopher": "chris kit topher",
    "daniel": "dan danny", "deborah": "deb debbie debby", "douglas": "doug dougie", "edward": "ed eddie ned ted teddy", "elizabeth": "beth betty liz lizzie eliza libby", "francesca": "fran frankie franny cesca", "frederick": "fred freddy freddie",
    "gabriella": "gabby ella gabi", "gregory": "greg", "isabella": "bella izzy isa", "jacqueline": "jackie", "jennifer": "jen jenny", "jonathan": "jon jonny jonty", "joseph": "joe joey", "josephine": "jo josie", "katherine": "kat kathy kate katie kit",
    "leonard": "len leo lenny", "madeleine": "maddie", "margaret": "meg peggy maggie", "mathilda": "tilda mattie hilda", "matthew": "matt", "maximilian": "max", "michael": "mick mike mickey", "nathaniel": "nat nate", "nicholas": "nick nico nicky", "patricia": "pat trish tricia patty",
    "penelope": "penny", "philippa": "pippa pip", "raymond": "ray", "rebecca": "becca becky", "robert": "bob bobby rob robbie", "samuel": "sam sammy", "sigmund": "siggi", "stephen": "steve", "susanna": "sue susie", "theodore": "theo ted teddy",
    "thomas": "tom tommy", "timothy": "tim", "valentina": "tina val", "victoria": "vicky tori", "vincent": "vince vinny", "wilhelmina": "mina willa billie", "william": "bill will billy liam",
}
_LONG: dict[str, set[str]] = {}
_NONE: set[str] = set()
for _name, _shorts in NICKNAMES.items():
    for _short in _shorts.split():
        _LONG.setdefault(_short, set()).add(_name)

_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}]")
_NOTE = regex.compile(r"\([^)]*\)|\[[^\]]*\]")
_OWNER = regex.compile(r"['’ʼ]s\b")
_DOTTED = regex.compile(r"\b(?:\p{L}\.){2,}\p{L}?\.?|\b\p{L}(?:\.\p{L}){1,}\.?")
_HANDLE = regex.compile(r"^\p{Ll}{2,}[._]\p{Ll}{2,}$")
_TOKEN = regex.compile(r"[\p{L}\p{M}\d]+|&")


def fold(text: str) -> str:
    """Lower case without accents, invisible characters or compatibility forms."""
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub(lambda m: " " if m.group() in "\t\n\r\v\f" else "", text)).lower().translate(_LETTERS)
    return "".join(c for c in text if not unicodedata.combining(c))


def parse(name: str) -> tuple[list[str], bool]:
    """(tokens without titles, notes, possessives and legal forms; whether a legal form was there).

    Initials are one letter; 'K.G.' gives two of them. Empty for a name without letters.
    """
    text = fold(_OWNER.sub("", _NOTE.sub(" ", unicodedata.normalize("NFKC", name)))).strip(" .,;:!?\"'")
    if _HANDLE.match(text):
        text = regex.sub(r"[._]", " ", text)
    legal = False
    for phrase in LEGAL_PHRASES:
        if phrase in text:
            text, legal = text.replace(phrase, " "), True

    alone = len([t for t in _TOKEN.findall(_DOTTED.sub(" ", text)) if len(t) > 1]) == 1  # 'Gray, K.G.' has initials, 'Gray Wool K.G.' a legal form

    def dotted(m):
        letters = regex.sub(r"\W", "", m.group())
        return f" {letters} " if letters in LEGAL and not (alone and len(letters) == 2 and "," in text) else " " + " ".join(letters) + " "

    tokens = _TOKEN.findall(_DOTTED.sub(dotted, text))
    firm = [t for t in tokens if t not in LEGAL and t != "&"]
    legal = legal or len(firm) < len(tokens)
    if len(firm) > 1 and firm[0] in ("the", "la", "le", "el", "die", "der", "das"):
        firm = firm[1:]
    while len(firm) > 1 and firm[0] in TITLES:
        firm = firm[1:]
    return firm, legal


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u) | (v - u)
    return (~v & full).bit_count()


@lru_cache(200_000)
def ratio(a: str, b: str) -> float:
    """Longest-common-subsequence ratio: twice its length over both lengths."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, replacement or swap of neighbours."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def nickname(a: str, b: str) -> bool:
    """Whether one is a known short form of the other, or both are of one name."""
    return b in _LONG.get(a, ()) or a in _LONG.get(b, ()) or bool(_LONG.get(a, _NONE) & _LONG.get(b, _NONE))


def _stems() -> dict[str, str]:
    """Each name of NICKNAMES, long or short, with the smallest of all that nicknames connect it to."""
    of: dict[str, str] = {}
    for start in sorted({*NICKNAMES, *_LONG}):
        todo = [] if start in of else [start]
        while todo:
            name = todo.pop()
            if name not in of:
                of[name] = start
                todo += [*_LONG.get(name, ()), *NICKNAMES.get(name, "").split()]
    return of


_STEM = _stems()


def stem(token: str) -> str:
    """The token, or for known names and nicknames one name for all that may be the same."""
    return _STEM.get(token, token)


def short_of(a: str, b: str) -> bool:
    """Whether one is a short form of the other: a known nickname, or the first letter and others in order ('mfg')."""
    if nickname(a, b):
        return True
    s, t = sorted((a, b), key=len)
    return len(s) >= 3 and len(t) >= 5 and len(s) < 0.7 * len(t) and s[0] == t[0] and lcs(s, t) == len(s) and s[-1] in t[-3:] + s[-1] * t.startswith(s)


def spellings(a: tuple[str, ...], b: tuple[str, ...], least: float = 0.8) -> list[tuple[str, str] | None]:
    """The ways in which two forms (long tokens, at least two each) can name the same entity; empty if they can't.

    Tokens are paired whatever their order, and at least one pair must be equal or a nickname. One
    pair may differ in spelling (LCS ratio of at least ``least``, or a single edit); others may be short forms of each other.
    A way is the pair that differs in spelling, or None where none does.
    """
    rest_a, rest_b = list(a), list(b)
    same = 0
    for t in a:
        if t in rest_b:
            rest_a.remove(t)
            rest_b.remove(t)
            same += 1
    if len(rest_a) != len(rest_b) or not (same or any(nickname(t, u) for t in rest_a for u in rest_b)):
        return []
    ways: list[tuple[list[str], tuple[str, str] | None]] = [(rest_b, None)]
    for t in sorted(rest_a):
        onward = []
        for left, typo in ways:
            hit = next((u for u in left if short_of(t, u)), None)
            hits = [hit] if hit is not None else [] if typo else dict.fromkeys(u for u in left if ratio(t, u) >= least or one_edit(t, u))
            for u in hits:
                rest = list(left)
                rest.remove(u)
                onward.append((rest, typo if hit is not None else (t, u)))
        ways = onward
    return list(dict.fromkeys(typo for _, typo in ways))
