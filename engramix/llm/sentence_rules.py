"""Sentence boundaries of one text, with evidence from the text itself and from the corpus."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import regex

# Marks that end sentences, that close and that open, by script.
TERMINATORS = ".!?…。！？｡．؟۔।॥։።၊။"
CLOSERS = "\"'”’»)]」』）】›］"
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "‹": "›", "‘": "’"}
# Legal forms that may follow a firm's name that ends in a mark.
FORMS = frozenset("Ltd Inc Co Corp LLC GmbH AG SA AB BV".split())
# Verbs of saying in scripts without capitals, and particles that go on after a quotation.
SAYING = regex.compile(r"^[^。！？।.!?؟]{0,40}?(?:说|說|道|问|問|喊|表示|写道|कहा|पूछा|बोले|बोला|बोली|लिखा|قال|قالت|سأل|言った|言いました|話した)[^\p{L}]?[^。！？।.!?؟]{0,12}[。！？।.!?؟]")
PARTICLES = "とっはがをのもにでへや"
THAI_END = r"(?:ครับ|ค่ะ|คะ)(?![ะ-ฺเ-๎]|แนน)"

_END = regex.compile(rf"[{regex.escape(TERMINATORS)}]+|{THAI_END}")
_WHITE = regex.compile(r"\p{White_Space}")
_VISIBLE = regex.compile(r"[^\p{White_Space}\p{Cf}\p{Cc}]")
_LINE = regex.compile(r"[^\r\n\v\f\x85  ]*(\r\n|[\r\n\v\f\x85 ]| |$)")
_LIST = regex.compile(r"\s*(?:[-*+•◦▪‣–—●○·][ \t\xa0]+|\d{1,3}[.)][ \t\xa0]+(?=\p{Lu})|\(?[a-z\d][)][ \t\xa0]+)")
_NUMBERED = regex.compile(r"\s*\d{1,3}[.)][ \t\xa0]")
_HEADING = regex.compile(r"\s*#{1,6}[ \t\xa0]")
_LABEL = regex.compile(r"\s*(?:\[[\d:.,/ -]+\]\s*)?(?:\*\*[^*\n]{1,40}\*\*:?|\p{Lu}[\p{L}\p{M}\d_.'’-]{0,30}(?: \p{Lu}[\p{L}\p{M}\d_.'’-]{0,30})?[:：]|[\p{Lu}\d][\p{Lu}\d _-]{0,30} ?>)(?!\S*//)\s*|\s*\[\d[\d:.,/ -]*\]\s*")
_NEXT = regex.compile(r"[\p{White_Space}\p{Cf}]*([\"'“„«‹「『(（\[¿¡‚‘]*)[\p{White_Space}\p{Cf}]*([\p{L}\p{N}][\p{L}\p{M}\p{N}'’]*)?(\.?)")
_SMALL = regex.compile(r"\p{White_Space}*([\p{L}\p{N}]+)")
_MARKS = regex.compile(r"[“”„«»「」『』()（）\[\]【】‹›\"]")
_CLOSE = regex.compile(rf"(?:[{regex.escape(CLOSERS)}]|[ \xa0\u202f]+»)+")
_NUMBER, _DECIMAL = regex.compile(r"\p{N}+"), regex.compile(r"[\p{N}.,]*\p{N}[%€]?")
_DOTTED = regex.compile(r"(?:\p{L}{1,3}\.)+\p{L}{1,3}|(\p{Lu})\1")
_UNCASED = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{M}]{1,2}")
_FIGURES = regex.compile(r"[\d.,]+")
_PLAIN = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
_AFTER = regex.compile(r"[\p{L}\p{M}'’]+")
_LONGER = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’]*")
_BETWEEN = regex.compile(rf"[\p{{White_Space}}\p{{Cf}}\x1c-\x1f\"'“„«‹「『(（\[¿¡‚‘{regex.escape(CLOSERS)}]*")
_JOINED = ".,'’-%€$£"
_FIRST = regex.compile(r"[^\p{L}\p{N}]*([\p{L}\p{N}][\p{L}\p{M}\p{N}'’]*)")
_ENDS = regex.compile(r"[.!?]+(?=(?:[\p{White_Space}]+([\p{Ll}\p{N}]|\p{Lu}[\p{L}\p{M}'’]*)|[,;:]))")


def _word_start(text: str, at: int, least: int, joined: str) -> int:
    """Where the run of letters, digits, marks and characters of ``joined`` begins that ends before ``at``."""
    while at > least:
        c = text[at - 1]
        if c.isalnum() or c in joined or (c > "\u02ff" and unicodedata.category(c)[0] == "M"):
            at -= 1
        else:
            break
    return at


def _word_end(text: str, at: int, most: int) -> int:
    """Where the run of letters, digits, marks and apostrophes ends that begins at ``at``."""
    while at < most:
        c = text[at]
        if c.isalnum() or c in "'’" or (c > "\u02ff" and unicodedata.category(c)[0] == "M"):
            at += 1
        else:
            break
    return at


def blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, start of the text proper, end) of the parts that always begin a unit.

    Blank lines, headings, list items and speaker labels begin one; a line break inside prose doesn't.
    """
    out: list[list[int]] = []
    before = "blank"
    lines = [m for m in _LINE.finditer(text) if m.end() > m.start()]
    numbered = len(lines) > 1 and sum(1 for m in lines if _NUMBERED.match(text, *m.span())) > 1
    for m in lines:
        line, at = m.group(), m.start()
        if not line[0].isalnum() and not _VISIBLE.search(line):
            if out:
                out[-1][2] = m.end()
            if before != "start":
                before = "blank" if _WHITE.sub("", line) == "" or not _VISIBLE.search(line) else before
            continue
        kind, label = "plain", None
        if "#" in line and (found := _HEADING.match(line)):
            kind, label = "heading", found
        elif not (line[:3].isalpha() or line[1:2].isalpha() and line[0].isalpha()) and (found := _LIST.match(line)) and (numbered or not _NUMBERED.match(line)):
            kind, label = "list", found
        elif any(c in line for c in ":：>[*") and (found := _LABEL.match(line)):
            kind, label = "label", found
        new = before in ("blank", "heading") or kind != "plain"
        if kind == "plain" and before == "list" and not new:
            new = not (line[:1].isspace() or regex.match(r"\s*\p{Ll}", line))
        if new or not out:
            out.append([at, at + (label.end() if label else 0), m.end()])
        else:
            out[-1][2] = m.end()
        before = "blank" if m.group(1) == " " else kind if kind != "plain" or before in ("blank", "heading") else before
    return [tuple(b) for b in out]


def starter_counts(text: str, starts: Counter, inside: Counter, parts: list[tuple[int, int, int]] | None = None) -> None:
    """Adds words at unambiguous starts (of blocks, ``parts`` where they are known), and capitalised or small words within sentences."""
    for _, a, b in blocks(text) if parts is None else parts:
        if m := _FIRST.match(text, a, b):
            starts[m.group(1)] += 1
    words, last = [], ""
    for token in text.split(" "):
        if last and token and (last.isalpha() or last == ",") and token[0].isalpha():
            # A word within: after a letter or comma; one with a capital only after a small letter, with or without a comma.
            if token[0].islower() or (token[0].isupper() and (before if last == "," else last).islower()):
                words.append(token if token.isalpha() else _PLAIN.match(token).group())
        last, before = token[-1:], token[-2:-1]
    inside.update(words)


def marked_words(text: str) -> Iterator[tuple[str, str | None, bool]]:
    """(word with its mark: 'approx.' or 'Ping!', what follows it, whether that has a capital)."""
    least = 0
    for m in _ENDS.finditer(text):
        at = m.start()
        start = _word_start(text, at, least, ".-")
        while start < at and not text[start].isalnum():
            start += 1
        if start == at:
            continue
        least = m.end()
        word, mark, follows = text[start:at], text[at], m.group(1)
        if _FIGURES.fullmatch(word):
            continue
        if follows is None or not follows[0].isupper():
            small = _SMALL.match(text, m.end()) if follows else None
            yield word + mark, small.group(1) if small else None, False
        else:
            yield word + mark, follows, True


def mark_counts(text: str, is_start, out: Counter) -> None:
    """Adds for each word with a mark how often what follows goes on (0) or begins anew (1); a small word that can begin tells nothing."""
    for key, follows, capital in marked_words(text):
        if capital:
            out[key, int(is_start(follows))] += 1
        elif not (follows and is_start(follows)):
            out[key, 0] += 1


def small_of(word: str) -> str:
    return word[:1].lower() + word[1:]


def asked(text: str) -> tuple[set[str], set[str]]:
    """Words and marked words of which ``sentences`` may ask the corpus, whatever it learns of the others."""
    words = {follows for _, follows, _ in marked_words(text) if follows}
    marks = set()
    end = len(text)
    for m in _END.finditer(text):
        at = m.start()
        w = text[_word_start(text, at, max(0, at - 40), _JOINED) : at].lstrip(".,'’-")
        if w:
            marks.add(w + ".")
            if text[at] != ".":
                marks.add(w + text[at])
        at = m.end()
        if text[at : at + 1] == " " and text[at + 1 : at + 2].isalpha():  # the plain case
            words.add(text[at + 1 : _word_end(text, at + 1, end)])
            continue
        at = _BETWEEN.match(text, at).end()
        if text[at : at + 1].isalpha():
            words.add(text[at : _word_end(text, at, end)])
        if found := _LONGER.match(text, at):
            words.add(found.group())
    for m in _MARKS.finditer(text):
        at = m.end()
        while at < end and text[at].isspace():
            at += 1
        if at < end and text[at].islower() and (found := _AFTER.match(text, at)):
            words.add(found.group())
    return words | {small_of(w) for w in words}, marks


class Evidence:
    """What is known of starters and marked words, from one document first and the corpus after it.

    ``holds`` tells that the corpus holds the documents that are judged by it: a marked word that stands nowhere else is no evidence for its own place.
    Starts are unambiguous, so what a document adds to the corpus's count of them stays.
    """

    def __init__(self, starts: Mapping[str, int], inside: Mapping[str, int], marks: Mapping[tuple[str, int], int], holds: bool = False):
        self.starts, self.inside, self.marks, self.holds = starts, inside, marks, holds

    def begins(self, word: str, starts: Counter | None = None, inside: Counter | None = None) -> bool:
        """Whether a word can begin a sentence: seen at starts, or seen small elsewhere if it has a capital."""
        small = small_of(word)
        for s, i in ((starts, inside), (self.starts, self.inside)):
            if s is None:
                continue
            begun, held = s.get(word, 0), i.get(word, 0)
            if word[:1].isupper() and i.get(small, 0) > held:
                return True
            if begun + held >= (2 if s is starts else 1):
                return begun > held * 0.5
        return False

    def goes_on(self, key: str, marks: Counter | None = None) -> bool | None:
        """Whether a marked word usually doesn't end a sentence; None if nothing is known of it."""
        for m, least, less in ((marks, 2, False), (self.marks, 1, self.holds and marks is not None)):
            if m is None:
                continue
            on, end = m.get((key, 0), 0), m.get((key, 1), 0)
            if less and on + end:
                on, end = max(0, on - marks.get((key, 0), 0)), max(0, end - marks.get((key, 1), 0))
            if on + end >= least:
                return on > end
        return None


def _spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Quotations and brackets within text[a:b] as (opening position, end), innermost last."""
    stack: list[tuple[str, int]] = []
    out = []
    for m in _MARKS.finditer(text, a, b):
        c, p = m.group(), m.start()
        top = stack[-1][0] if stack else ""
        if c == '"':
            if top == '"':
                out.append((stack.pop()[1], p + 1))
            else:
                stack.append(('"', p))
        elif c == "“" and top == "“" and any(s == "“" and text[q] == "„" for s, q in stack):
            out.append((stack.pop()[1], p + 1))
        elif c == "„":
            stack.append(("“", p))
        elif c in PAIRS and not (c == "“" and top == "“"):
            stack.append((PAIRS[c], p))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == c:
                    out.append((stack[k][1], p + 1))
                    del stack[k:]
                    break
    return sorted(out)


def sentences(text: str, evidence: Evidence) -> list[int]:
    """Positions after the last character of each unit of ``text``; units cover all of it. Empty without visible text."""
    if not _VISIBLE.search(text):
        return []
    starts, inside, marks = Counter(), Counter(), Counter()
    parts = blocks(text)
    starter_counts(text, starts, inside, parts)
    begins = lambda w: evidence.begins(w, starts, inside)
    mark_counts(text, begins, marks)
    ends = []
    for a, proper, b in parts:
        ends += _split(text, proper, b, begins, lambda key: evidence.goes_on(key, marks))
        if _VISIBLE.search(text, proper, b) or not ends:
            ends.append(b)
        else:
            ends[-1] = b
    ends[-1] = len(text)
    return sorted(set(ends))


def _split(text: str, a: int, b: int, begins, goes_on) -> list[int]:
    spans = _spans(text, a, b)
    guillemets = "»" in text
    cuts: list[int] = []
    start = a
    done = a
    for m in _END.finditer(text, a, b):
        if m.start() < done:
            continue
        end = m.end()
        run = m.group()
        if run == "." and end < b and (text[end].isalnum() or text[end] in "_/@\\"):
            continue
        near = text[end : end + 1]
        close = _CLOSE.match(text, end, b) if end < b and (near in CLOSERS or guillemets and near.isspace()) else None
        around = [s for s in spans if s[0] < m.start() < s[1]] if spans else []
        if close:
            stop = end
            for c in range(close.start(), close.end()):
                if text[c] in " \xa0 ":
                    continue
                if any(s[1] == c + 1 for s in spans) or text[c] in "”’»)」』）】›":
                    stop = c + 1
            end = max(end, stop)
        if text[end : end + 1] == "“" and any(s[1] == end + 1 for s in spans):
            end += 1
        held = [s for s in around if s[1] > end]
        if held and not _stands_alone(text, held[0], start, b, begins):
            continue
        after = end
        while after < b and text[after].isspace():
            after += 1
        if after == b:
            continue
        if text[after].isalpha():  # the plain case, without a quotation or an invisible character before the word
            stop = _word_end(text, after, b)
            opener, word, dot = "", text[after:stop], text[stop : min(stop + 1, b)] == "."
        else:
            opener, word, dot = _NEXT.match(text, end, b).groups()
        spaced = after > end
        closed = around and around[-1][1] <= end
        first = text[after]
        if first in ",;:،、，；：" or (first in "—–" and closed):
            continue
        if first in "-" and closed:
            continue
        if closed and not run.startswith("…"):
            if any(not _stands_alone(text, s, start, b, begins, outer=True) for s in around if s[1] <= end and s[0] <= _first(text, start)):
                continue
        w = text[_word_start(text, m.start(), max(a, m.start() - 40), _JOINED) : m.start()].lstrip(".,'’-")
        cut = True
        if run[0] in "。！？｡．।॥؟۔" or run[0] not in ".!?…":
            cut = True
        elif run.startswith("…") or run.startswith("..") and "!" not in run and "?" not in run:
            cut = bool(word) and word[0].isupper()
        elif not spaced and not closed and not (run[0] in "!?" and word and word[0].isupper()):
            cut = False
        elif word is None:
            cut = True
        elif word[0].islower():
            if opener:
                cut = True
            elif closed:
                cut = begins(word)
            elif len(w) == 1 or _DOTTED.fullmatch(w):
                cut = False
            else:
                known = goes_on(w + run[0]) if w else None
                cut = begins(word) if known is None or _FIGURES.fullmatch(w) else not known
                if len(run) > 1 and known is None:
                    cut = begins(word)
        elif run[0] in "!?":
            cut = not (dot and word in FORMS) and not (w and not opener and goes_on(w + run[0]) and not begins(word))
        elif not w or closed:
            cut = True
        elif _NUMBER.fullmatch(w):
            cut = begins(word) if word[0].isalpha() and word[0].isupper() else word[0].isalpha() or bool(opener)
            if opener:
                cut = True
        elif _DECIMAL.fullmatch(w):
            cut = True
        elif len(w.replace(".", "")) == 1 or _DOTTED.fullmatch(w):
            if word[0].isdigit():
                cut = False
            elif word[0].isupper():
                cut = (begins(word) and not (len(word) == 1 and dot)) or bool(opener)
            else:
                cut = not word[0].isalpha()
        else:
            known = goes_on(w + ".")
            if word[0].isdigit():
                cut = not known
            elif word[0].isupper():
                cut = not known or begins(word) or bool(opener)
                if known is None and len(w) <= 4 and w[0].isupper() and not begins(word):
                    cut = False
            else:
                cut = not known if known is not None else len(w) > 2 or not regex.match(r"\p{L}", w)
                if word[0].isalpha() and _UNCASED.fullmatch(w):
                    cut = False
        if cut:
            cuts.append(end)
            start = end
            done = end
    return cuts


def _first(text: str, start: int) -> int:
    m = _VISIBLE.search(text, start)
    return m.start() if m else len(text)


def _stands_alone(text: str, span: tuple[int, int], start: int, b: int, begins, outer: bool = False) -> bool:
    """Whether a quotation or bracket begins the unit and what follows it doesn't go on with it."""
    a, e = span
    if a > _first(text, start):
        return False
    inner = text[a + 1 : e - 1].rstrip()
    rest = text[e:b].lstrip()
    if not rest:
        return True
    if not inner or not (inner[-1] in TERMINATORS or inner[-1] in CLOSERS or regex.search(THAI_END + "$", inner)):
        return False
    if rest[0] in ",;:،、，；：—–-":
        return False
    if rest[0].islower():
        m = _AFTER.match(rest)
        return begins(m.group())
    if rest[0] in PARTICLES:
        return False
    return not (regex.match(r"[^\p{Lu}]", rest) and SAYING.match(rest))


_IS_WHITE = np.zeros(0x3002, dtype=bool)
_IS_WHITE[[i for i in range(0x3001) if _WHITE.match(chr(i))]] = True


def end_at(text: str, ends: list[int]) -> list[int]:
    """For each position how many code points, white space left out, come before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    white = np.cumsum(_IS_WHITE[np.minimum(codes, 0x3001)])
    at = np.array(ends, dtype=np.int64)
    return (at - np.where(at > 0, white[at - 1] if len(white) else 0, 0)).tolist()
