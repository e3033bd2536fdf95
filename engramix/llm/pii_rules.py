"""Candidates for personal data in one text, their features, and the skip-chain conditional random field."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import regex

from engramix.llm.name_forms import TITLES

LABELS = ("other", "email", "phone", "id_number", "address", "name")
OTHER, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)

# Parts of addresses in several languages.
_WAY = r"(?:Street|St\.|St|Avenue|Ave\.|Ave|Road|Rd\.|Rd|Lane|Ln\.?|Crescent|Cres\.?|Drive|Close|Court|Square|Way|Boulevard|Blvd\.?|Terrace|Gardens|Grove|Hill|Row|Mews)"
_WAY_SMALL = r"(?:street|avenue|ave|road|lane|crescent|drive|terrace|boulevard)"
_TOWN = r"\p{Lu}[\p{L}\p{M}'’-]+(?: \p{Lu}[\p{L}\p{M}'’-]+)?"
_POST = r"(?:\p{Lu}{1,2}\d[\p{Lu}\d]? ?\d\p{Lu}{2}|\p{Lu}{2} \d{5}(?:-\d{4})?)"
_END = rf"(?:[,\s]\s*{_TOWN},? {_POST})?"
_CODE = rf"(?:, (?:\p{{Lu}}{{1,2}}-)?\d{{4,5}} {_TOWN.split('(?:')[0]}(?![\p{{L}}]))?"
_ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \w+, )?\d{{1,5}}\p{{L}}?(?:(?: [NSEW]\.)?(?: \p{{Lu}}[\p{{L}}\p{{M}}'’-]+){{1,3}} (?:{_WAY}|{_WAY.upper()})|(?: [nsew]\.)? \p{{Ll}}[\p{{Ll}}\p{{M}}'’-]+ {_WAY_SMALL})(?![\p{{L}}])(?:,? (?:Apt\.?|Flat|Unit|Suite|#) ?\w+)?{_END}"
    rf"|P\.? ?O\.? Box \d+{_END}"
    rf"|(?:(?:Am|An der|Auf dem|Im|Zum|Zur|Alte|Alter|Neue) )?\p{{Lu}}[\p{{L}}\p{{M}}-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|graben|ufer|ring|damm|markt|steig) \d{{1,4}} ?[a-z]?(?:/\d+)?(?![\p{{L}}\d]){_CODE}"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours) (?:de la |de l['’]|des |du |de |d['’])?[\p{{L}}\p{{M}}'’-]+{_CODE}"
    rf"|(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Camino|Via|Rua) ?(?:de la |de los |de las |del |de )?\p{{Lu}}[\p{{L}}\p{{M}}'’-]+,? \d{{1,4}}(?:, \d{{1,2}}\.?[ºª°]? ?\p{{Lu}}?)?(?![\p{{L}}\d]){_CODE}"
    rf")"
)
_HOST = r"[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?"
_EMAIL = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}._%+@-])[\p{{L}}\d](?:[\p{{L}}\d._%+-]*[\p{{L}}\d])?(?: ?[@＠] ?(?:{_HOST}\.)+[\p{{L}}\d]+| ?[\[(](?i:at)[\])] ?{_HOST}(?:(?:\.| ?[\[(](?i:dot)[\])] ?){_HOST})+| (?i:at) {_HOST}(?: (?i:dot) {_HOST})+)(?![\p{{L}}\p{{N}}@])"
)
_SPOKEN = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
# Ways of writing telephone and identity numbers; which of them a number is, is left to the model.
_NUMBER = regex.compile(
    r"(?<![\p{L}\p{N}_@#.:/+\-–])(?:"
    r"\+\d{1,3}(?: ?\(0\) ?|[ .\-/])\d{1,5}(?:[ .\-/]\d{2,8}){1,4}|\+\d{9,14}"
    r"|00\d{2} \d{1,4}[ /-]\d{5,9}"
    r"|\(\d{2,5}\) ?\d{3,6}(?:[ -]\d{2,5})?"
    r"|\d{2}([-. ])\d{2}\1\d{2}\1\d{2}\1\d{2}"
    r"|\d{3}([-–. ])\d{2}\2\d{4}"
    r"|(?:1([-. ])|)\d{3}([-. ])\d{3}\4\d{4}"
    r"|0\d{2,4}[ /]\d{4,6}[ -]\d{2,4}|0\d{2} \d{4} \d{4}|0\d{3,4}[ /-]\d{5,7}"
    r"|\p{L}{2}([ -]?)\d{2}\5\d{2}\5\d{2}\5\p{L}"
    r"|\d{2}\.\d{3}\.\d{3}-?\p{Lu}|\d{8}[- ]?\p{Lu}"
    r"|\p{Lu}\d ?\d{3} ?\d{4}|\p{Lu}\d{8}|\p{Lu}\d{7}\p{Lu}|\p{Lu}\d{2}\p{Lu}\d{5}"
    r"|\d{2}([ /])\d{3}\6\d{3}\6?\d{3}"
    r"|\d{9,11}"
    rf"|{_SPOKEN}(?:[ -]{_SPOKEN}){{6,}}"
    r")(?![\p{L}\p{N}_@]|[.:/\-–]\d)"
)
_DIGIT = regex.compile(r"\d")
# No number of any kind has fewer digits, or more between two of them than this.
_SIX_DIGITS = regex.compile(r"\d(?:[^\d\n]{0,4}\d){5}")
_SPOKEN_RUN = re.compile(rf"{_SPOKEN} {_SPOKEN} (?:{_SPOKEN} ){{4}}")
# The same tokens, where only those with a capital are wanted; and letters, to see whether a small given name may be there.
_CAPITAL = regex.compile(r"(?<!\p{L}[\p{M}'’\-]*)\p{Lu}[\p{L}\p{M}'’\-]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARK = re.compile("[\u0300-\u036f]")
_TOKEN = regex.compile(r"[\p{L}][\p{L}\p{M}'’\-]*")
WORDS = regex.compile(r"\S+")
_CUE = regex.compile(r"[\p{L}\p{M}#/]+")
_BREAK = regex.compile(r"(?<=[.!?…])\s+|\n")
_PLACEHOLDER = regex.compile(r"<\p{L}[\p{L}_ ]*>|\[\p{L}[\p{L}_ ]*\]|\{\p{L}[\p{L}_ ]*\}")
# Words that name the kind of number that follows; they make the labels of the training sample.
SEEDS = (
    (ID, frozenset("id ausweisnummer documento passport dni identity ssn personalausweis nif steuernummer".split())),
    (PHONE, frozenset("tel phone call nummer telefon teléfono teléphone number reach mobile ring".split())),
    (OTHER, frozenset("run ticket rows order build checksum version page line lane room at links commit".split())),
)


def has_numbers(text: str) -> bool:
    """Whether a number of any kind may be in a text."""
    return _SIX_DIGITS.search(text) is not None or _SPOKEN_RUN.search(text) is not None


def shape(text: str) -> str:
    """Digits as 0 and letters as a or A, other characters as they are."""
    return "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in text)


def _before(text: str, start: int, reach: int) -> list[str]:
    """Words of the same sentence before a number."""
    return [w.lower() for w in _CUE.findall(_BREAK.split(text[max(0, start - reach) : start])[-1])]


def number_features(text: str, start: int, end: int) -> list[str]:
    """Features of a number: its shape, its first digits, and the words around it."""
    value = text[start:end]
    digits = "".join(c for c in value if c.isdigit())
    before = _before(text, start, 48)[-4:]
    after = [w.lower() for w in _CUE.findall(_BREAK.split(text[end : end + 32])[0])][:3]
    s = shape(value) if len(digits) >= 5 else "spoken"
    return [f"s={s}", f"s2={s}{digits[:2]}", f"n={len(digits)}", f"n2={len(digits)}{digits[:2]}"] + [f"b={w}" for w in before] + [f"a={w}" for w in after] + [f"b1={w}" for w in before[-1:]]


def seed_of(text: str, start: int, end: int, least: int = 0) -> int | None:
    """Label of a number for training, where a word before it settles its kind; one before ``least``, where another number ends, belongs to that."""
    if text[start] == "+":
        return PHONE
    near = {part for w in _before(text, start, min(32, start - least))[-3:] for part in w.split("/")}
    return next((label for label, words in SEEDS if near & words), None)


def token_features(token: str, given: frozenset[str], firm: frozenset[str], common: frozenset[str]) -> list[str]:
    """Features of a word by itself: spelling, and whether it is known as given name, word of firms or common word."""
    low = token.lower()
    case = "U" if len(token) == 1 else "A" if token.isupper() else "T" if token[0].isupper() else "a"
    out = [f"c={case}", f"g={low in given}", f"f={low in firm}", f"w={low in common}", f"l={min(len(low), 12)}"]
    if len(low) > 2:
        out += [f"e3={low[-3:]}", f"e4={low[-4:]}", f"p3={low[:3]}", f"gc={case}{low in given}{low in common}"]
    return out


#: What is believed of mail addresses, addresses and links before any label is seen; training moves it.
WHOLE = {"mail": 6.0, "host=0": -12.0, "place": 5.0}
LINKS = (4.5, 0.45, 1.0)


def mail_features(value: str) -> list[str]:
    """Features of a mail address: whether its host is only digits, and how it is written."""
    host = regex.split(r"[@＠]", value)[-1].strip()
    return ["mail", f"host={'0' if regex.fullmatch(r'[0-9.]+', host) else 'a'}", f"at={'@' if '@' in value or '＠' in value else 'word'}", f"dots={min(host.count('.'), 3)}"]


def place_features(value: str) -> list[str]:
    """Features of an address: what it begins with, and whether a postal code or a town follows."""
    return ["place", f"first={'0' if value[0].isdigit() else 'a'}", f"code={bool(regex.search(r'[0-9]{4,}', value))}", f"parts={min(len(value.split()), 6)}"]


@dataclass
class Model:
    """Weights of a trained field and the word lists it uses."""

    given: frozenset[str] = frozenset()
    firm: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    number: dict[str, np.ndarray] = field(default_factory=dict)  # feature -> weights of other, phone, id_number
    word: dict[str, float] = field(default_factory=dict)  # feature -> weight of name
    whole: dict[str, float] = field(default_factory=lambda: dict(WHOLE))  # feature -> weight of a mail address or an address
    links: tuple[float, float, float] = LINKS  # two names side by side, a name beside another word, two similar candidates with unlike labels
    _cache: dict = field(default_factory=dict)

    def whole_score(self, features: list[str]) -> float:
        return sum(self.whole.get(f, 0.0) for f in features)

    def word_score(self, token: str) -> float:
        got = self._cache.get(token)
        if got is None:
            if len(self._cache) > 300_000:
                self._cache.clear()
            got = -20.0 if token.lower() in TITLES else sum(self.word.get(f, 0.0) for f in token_features(token, self.given, self.firm, self.common))
            self._cache[token] = got
        return got

    def number_scores(self, text: str, start: int, end: int) -> np.ndarray:
        total = np.zeros(3)
        for f in number_features(text, start, end):
            w = self.number.get(f)
            if w is not None:
                total += w
        return total


@dataclass
class Nodes:
    """Nodes of many texts: text number, span, scores of the labels, key of similar nodes, and chain links."""

    doc: list = field(default_factory=list)
    start: list = field(default_factory=list)
    end: list = field(default_factory=list)
    scores: list = field(default_factory=list)
    key: list = field(default_factory=list)
    links: list = field(default_factory=list)


#: A word that scores less than this for a name is no node: only names on both of its sides that are certain could lift it further.
HOPELESS = -8.0
#: Strength of a skip link between candidates that are alike but not equal.
ALIKE = 0.5
_NEVER = -30.0


def _row(**scores: float) -> list[float]:
    return [scores.get(label, _NEVER) for label in LABELS]


def add_nodes(nodes: Nodes, doc: int, text: str, model: Model) -> None:
    """Appends the candidates of ``text``: whole mail addresses, addresses and numbers, and single words of names."""
    taken: list[tuple[int, int]] = [m.span() for m in _PLACEHOLDER.finditer(text)] if any(c in text for c in "<[{") else []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def node(a: int, b: int, scores: list[float], key: str) -> int:
        nodes.doc.append(doc)
        nodes.start.append(a)
        nodes.end.append(b)
        nodes.scores.append(scores)
        nodes.key.append(key)
        return len(nodes.doc) - 1

    low = text.lower()
    if "@" in text or "＠" in text or "at)" in low or "at]" in low or " dot " in low:
        for m in _EMAIL.finditer(text):
            if free(*m.span()):
                node(*m.span(), _row(other=0.0, email=model.whole_score(mail_features(m.group()))), "@" + m.group().lower())
                taken.append(m.span())
    has_digit = _DIGIT.search(text) is not None
    if has_digit:
        for m in _ADDRESS.finditer(text):
            if free(*m.span()):
                node(*m.span(), _row(other=0.0, address=model.whole_score(place_features(m.group()))), "/" + " ".join(m.group().lower().replace(",", " ").split()))
                taken.append(m.span())
    if has_digit and _SIX_DIGITS.search(text) or _SPOKEN_RUN.search(text):
        for m in _NUMBER.finditer(text):
            if free(*m.span()):
                s = model.number_scores(text, *m.span())
                node(*m.span(), _row(other=s[0], phone=s[1], id_number=s[2]), "#" + "".join(c for c in m.group().lower() if c.isalnum()))
                taken.append(m.span())
    # Words: those with a capital, and small ones beside a known given name.
    given, score = model.given, model.word_score
    spans = []
    plain = given.isdisjoint(_LETTERS.findall(text)) and not _MARK.search(text)
    for m in (_CAPITAL if plain else _TOKEN).finditer(text):
        token = m.group()
        if not (plain or token[0].isupper() or token in given):
            continue
        a, b = m.span()
        if token[-2:] in ("'s", "’s"):
            token, b = token[:-2], b - 2
        token = token.rstrip("'’-")
        b = a + len(token)
        spans.append((token, a, b))
        if token[0].islower():  # a small given name: the words beside it are candidates too
            for n in (_TOKEN.match(text, b + 1), _last_word(text, a)):
                if n is not None and n.group()[0].islower() and 2 < len(n.group()):
                    spans.append((n.group(), *n.span()))
    last = None
    taken.sort()
    k = 0
    for token, a, b in sorted(set(spans), key=lambda s: s[1]):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        s = score(token)
        if s < HOPELESS:
            continue
        if text[a - 1 : a] in "@_/\\#=`" and a or text[b : b + 1] in ("@", "_", "(", "=", "`") or (text[b : b + 1] == "." and text[b + 1 : b + 2].isalpha()) and len(token) > 1:
            continue
        i = node(a, b, _row(other=0.0, name=s), token.lower())
        if last is not None:
            j, end, small = last
            gap = text[end:a]
            if gap in (" ", ", ", ". ", "\xa0", " \n", "\n", "  ", ".", " ", ",\xa0", "\r\n") and (gap[0] != "." or end - nodes.start[j] == 1) and small == token[0].islower():
                nodes.links.append((j, i))
        last = (i, b, token[0].islower())


def _last_word(text: str, before: int):
    at = before - 1
    if at < 1 or text[at] not in " \xa0":
        return None
    b = at
    while at > 0 and (text[at - 1].isalpha() or text[at - 1] in "'’-"):
        at -= 1
    return _TOKEN.match(text, at, b) if at < b else None


def alike(key: str) -> str | None:
    """What similar candidates share: the last seven digits of a number, the house and street of an address, the first letter and the
    consonants of a word, which a vowel or a doubled letter doesn't change. None for short ones."""
    if key[0] == "#":
        digits = "".join(c for c in key if c.isdigit())
        return "#" + digits[-7:] if len(digits) > 8 else None
    if key[0] == "/":
        return "/" + " ".join(key[1:].split()[:3])
    if key[0] == "@":
        return "@" + key[1:].split("@")[0].split(" at ")[0].split("＠")[0]
    if len(key) < 5:
        return None
    out = key[0]
    for c in key[1:]:
        if c not in "aeiouyäöüáéíóúàèìòùâêîôûаеёиоуыэюя" and c != out[-1]:
            out += c
    return "~" + out if len(out) > 2 else None


def skip_links(nodes: Nodes) -> list[tuple[int, int, float]]:
    """(node, node, strength): each candidate with the last equal one of its text, and with the last alike one; an initial with the last name that begins so."""
    equal: dict[tuple, int] = {}
    near: dict[tuple, int] = {}
    initial: dict[tuple, int] = {}
    out = []
    for i, (d, key) in enumerate(zip(nodes.doc, nodes.key)):
        j = equal.get((d, key))
        if j is not None:
            out.append((j, i, 1.0))
        equal[d, key] = i
        form = alike(key)
        if form is not None:
            j = near.get((d, form))
            if j is not None and nodes.key[j] != key:
                out.append((j, i, ALIKE))
            near[d, form] = i
        if key[0].isalpha():
            if len(key) == 1:
                j = initial.get((d, key))
                if j is not None:
                    out.append((j, i, ALIKE))
            elif nodes.scores[i][NAME] > 0:
                initial[d, key[0]] = i
    return out


def infer(nodes: Nodes, model: Model, rounds: int = 6, skips: bool = True) -> np.ndarray:
    """Label of each node by loopy max-sum message passing over chain and skip links of all texts at once."""
    n = len(nodes.doc)
    if not n:
        return np.zeros(0, dtype=np.int64)
    unary = np.array(nodes.scores, dtype=np.float32)
    distant = skip_links(nodes) if skips else []
    edges = np.array(nodes.links + [(i, j) for i, j, _ in distant], dtype=np.int64).reshape(-1, 2)
    if not len(edges):
        return unary.argmax(1)
    kind = np.zeros(len(edges), dtype=np.int64)
    kind[len(nodes.links) :] = 1
    strength = np.ones(len(edges), dtype=np.float32)
    strength[len(nodes.links) :] = [w for _, _, w in distant]
    size = len(LABELS)
    together, beside, unlike = model.links
    pair = np.zeros((2, size, size), dtype=np.float32)
    pair[0, NAME, NAME] = together
    pair[0, NAME, OTHER] = pair[0, OTHER, NAME] = -beside
    pair[1] = -unlike * (1 - np.eye(size))
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    kinds = np.concatenate([kind, kind])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    theta = pair[kinds] * np.concatenate([strength, strength])[:, None, None]
    message = np.zeros((len(src), size), dtype=np.float32)
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, dst, message)
        out = (total[src] - message[back])[:, :, None] + theta
        fresh = out.max(1)
        fresh -= fresh.max(1, keepdims=True)
        if np.abs(fresh - message).max() < 1e-3:
            break
        message = 0.3 * message + 0.7 * fresh
    total = unary.copy()
    np.add.at(total, dst, message)
    return total.argmax(1)


def link_rows(nodes: Nodes, known: dict[int, bool], model: Model) -> np.ndarray:
    """(score, names beside it, names less others beside it, names less others among its skip links, whether a name, 1) of each
    word of which ``known`` tells whether it is of a name. The labels of all other nodes are those that the field gives them."""
    if not known:
        return np.zeros((0, 6))
    labels = infer(nodes, model)
    for i, is_name in known.items():
        labels[i] = NAME if is_name else OTHER
    side: dict[int, list[int]] = {}
    for i, j in nodes.links:
        side.setdefault(i, []).append(j)
        side.setdefault(j, []).append(i)
    far: dict[int, list[tuple[int, float]]] = {}
    for i, j, w in skip_links(nodes):
        far.setdefault(i, []).append((j, w))
        far.setdefault(j, []).append((i, w))
    out = []
    for i in sorted(known):
        names = sum(labels[j] == NAME for j in side.get(i, ()))
        others = sum(labels[j] == OTHER for j in side.get(i, ()))
        same = sum(w if labels[j] == NAME else -w for j, w in far.get(i, ()))
        out.append((nodes.scores[i][NAME] - nodes.scores[i][OTHER], names, names - others, same, known[i], 1))
    return np.array(out, dtype=float)


def likelihood(x: np.ndarray, unary: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-likelihood of a logistic regression, then its gradient, then what its Hessian is less than 0 by; rows count ``n`` times."""
    z = unary + x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    value = (n * (y * z - np.logaddexp(0, z))).sum()
    return np.concatenate([[value], x.T @ (n * (y - p)), ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()])


def link_sums(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pseudo-likelihood of the links over rows of ``link_rows``; parts of the rows add up."""
    return likelihood(rows[:, 1:4], rows[:, 0], rows[:, 4], rows[:, 5], w)


def settled(sums, prior: np.ndarray, hold: float, rounds: int = 50) -> np.ndarray:
    """The weights of the highest likelihood by Newton's method; ``hold`` is how much those from before hold them back,
    so that few labels move them little."""
    k = len(prior)

    def at(w):
        s = sums(w)
        return s[0] - hold / 2 * ((w - prior) ** 2).sum(), s[1 : k + 1] - hold * (w - prior), s[k + 1 :].reshape(k, k) + hold * np.eye(k)

    w = prior.astype(float)
    value, grad, bent = at(w)
    for _ in range(rounds):
        step = np.linalg.solve(bent, grad)
        if np.abs(step).max() < 1e-6:
            break
        while np.abs(step).max() >= 1e-9:
            got = at(w + step)
            if got[0] >= value:
                break
            step = step / 2
        else:
            break
        w = w + step
        value, grad, bent = got
    return w


def fit_links(sums, model: Model, hold: float = 25.0) -> tuple[float, float, float]:
    """Weights of chain and skip links by pseudo-likelihood, which ``sums`` adds up over all rows."""
    return tuple(float(v) for v in np.clip(settled(sums, np.array(model.links), hold), 0.05, 12.0))


def find(texts: list, model: Model) -> list[tuple[int, int, int, int]]:
    """(text number, start, end, label) of the personal data in ``texts``; null and empty ones have none."""
    nodes = Nodes()
    for d, text in enumerate(texts):
        if text:
            add_nodes(nodes, d, text, model)
    labels = infer(nodes, model)
    linked = {j: i for i, j in nodes.links}
    onward = dict(nodes.links)
    out = []
    for i, label in enumerate(labels.tolist()):
        if label == OTHER:
            continue
        if label != NAME:
            out.append((nodes.doc[i], nodes.start[i], nodes.end[i], label))
            continue
        if i in linked and labels[linked[i]] == NAME:
            continue
        run = [i]
        while run[-1] in onward and labels[onward[run[-1]]] == NAME:
            run.append(onward[run[-1]])
        out += _names(run, nodes, texts[nodes.doc[i]], model)
    return out


def _names(run: list[int], nodes: Nodes, text: str, model: Model) -> list[tuple[int, int, int, int]]:
    """A run of name words is one name: a family name with a given name or initial, or nothing."""
    words = [text[nodes.start[i] : nodes.end[i]] for i in run]
    long = [w for w in words if len(w) > 1]
    if not long or len(words) < 2:
        return []
    if len(words) > 3:  # names that stand side by side: each begins with a given name
        for cut in range(2, len(words) - 1):
            if words[cut].lower() in model.given and words[cut - 1].lower() not in model.given:
                return _names(run[:cut], nodes, text, model) + _names(run[cut:], nodes, text, model)
    end = nodes.end[run[-1]]
    if len(words[-1]) == 1 and text[end : end + 1] == ".":
        end += 1
    return [(nodes.doc[run[0]], nodes.start[run[0]], end, NAME)]
