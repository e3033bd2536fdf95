from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engramix.llm import sentence_rules as S
from engramix.llm import sentences as U

CORPUS = ["The list is long. We wait. Please check it. It ran.", "In short it works. Why did it run? The end.", "See esp. the list, approx. 3 of it, vs. last year.", "Who asked? Really?! version 2 of the list ran. version 3 ran.", "version 4 of it.", "Die Liste ist lang. Am Abend war es so. Das gilt am Tag."] * 3


@pytest.fixture(scope="module")
def known():
    starts, inside, marks = Counter(), Counter(), Counter()
    for t in CORPUS:
        S.starter_counts(t, starts, inside)
    first = S.Evidence(starts, inside, {})
    for t in CORPUS:
        S.mark_counts(t, first.begins, marks)
    return S.Evidence(starts, inside, marks)


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Quorley lost it at 3 p.m. on Friday. ", "The list ran."],
        ["Several parts (esp. the list, approx. 19 % of it) ran. ", "We wait."],
        ["It fell to 0.64, i.e. below 4.5, when it ran.\n\n", "The end."],
        ["“Ship it. We can always roll back,” said Haverin. ", "The list ran."],
        ["“The list is long.” ", "We wait. ", "(The list ran.) ", "It ended."],
        ["«Подождём. Завтра продолжим», — сказал А. Б. Тарровин. ", "Хор вернул список."],
        ["La Dra. Haverin preguntó «¿quién perdió la lista?» y se fue. ", "¿¡En serio!? ", "Anoche, todo."],
        ["Am 6. und 22. Tag lief es. ", "Die Liste ist lang."],
        ["„Wir warten. Morgen geht es weiter“, sagte Drumlark. ", "Am Abend war es so."],
        ["“先等等。明天再继续。”负责人这样说。", "计划员（见第3.3节）返回了。", "真的吗？！", "预算表移动了。"],
        ["「少し待ちます。明日続けます。」と担当が言いました。", "値は2.76％です。"],
        ["“रुकिए। कल देखेंगे।” ऐसा उन्होंने कहा। ", "डॉ. वेरा ने कहा कि यह ठीक है।"],
        ["قال د. ترون إن البرنامج جيد. ", "لماذا؟ ", "حقاً؟!"],
        ["ระบบค้นหาเก็บครับ", "ค่าอยู่ที่ 6.58 เปอร์เซ็นต์ค่ะ ", "ดูไฟล์ config.toml ก่อนนะคะ"],
        ["# The list\n", "- one thing\n", "* another thing\n", "The list\nis long."],
        ["Maren: The list ran. ", "We wait.\n", "[12:40] Sefa: It ran.\n", "**Oda** We wait.\n", "ILVY > The end."],
        ["Well... maybe the list ran. ", "version 2 of it ran."],
    ],
)
def test_units(known, units):
    text = "".join(units)
    cuts = S.sentences(text, known)
    assert [text[a:b].strip() for a, b in zip([0, *cuts], cuts)] == [u.strip() for u in units]


def test_positions_leave_white_space_out():
    assert S.end_at("a b.​ c d", [5, 9]) == [4, 6]


def test_rows(spark):
    df = spark.createDataFrame([(1, "The list ran. We wait.", 1), (1, "The list ran. We wait.", 1), (2, None, 1), (3, " ​\n", 1), (4, "", 1), (None, "We wait", 2), (5, "The list ran. " * 3000, 3)], "doc_id long, text string, n int")
    got = U.sentence_units(df).collect()
    assert Counter(str(r["doc_id"]) for r in got) == {"1": 4, "None": 1, "5": 3000}
    assert max(r["end_at"] for r in got if r["doc_id"] == 1) == 18
    assert U.sentence_units(df.where("false")).count() == 0


class Heard(S.Evidence):
    """Evidence that answers by a seed and keeps what it was asked of the corpus."""

    def __init__(self, seed):
        self.words, self.keys = set(), set()
        outer = self

        class Words:
            def get(self, word, default=None):
                outer.words.add(word)
                return (seed * 7 + sum(map(ord, word))) % 3

        class Marks(Words):
            def get(self, key, default=None):
                outer.keys.add(key[0])
                return (seed * 5 + sum(map(ord, key[0])) + key[1]) % 3

        super().__init__(Words(), Words(), Marks(), holds=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aBc .!?…。“”\"'’)(«»]-3Ⅷ\n\x1c​", "Dr.", "approx.", "the", "List", "3.5", "! ", ". ", "? \"", ".” ", "ครับ", "说", "é", "（", "）", "\xa0", "* ", "1. ", "Oda: "]), max_size=40).map("".join), st.integers(0, 5))
def test_asked_holds_all_that_is_asked(text, seed):
    heard = Heard(seed)
    S.sentences(text, heard)
    words, marks = S.asked(text)
    assert heard.words <= words and heard.keys <= marks


def test_rare_words_are_evidence_too(spark, monkeypatch):
    """Words below the share that is broadcast are joined to the documents that may ask for them, with the same units."""
    texts = [*CORPUS, "Dr. Quorley lost approx. Three of it. quillix ran. It ran.", "They saw Zorvane. quillix ran. Nobody saw it, esp. Zorvane.", "quillix waits.\n\nquillix ran.", "A list of zorvane ran!"] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, U.sentence_units(df).collect()))
    starts, inside, marks = Counter(), Counter(), Counter()
    for t in texts:
        S.starter_counts(t, starts, inside)
    first = S.Evidence(starts, inside, {})
    for t in texts:
        S.mark_counts(t, first.begins, marks)
    whole = S.Evidence(starts, inside, marks, holds=True)
    want = sorted((i, no, at) for i, t in enumerate(texts) for no, at in enumerate(S.end_at(t, S.sentences(t, whole)), 1))
    assert rows() == want
    for share in (5, 1):
        monkeypatch.setattr(U, "SHARE", share)
        assert not U.evidence(df.selectExpr("text as t"))[1].isEmpty()
        assert rows() == want
