import random

import pytest

from engramix.llm import leaks as L

PASSAGE = "When the nameless ferry to Phaurkaimu brought no maps, a surveyor named Jhorethunne buried 553 salted mirrors and later told Thoridrane it concerned salted anchors. The week Ghelepparira painted its ropes humming, a retired pilot hid 107 frozen anchors in a cellar."


def test_myers_equals_the_table():
    def table(p, t):
        row = list(range(len(p) + 1))
        best = row[-1]
        for w in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        return best

    rnd = random.Random(2)
    for _ in range(400):
        p, t = ([rnd.choice("abc") for _ in range(rnd.randint(1, n))] for n in (9, 20))
        assert L.myers(p, t) == table(p, t)


def changed(words, edits, rnd):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words))
        how = rnd.choice(("replace", "spell", "drop", "add"))
        if how == "drop":
            words.pop(at)
        elif how == "add":
            words.insert(at, "quietly")
        else:
            words[at] = "borrowed" if how == "replace" else words[at] + "x"
    return words


def test_pigeonhole_loses_nothing():
    rnd = random.Random(4)
    matcher = L.Matcher([(1, PASSAGE)])
    sentence = L.words(PASSAGE.split(". ")[0])
    for _ in range(150):
        edits = rnd.randint(0, len(sentence) // 5)
        text = "Before it all. " + " ".join(changed(sentence, edits, rnd)).upper() + " and so on and on"
        assert matcher.items_in(text) == {1}


def test_runs_of_twelve():
    ws = PASSAGE.split()
    matcher = L.Matcher([(1, PASSAGE)])
    for a in range(0, 16):
        assert matcher.items_in("x " + " ".join(ws[a : a + 12]) + " y") == {1}
    assert matcher.items_in("x " + " ".join(ws[2:13]) + " y") == set()
    assert matcher.items_in("​".join("x " + "  ".join(ws[3:15]).replace(",", " —"))) == {1}


def test_rows(spark):
    docs = spark.createDataFrame([(1, "so " + PASSAGE, 7), (1, "so " + PASSAGE, 7), (2, None, 7), (3, "", 7), (None, PASSAGE, 7), (4, "words " * 30000 + PASSAGE, 7), (5, "When was Phaurkaimu mentioned?", 7)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(9, PASSAGE, "q"), (9, PASSAGE, "q"), (8, None, "q"), (7, "", "q"), (None, PASSAGE, "q")], "item_id long, passage string, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in L.leaks(docs, items).collect())
    assert got == [("1", 9), ("4", 9), ("None", 9)]
    assert L.leaks(docs, items.where("false")).count() == 0 and L.leaks(docs.where("false"), items).count() == 0


@pytest.mark.parametrize("sentence", ["昨天晚上我们在图书馆里讨论了新的预算和会议室的安排。", "昨日の夜、図書館で新しい予算と会議室の予約について話し合いました。", "เมื่อคืนนี้เราคุยกันเรื่องงบประมาณใหม่และการจองห้องประชุมในห้องสมุด"])
def test_scripts_without_spaces(spark, sentence):
    """A sentence leaks with one character changed, and in the middle of a clause; another one doesn't."""
    other = sentence[:6] + "们" + sentence[7:]
    docs = [(1, f"前面的话{sentence}后面的话"), (2, f"x {other} y"), (3, "今天我们去公园散步，然后吃了午饭，谈了很多别的事情。"), (4, "วันนี้อากาศดีมากและเราไปเดินเล่นที่สวนสาธารณะกับเพื่อน")]
    found = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, sentence)], "item_id long, passage string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7), (2, 7)]
