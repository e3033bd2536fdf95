import pytest

from engramix.llm import pii
from engramix.llm import pii_rules as R

PEOPLE = [f"{g} {s}" for g in ("Anna", "Viktor", "Selma", "Hugo", "Lena") for s in ("Tarevmont", "Bosulwick", "Hivelberg", "Kodansen", "Rumisholm", "Pelavski")]
FIRMS = ["Zalorix Marine Holdings", "Burelax Marine Partners", "Tivorum Dental Holdings", "Kelupex Dental Partners", "Wanorix Marine Partners", "Honelax Dental Holdings"] * 3


@pytest.fixture(scope="module")
def model(spark):
    lines = [f"My ID number is {n}." for n in ("982-77-9501", "QQ520414B", "00774882N", "01 090 747 447")] + [f"Call me on {p} after six." for p in ("+44 20 7946 0283", "030 23125 839", "4155550112", "07700 900886", "three one two five five five oh one four seven")]
    lines += ["Ticket #11 links to run 1710441044.", "Rows 1320-1953 were skipped.", "The planner moved the list and the team agreed to wait.", "Their list is long and the planner will wait."] * 3
    texts = spark.createDataFrame([(t,) for t in lines * 5], "t string")
    spans = spark.createDataFrame([(p, "PERSON") for p in PEOPLE] + [(f, "ORG") for f in FIRMS], "text string, entity_type string")
    return pii.train(texts, spans, spark.createDataFrame([], "display_name string"))


def found(model, text):
    return sorted((R.LABELS[label], text[a:b]) for _, a, b, label in R.find([text], model))


@pytest.mark.parametrize(
    "text,want",
    [
        ("Write to <oda.pell+x@post.corvel.example> now, not to loader@2.94.0 or @here.", [("email", "oda.pell+x@post.corvel.example")]),
        ("Contact: ilvy-m.58 at saltreach dot example", [("email", "ilvy-m.58 at saltreach dot example")]),
        ("We live at 191 Dunmarrow Ave\nSaltreach BZ9 3QT.", [("address", "191 Dunmarrow Ave\nSaltreach BZ9 3QT")]),
        ("Wir wohnen Haverinweg 64, 06635 Saltreach. Lane 34 of the queue is stuck.", [("address", "Haverinweg 64, 06635 Saltreach")]),
        ("Call me on +44 20 7946 0283 after six.", [("phone", "+44 20 7946 0283")]),
        ("two oh six five five five oh one one eight is the best way", [("phone", "two oh six five five five oh one one eight")]),
        ("My ID number is QQ 52 04 14 B.", [("id_number", "QQ 52 04 14 B")]),
        ("Ticket #11 links to run 1710441044.", []),
        ("Thanks, Viktor Tarevmont! Ask Bosulwick, Selma first.", [("name", "Bosulwick, Selma"), ("name", "Viktor Tarevmont")]),
        ("Anna thinks that [PERSON] wrote <phone>.", []),
        ("anna hivelberg agreed, says Dr. Hugo Kodansen.", [("name", "Hugo Kodansen"), ("name", "anna hivelberg")]),
        ("Zalorix Marine Holdings wants it.", []),
        ("", []),
    ],
)
def test_values(model, text, want):
    assert found(model, text) == sorted(want)


def test_skip_links_carry_a_label_over(model):
    nodes = R.Nodes()
    for i in range(2):
        nodes.doc.append(0)
        nodes.start.append(i)
        nodes.end.append(i + 1)
        nodes.key.append("#same")
    nodes.scores = [[0.0, -30.0, 4.0, -30.0, -30.0, -30.0], [0.0, -30.0, -0.5, -30.0, -30.0, -30.0]]
    assert R.infer(nodes, model).tolist() == [R.PHONE, R.PHONE]


def test_rows_with_nulls_repeats_and_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, "Call me on 07700 900886 after six.", "x", 1), (1, "Call me on 07700 900886 after six.", "x", 1), (2, None, None, None), (3, "", "y", 2), (None, "My ID number is QQ520414B." + " words" * 20000, "z", 3)], "row_id long, content string, text string, start int")
    got = pii.spans_of(df, "row_id", "content", model).collect()
    assert sorted((str(r["row_id"]), r["pii_type"], r["pii_value"]) for r in got) == [("1", "phone", "07700 900886")] * 2 + [("None", "id_number", "QQ520414B")]
    clean = pii.redact(df, "row_id", "content", model).collect()
    assert len(clean) == 5 and sum((r["content"] or "").count("[PHONE]") for r in clean) == 2
    assert pii.spans_of(df.where("false"), "row_id", "content", model).count() == 0


def test_training_without_rows(spark):
    empty = pii.train(spark.createDataFrame([], "t string"), spark.createDataFrame([], "text string, entity_type string"), spark.createDataFrame([], "display_name string"))
    assert R.find(["a@b.example", None], empty) == [(0, 0, 11, R.EMAIL)]


@pytest.mark.parametrize(
    "text,label",
    [
        ("Call me on +44 20 7946 0283. Later: 020 7946 0283 is fine.", R.PHONE),
        ("Mail ada.p@post.example today. Or was it ada.p@mail.example?", R.EMAIL),
        ("Send it to 191 Dunmarrow Ave, Saltreach BZ9 3QT. Yes, 191 Dunmarrow Ave it is.", R.ADDRESS),
        ("Selma Hivelberg wrote. Then Hivelberrg Selma called.", R.NAME),
    ],
)
def test_skip_links_between_alike_candidates_settle_each_type(model, text, label):
    """The second candidate is written otherwise and doubtful by itself; with the first one beside it, it takes its label."""
    nodes = R.Nodes()
    R.add_nodes(nodes, 0, text, model)
    links = R.skip_links(nodes)
    assert any(strength == R.ALIKE for _, _, strength in links)
    j, i, _ = next(x for x in links if x[2] == R.ALIKE)
    nodes.scores[j] = [0.0 if k == 0 else 9.0 if k == label else -30.0 for k in range(6)]
    nodes.scores[i] = [0.0 if k == 0 else -0.2 if k == label else -30.0 for k in range(6)]
    nodes.links = []
    assert R.infer(nodes, model)[i] == label and R.infer(nodes, model, skips=False)[i] == R.OTHER


def test_links_and_scores_are_trained(spark, model):
    """Labels move the weights: names that stand side by side, and mail addresses that were no personal data."""
    pairs = [(f"I spoke with {p} about the plan of Zalorix Marine Holdings.", "I spoke with <PERSON> about the plan of Zalorix Marine Holdings.") for p in PEOPLE]
    assert pii.replaced(*pairs[0]) == [(13, 13 + len(PEOPLE[0]), R.NAME)]
    assert pii.replaced("a b c", "a [EMAIL] d") == [] and pii.replaced("x 07700 900886", "x [phone]") == [(2, 14, R.PHONE)]
    marked = [(f"{f} wants it.", "ORG", 0, 3) for f in FIRMS[:6]]
    links = pii._links([(o, pii.replaced(o, r)) for o, r in pairs], marked, model)
    assert links != R.LINKS and all(w > 0 for w in links)
    fs = R.mail_features("bot@queue.example")
    score = lambda right: sum(pii._whole_weights([(fs, right)] * 400).get(f, 0.0) for f in fs)
    assert score(False) < 1.0 and score(True) > 5.0


def test_every_row_trains_the_weights(spark):
    """Texts and placeholders beyond any sample: each has a word of its own beside its number, and each of them is learned."""
    cues = [a + b + c for a in "bdfklmnprt" for b in "aeiou" for c in "lnrst"]
    filler = [(f"The planner moved list {i}.",) for i in range(13_000)]
    texts = spark.createDataFrame(filler + [(f"Call {w} 07700 900886 after six.",) for w in cues], "t string")
    rows = [(f"Ring {w}ix 07700 {900000 + i}", [(f"Ring {w}ix [PHONE]", None, None, None)]) for i, w in enumerate(cues * 20)]
    labelled = spark.createDataFrame(rows, "content string, xs array<struct<view: string, kind: string, first: int, last: int>>")
    spans = spark.createDataFrame([(p, "PERSON") for p in PEOPLE], "text string, entity_type string")
    got = pii.train(texts, spans, spark.createDataFrame([], "display_name string"), labelled)
    assert {f"b1={w}" for w in cues} | {f"b1={w}ix" for w in cues} <= got.number.keys()
    assert {"planner", "moved", "list"} <= got.common


def test_rounds_over_executors_fit_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(pii.SEP.join(["a", f"x{i % 7}"]), i % 3, float(i)) for i in range(1, 40)], "key string, label int, n double")
    held = pii._fit(rows, 3)
    labelled = spark.createDataFrame([(f"I spoke with {p} about it.", [("I spoke with <PERSON> about it.", None, None, None)]) for p in PEOPLE] + [(f"{f} wants it.", [(None, "ORG", 0, 3)]) for f in FIRMS[:6]], "content string, xs array<struct<view: string, kind: string, first: int, last: int>>")
    links = pii._fit_links(labelled, R.Model())
    monkeypatch.setattr(pii, "HELD", 0)
    spread = pii._fit(rows, 3)
    assert held.keys() == spread.keys() and all(abs(held[f] - spread[f]).max() < 1e-6 for f in held)
    assert links != R.LINKS and pii._fit_links(labelled, R.Model()) == pytest.approx(links, abs=1e-6)


def test_a_cue_before_another_number_is_not_of_the_next():
    text = "tel +1 415 555 0173 Use 00109600-M now"
    assert R.seed_of(text, 24, 34, 19) is None and R.seed_of(text, 4, 19) == R.PHONE
