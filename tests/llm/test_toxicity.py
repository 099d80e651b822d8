import random

import numpy as np
import pytest

from ledgerlight.llm import queries
from ledgerlight.llm import toxicity as X
from ledgerlight.llm.common import documents, held_out


@pytest.mark.parametrize(
    "text, words",
    [
        ("You 1d10t, $tupid l0ser!! trash###", "you idiot stupid ioser trash"),
        ("Іdiоt", "idiot"),
        ("5 cats & 10 dogs", "cats dogs"),
        ("ÉTÉ réeuxpa", "été réeuxpa"),
        ("$$$ a$$et", "asset"),
        (None, ""),
        ("", ""),
        ("123 !?", ""),
    ],
)
def test_folding(text, words):
    assert X.fold(text).split() == words.split()
    assert X.fold(text)[0] == X.fold(text)[-1] == " " and "  " not in X.fold(text)


def plain_hits(model, folded):
    """Longest entry at each blank, unless an exception phrase covers it."""
    covered = set()
    for e in model.exceptions:
        for k in range(len(folded)):
            if folded.startswith(e, k):
                covered |= set(range(k, k + len(e) - 1))
    out = []
    for k in range(len(folded)):
        own = [e for e in model.weights if folded.startswith(e, k)]
        if own and k not in covered:
            out.append((k, model.weights[max(own, key=len)]))
    return out


def test_automaton_equals_brute_force():
    model = X.ToxicityModel({" idi": 1.5, " idiot ": 4.0, " sc": 2.0, " scum ": 5.0, " bad": 2.5}, frozenset({" scun ", " not bad ", " bad hat "}), (-3.0, 1.0, 1.0))
    draw = random.Random(1)
    words = ["idiot", "idiom", "scum", "scun", "scab", "not", "bad", "badly", "hat", "so"]
    for _ in range(300):
        folded = X.fold(" ".join(draw.choice(words) for _ in range(draw.randint(0, 12))))
        assert sorted(model.hits(folded)) == plain_hits(model, folded)
        assert 0 <= model.score(folded) <= 1
    assert model.measured(X.fold("a bad hat, not bad"))[0] == 0
    assert model.score(X.fold("idiot")) > model.score(X.fold("idiot " + "so " * 50)) > model.score(X.fold("so"))


def test_curve_tells_counts_apart():
    step, size = np.array([0, 0, 8, 8, 20, 20]), np.array([10] * 6)
    curve = X.fitted_curve(step, size, np.array([0, 1, 0, 1, 0, 1]), np.array([1000, 5, 30, 30, 2, 200]))
    chance = [1 / (1 + np.exp(-np.dot(X.shaped(s * X.STEP, 2**5.25), curve))) for s in (0, 8, 20)]
    assert chance[0] < 0.05 < 0.2 < chance[1] < 0.8 < 0.9 < chance[2]


def made(spark, n=400):
    """Every fifth document swears; `bad hat` is harmless; one swearing text comes in many copies."""
    draw = random.Random(2)
    common = [f"wo{a}{b}" for a in "aeiou" for b in "mnprs"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [draw.choice(common) for _ in range(draw.randint(20, 60))]
        if toxic:
            words = [w for k, w in enumerate(words) for w in ([w, draw.choice(["bad", "m0ron", "sсum"])] if k % 7 == 0 else [w])]
        elif i % 9 == 1:
            words[5:5] = ["bad", "hat"]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs += [(n + i, "only here zebra quagga moron scum bad", "x") for i in range(40)]
    labels += [(n + i, 1) for i in range(40)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_lexicon_exceptions_and_copies(spark):
    docs, labels = made(spark)
    model = X.fit(docs, labels.unionByName(labels), ~held_out(3, 1))
    assert {" moron ", " scum "} <= model.weights.keys()
    assert " bad hat " in model.exceptions
    assert not any("zebra" in e or "quagga" in e for e in model.weights)
    rows = X.score(docs, model).join(labels, "doc_id").collect()
    assert len(rows) == docs.count()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97
    new = spark.createDataFrame([(1, "a M0R0N, and such ѕcum you are"), (2, "he has a bad hat and other hats"), (3, None), (3, ""), (None, "scum scum")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in X.score(new, model).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and got[None]["predicted"] == 1
    assert got[3]["score"] < 0.1


def test_nothing_to_learn(spark):
    docs, labels = made(spark, 50)
    for some in (labels.where("toxic = 0"), labels.where("false"), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        model = X.fit(docs, some, ~held_out(3, 1))
        assert model.weights == {} and {r["score"] for r in X.score(docs, model).collect()} == {0.0}
    assert X.score(docs.where("false"), X.ToxicityModel({})).count() == 0


def test_long_text():
    model = X.ToxicityModel({" scum ": 5.0}, frozenset(), (-3.0, 1.0, 1.0))
    assert model.measured(X.fold("scum word " * 200_000)) == (1_000_000.0, 400_000)
    assert model.score(X.fold("x" * 3_000_000)) < 0.1


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.75), ("sf0.1", 0.8)])
def test_held_out_documents(spark, sf, least):
    path = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = queries.op11_toxicity(spark, path).join(labels, "doc_id").where("held_out").collect()
    caught = [r["predicted"] for r in rows if r["toxic"]]
    wrong = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(caught) > least and np.mean(wrong) < 0.01
    assert documents(spark, path).count() == queries.op11_toxicity(spark, path).count()
