import random
import string
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from ledgerlight.llm import language_id as L
from ledgerlight.llm.queries import op3_language_id


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op3_language_id(spark, d).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) < 0.02 * len(got)


def test_defined_cases(spark):
    rows = [(i, "der die und das nicht ein haus " * 3, "de", "a") for i in range(30)] + [(i, "the and of house is not a " * 3, "en", "b") for i in range(30, 60)]
    odd = [(90, None, "en", None), (91, "", "en", None), (92, "12 34 !?", None, None), (93, "und das haus", None, None), (93, "und das haus", None, None), (94, "the house " * 50_000, None, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = L.fit(docs, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in L.predict(docs, model).collect() if r["doc_id"] >= 90}
    assert got == {90: ("und", True), 91: ("und", True), 92: ("und", True), 93: ("de", False), 94: ("en", False)}
    assert L.predict(docs, model).count() == 66
    kept = L.keep_identified(docs, F.lit(True))
    assert kept.columns == docs.columns and {r["score"] for r in kept.where("doc_id < 60").collect()} == {"a", "b"}
    empty = L.fit(docs.limit(0), F.lit(True))
    assert empty.languages == [] and {r["lang_pred"] for r in L.predict(docs, empty).collect()} == {"und"}
    assert L.predict(docs.limit(0), model).count() == 0
    far = spark.createDataFrame([(1, "жёлтый дом стоит на горе " * 3)], "doc_id long, text string")
    assert L.predict(far, model).first()["rejected"]


def test_ties_go_to_the_first_language():
    c = np.zeros((L.DIMS, 2), np.float32)
    c[:] = 1 / np.sqrt(L.DIMS)
    model = L.LanguageModel(np.ones(L.DIMS), ["aa", "bb"], c, np.array([0, 1]), np.zeros((2, L.SIZES)))
    assert model.predict(b"any text")[0] == "aa"


def test_thresholds_by_length():
    rng = np.random.default_rng(1)
    sizes = np.repeat(np.arange(6, 14), 100)
    cosines = 0.02 * sizes + 0.02 + 0.02 * rng.random(len(sizes))
    t = L.thresholds(["x", "y"], [("x", sizes, cosines), ("y", sizes[:5], cosines[:5])])
    assert (np.diff(t[0, 6:14]) >= 0).all() and (t[0] <= L.MOST).all() and t[0, 39] == t[0, 14] and t[0, 4] < t[0, 6]
    assert t[1, 10] == L.SHARE * np.quantile(cosines[sizes == 10], L.QUANTILE)


def test_foreign_and_junk_texts_are_rejected_and_clean_ones_kept(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = L.fit(docs, ~held)
    rng = random.Random(7)
    russian = "вчера вечером мы долго гуляли по старому городу и говорили о книгах которые читали в детстве потом пошёл дождь и мы вернулись домой "
    chinese = "昨天晚上我们在老城区散步谈论小时候读过的书后来下雨了我们就回家了今天早上天气很好我去公园跑步看见很多人在打太极拳"
    finnish = "eilen illalla kävelimme pitkään vanhassa kaupungissa ja puhuimme kirjoista joita luimme lapsina sitten alkoi sataa ja palasimme kotiin "
    junk = []
    for n in (60, 200, 1000, 5000):
        junk += [(russian * 90)[:n], (chinese * 200)[: n // 2], "".join(rng.choice(string.ascii_lowercase + "  ") for _ in range(n)), "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))]
        if n > 60:
            junk.append((finnish * 90)[:n])
    found = [model.predict(x.encode()) for x in junk]
    assert all(r[2] for r in found), [(len(x), x[:20], r) for x, r in zip(junk, found, strict=True) if not r[2]]
    clean = [r for r in docs.where(held).collect() if r["text"]]
    kept = [model.predict(r["text"].encode()) for r in clean]
    print("rejected", sum(r[2] for r in kept), "of", len(kept), "right", sum(k[0] == r["lang"] for k, r in zip(kept, clean, strict=True)))
    assert sum(r[2] for r in kept) <= 0.005 * len(kept)
    for short in ("The cat is here.", "Das ist nicht gut.", "Et de la.", "A."):
        assert not model.predict(short.encode())[2] or len(L.letters(short.encode())) >= L.LEAST


def test_very_long_text(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = L.fit(docs, F.lit(True))
    text = next(r["text"] for r in docs.collect() if r["lang"] == "de" and r["text"] and r["n_chars"] > 300)
    assert model.predict((text + " ").encode() * 3000)[:1] == ("de",)


def test_long_texts_count_block_by_block(monkeypatch):
    text = L.letters("Straße und Wege, día y año ".encode() * 40)
    whole = L.term_counts(text)
    monkeypatch.setattr(L, "BLOCK", 7)
    assert (L.term_counts(text) == whole).all() and whole.sum() == 3 * len(text) - 6


@pytest.mark.parametrize("text", ["½", "²³ ①", "123 !?", "", None, "\u0307"])
def test_texts_without_a_letter_are_unknown(spark, text):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de")], "doc_id long, text string, lang string")
    model = L.fit(docs, F.lit(True))
    assert model.predict(text.encode() if text is not None else None) == ("und", 0.0, True)
    assert model.predict("½ the cat".encode())[0] == "en"


def test_query_equals_plain_nearest_centroids(spark):
    """Dense vectors from n-grams counted one by one, compared with every centroid."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = L.fit(docs.select("doc_id", "text", "lang"), ~held)
    got = {r["doc_id"]: r for r in op3_language_id(spark, d).collect()}
    rows = docs.collect()
    assert got.keys() == {r["doc_id"] for r in rows}
    for r in rows:
        raw = b" " + b" ".join(r["text"].encode().translate(L.LETTERS).split()) + b" "
        v = np.zeros(L.DIMS)
        for n, m in enumerate(L.MULTIPLIERS, start=2):
            for i in range(len(raw) - n + 1):
                v[(int.from_bytes(raw[i : i + n]) * m % 2**32) >> (32 - L.DIM_BITS)] += 1
        v = np.log1p(v) * model.idf
        cosines = (v / (np.linalg.norm(v) or 1)) @ model.centroids
        best = int(cosines.argmax())
        assert got[r["doc_id"]]["lang_pred"] == model.languages[model.owner[best]]
        assert got[r["doc_id"]]["score"] == pytest.approx(cosines[best], abs=1e-4)
