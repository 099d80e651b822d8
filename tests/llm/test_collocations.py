import pickle
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlight.llm import collocations as C
from ledgerlight.llm import queries


def plain(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang or "und", tuple(words[i : i + size])] += 1
    out = []
    many = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, p), a in many.items():
        inside = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        assert inside
        longer = [b for (x, q), b in many.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), a, left, right))
    ranks, done = Counter(), []
    for lang, score, _, p, a, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            done.append((lang, ranks[lang], p.decode(), a, left, right, n[lang], -score))
    return sorted(done)


def found(df, least=C.LEAST, top=C.TOP):
    return sorted(tuple(r) for r in C.collocations(df, least, top).collect())


def phrases(draw, n, words):
    rows = {tuple(draw.choice(words) for _ in range(draw.randint(2, 4))) for _ in range(n)}
    rows |= {r[:k] for r in rows for k in range(2, len(r))}
    return np.array([[*r, *[0] * (4 - len(r))] for r in sorted(rows)], np.uint64)


@pytest.mark.parametrize("n, words", [(1, 3), (40, 3), (400, 9), (3000, 2000)])
def test_tries_find_just_their_phrases(n, words):
    draw = random.Random(n)
    w = phrases(draw, n, range(1, words + 1))
    trie = C.build_trie(w)
    assert len(trie.check) < 4 * len(w) + 2 * words + 1100
    text = np.array([draw.randint(0, words + 2) for _ in range(5000)], np.uint64)
    want = {tuple(r[r > 0].tolist()) for r in w}
    keys = {tuple(r[r > 0].tolist()): int(C.phrase_keys(r[r > 0][None, :])[0]) for r in w}
    got = set()
    for size, (at, states) in enumerate(trie.levels(text.astype(np.int32)), start=1):
        for i, s in zip(at.tolist(), states.tolist(), strict=True):
            p = tuple(text[i : i + size].tolist())
            got.add((i, p))
            if size > 1:
                assert trie.keys[s] == keys[p]
    assert {(i, p) for i, p in got if len(p) > 1} == {(i, tuple(text[i : i + k].tolist())) for k in (2, 3, 4) for i in range(len(text) - k + 1) if tuple(text[i : i + k].tolist()) in want}


def test_reader_numbers_words_by_language_and_ends_pieces(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 8)
    reader = C.Reader(0)
    text = "One two,one\ttwo\n\nÜber TWO x".encode()
    ids = np.concatenate([*reader.read("en", text)]).tolist()
    said = [reader.names[k][1].decode() for k in ids]
    assert said == ["one", "two", "", "one", "two", "", "", "Über", "two", "x", *[""] * 4]
    one = reader.index["en"][b"one"]
    other = np.concatenate([*reader.read("de", b"one")]).tolist()
    assert other[0] != one and reader.hashes[other[0]] != reader.hashes[one]


def some_rows():
    draw = random.Random(3)
    words = ["a", "b", "c", "of", "the", "Of", "ü", "x-y", "THE", "rare"]
    weights = [9, 8, 7, 9, 9, 2, 4, 2, 1, 1]
    rows = [(draw.choice(["en", "de", None]), " ".join(draw.choices(words, weights, k=draw.randint(0, 40))) + draw.choice([".", "", ", a b c", "\ta b"])) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("en", "a, b. c"), *[("en", "one same line of text here")] * 12]
    return rows


def test_full_readers_and_early_sums_count_the_same(monkeypatch):
    rows = [(lang or "und", text or "") for lang, text in some_rows()]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})

    def sums(batches):
        out = Counter()
        for b in batches:
            *names, n = b.columns
            for row in zip(*(c.to_pylist() for c in names), n.to_pylist(), strict=True):
                out[row[:-1]] += row[-1]
        return out

    class Known:
        value = np.zeros(0, np.uint64)

    def both():
        counted = sums(C.count_words([batch], 0))
        Known.value = np.sort(np.array([h for h, *_ in counted], np.int64).view(np.uint64))
        return counted, sums(C.frequent_pairs(C.encoded([batch], 0, Known)))

    whole = both()
    for name, value in {"HELD": 50, "BLOCK": 64}.items():
        monkeypatch.setattr(C, name, value)
    monkeypatch.setattr(C.Reader, "LIMIT", 12)
    assert whole == both()


@pytest.mark.parametrize("nodes", [C.NODES, 7])
def test_collocations_equal_brute_force(spark, monkeypatch, nodes):
    monkeypatch.setattr(C, "NODES", nodes)
    rows = some_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for top in (5, 2000):
        want = plain(rows, 8, top)
        assert want and found(df, 8, top) == want


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "lang string, text string, n long, rank string")
    assert found(empty) == []
    odd = spark.createDataFrame([(None, "b a " * 40, 1, "x"), ("", None, 2, "y")], "lang string, text string, n long, rank string")
    got = found(odd, 30)
    assert {r[0] for r in got} == {"und"} and all(r[6] == 80 for r in got)


def test_products_may_pass_64_bits(spark, monkeypatch):
    monkeypatch.setattr(C, "SCALE", 2 * 10**18)
    df = spark.createDataFrame([("en", "a b. " * 50)], "lang string, text string")
    assert [r[7] for r in found(df)] == [10**18]


def test_whole_table_is_read(spark):
    df = queries.op12_phrase_collocations(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {}
    for r in docs:
        text = re.sub("[.,;:!?\n\x0b\x0c\r]", " ", r["text"] or "")
        want[r["lang"] or "und"] = want.get(r["lang"] or "und", 0) + len([w for w in re.split("[ \t]+", text) if w])
    assert {(r["lang"], r["n"]) for r in df.collect()} <= {*want.items()}


def test_sums_of_packed_phrases(monkeypatch):
    for slice_ in (C.SLICE, 1):
        monkeypatch.setattr(C, "SLICE", slice_)
        rows = [b.to_pydict() for b in C.emitted(iter([(np.array([5, 5, 4]), np.array([7, 7, 9])), (np.array([5]), np.array([8]))]))]
        assert [(*x,) for b in rows for x in zip(*b.values(), strict=True)] == [(4, 9, 1), (5, 7, 2), (5, 8, 1)]
    assert [*C.emitted(iter([(np.zeros(0, np.int64),)]))] == []
    assert C.matrix(pa.RecordBatch.from_pydict({"head": [(7 << 32) | 8], "tail": [9 << 32]})).tolist() == [[7, 8, 9, 0]]


def test_workers_get_small_batches_and_settings_are_set_back(spark, monkeypatch):
    usual, seen, own = {k: spark.conf.get(k) for k in C.BATCHES}, [], C.ranked_phrases

    def watched(docs, least, top):
        seen.append({k: spark.conf.get(k) for k in C.BATCHES})
        return own(docs, least, top)

    monkeypatch.setattr(C, "ranked_phrases", watched)
    rows = [("en", "a b c a b. a b")] * 40
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(df) == plain(rows, C.LEAST, C.TOP)
    assert all(seen[0][k] == small for k, (_, small) in C.BATCHES.items()) and {k: spark.conf.get(k) for k in C.BATCHES} == usual
    key = next(iter(C.BATCHES))
    spark.conf.set(key, "77")
    try:
        found(df)
        assert seen[1][key] == "77" == spark.conf.get(key)
    finally:
        spark.conf.set(key, usual[key])


def test_tries_pass_the_driver_without_keys_and_pickled_rows(spark, monkeypatch):
    def refused(self, *args, **kwargs):
        assert "binary" not in dict(self.dtypes).values(), "rows of large arrays were pickled for the driver"
        return own(self, *args, **kwargs)

    monkeypatch.setattr(C, "NODES", 300)
    w = phrases(random.Random(5), 900, range(1, 400)).astype(np.int64)
    df = spark.createDataFrame([((a << 32) | b, (c << 32) | d) for a, b, c, d in w.tolist()], "head long, tail long")
    own = type(df).collect
    monkeypatch.setattr(type(df), "collect", refused)
    tries, built = C.shared_tries(df)
    monkeypatch.undo()
    stored = {r["shard"]: np.frombuffer(r["keys"], np.uint64) for r in built.select("shard", "keys").collect()}
    for r in built.select("shard", "base", "check").collect():
        assert len(r["base"]) + len(r["check"]) < 7 * len(tries[r["shard"]].value.check), "the driver got arrays that aren't compressed"
    assert len(tries) > 3 and stored.keys() == tries.keys()
    for shard, t in tries.items():
        assert len(stored[shard]) == len(t.value.check) and not len(t.value.keys)
        assert len(pickle.dumps(t.value)) < 8 * len(t.value.check) + 8 * len(t.value.alphabet) + 1000
    C.forget(tries.values())


@pytest.mark.parametrize("part, fan_in", [(5, 1), (64, 2)])
def test_counts_meet_keys_in_parts(spark, monkeypatch, part, fan_in):
    for name, value in {"PART": part, "FAN_IN": fan_in, "NODES": 9}.items():
        monkeypatch.setattr(C, name, value)
    rows = some_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert found(df, 8) == plain(rows, 8, C.TOP)
