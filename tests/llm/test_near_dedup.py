import random
import re

import numpy as np
import pytest

from ledgerlight.llm import common as C
from ledgerlight.llm import near_dedup as N
from ledgerlight.llm.components import connected_components
from ledgerlight.llm.queries import op7_minhash_near_dedup


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, threshold=85):
    """doc_id -> (n, component) over all pairs that share a shingle."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for own in where.values():
        for i in own[:1] if len(own) > 50 else own:
            for j in own:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    n = len(a & b)
                    if 100 * n >= threshold * (len(a) + len(b) - n):
                        x, y = sorted((root(sets[i][0]), root(sets[j][0])))
                        parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets}


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(rows)
    got = op7_minhash_near_dedup(spark, d).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_chains_of_edited_copies_and_defined_cases(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows, at = [], 0
    for _ in range(60):  # each is near the one before; the ends are far from one another
        rows.append((at, " ".join(base)))
        at += 1
        base = list(base)
        base[rng.randrange(300)] = f"x{at}"
    for _ in range(40):
        rows.append((at, " ".join(f"r{rng.randrange(50)}" for _ in range(rng.randrange(1, 60)))))
        at += 1
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A B"), (504, " a\tb\n"), (505, "word " * 30_000), (506, "word " * 20_000), (502, "a b")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(None, "a b", "y")], "doc_id long, text string, component_id string")
    for near in (N.CONTRACT, N.DEFAULT):
        want = brute(rows, near.threshold)
        got = N.near_duplicates(docs, near).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert len(got) == len(rows) + 1 and [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert N.near_duplicates(docs.limit(0)).count() == 0
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == sum(1 for d, _ in rows if want[d][1] == d) + 1


def test_links_are_hardly_ever_lost():
    assert N.DEFAULT.threshold == 80 and N.DEFAULT.lost() < 1e-6 and N.CONTRACT.threshold == 85 and N.CONTRACT.lost() < 2e-5


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """With the limits of broadcasts and hot keys low, components and a group of many near copies are the same."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(48):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    monkeypatch.setattr(C, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(C, "HOT", 10)
    monkeypatch.setattr(N, "PART", 7)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, N.CONTRACT).collect()} == want


def test_parts_of_one_document_that_are_near_each_other(spark):
    """Sets inside a hub with which they have no link: near copies among them are found, by inner keys alone."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(0, " ".join(base))] + [(1 + i, " ".join(base[: 320 - 7 * i])) for i in range(12)] + [(20 + i, " ".join(base[50 + 9 * i : 300 + 9 * i])) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for near in (N.CONTRACT, N.DEFAULT):
        want = brute(rows, near.threshold)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, near).collect()} == want


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 1 << 63, 300).astype(np.uint64)])
    s = N.signatures([np.unique(a), np.unique(b)], 2000)
    assert (s[0] == s[1]).mean() == pytest.approx(0.5, abs=0.06)


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(0, 150)] + [(500, 400 + i) for i in range(60)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def test_one_text_in_half_the_rows_and_a_third_without_words(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 20)
    words = [f"w{i}" for i in range(40)]
    text = lambda i: " ".join(words) if i % 2 else [None, "", " \t"][i % 3] if i % 3 else " ".join([*words[:35], f"x{i}", f"y{i}"])
    rows = [(i, text(i)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, " ".join(words)), (None, None)], "doc_id long, text string").repartition(4)
    got = N.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute(rows, 80)
    assert sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None) == [(0, None, True), (36, None, True)]
