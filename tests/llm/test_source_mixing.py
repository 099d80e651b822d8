import math
import re

import numpy as np
import pytest

from ledgerlight.llm import source_mixing as M
from ledgerlight.llm.queries import op10_source_mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        level = left / sum(w[s] for s in free) if free else 0
        more = {s for s in free if w[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else w[s] * level for s in order}
        full |= more


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op10_source_mixing(spark, d).collect()
    assert len(got) == len(docs)
    by, taken = {}, {}
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"] or ""))
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[s] = by.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    want = targets(by)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["source_size"] == by[s] and r["target"] == pytest.approx(want[s], rel=1e-9)
    for s in by:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s]
    assert sorted(map(tuple, got)) == sorted(map(tuple, op10_source_mixing(spark, d).collect()))


def test_nulls_repeats_and_empty(spark):
    rows = [(i, f"w{i} " * (i % 40 + 1), ("a", "b", None)[i % 3], "x") for i in range(300)] + [(1000, None, "a", None), (1001, "", "empty", None), (None, "q r", "a", None), (7, "w7 " * 8, "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    mixed = M.mix_sources(docs)
    assert mixed.columns == docs.columns
    got, given = mixed.collect(), {}
    for r in rows:
        given.setdefault(r[2], []).append(len((r[1] or "").split()))
    want = targets({s: sum(x) for s, x in given.items()})
    for s, sizes in given.items():
        n = sum(len((r["text"] or "").split()) for r in got if r["source"] == s)
        assert abs(n - want[s]) <= max(40, 0.02 * want[s])
    assert M.mix_plan(docs.limit(0)).count() == 0 and M.mix_sources(docs.limit(0)).count() == 0


def rates(given, want, cap=2.0):
    """source -> (size -> rate), by bisection over all its documents."""
    out = {}
    for s, sizes in given.items():
        x = np.array([n for n in sizes if n > 0], float)
        if not len(x):
            out[s] = {}
            continue
        mean = x.sum() / len(x)
        rate = lambda lam: np.exp(np.minimum(lam * x / mean, math.log(cap)))  # noqa: B023, E731
        lo, hi = -1e6, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if (x * rate(mid)).sum() > want[s] else (mid, hi)
        r = np.full(len(x), cap) if want[s] >= cap * x.sum() * (1 - 1e-12) else rate(hi)
        out[s] = dict(zip(x.astype(int).tolist(), r.tolist(), strict=True))
    return out


def test_copies_are_the_rates_of_brute_force_rounded(spark):
    d = "/root/testdata/sf0.001"
    given = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        given.setdefault(r["source"], []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))
    want = targets({s: sum(x) for s, x in given.items()})
    rate = rates(given, want)
    for r in M.mix_plan(spark.read.parquet(f"{d}/documents.parquet")).collect():
        if r["size"]:
            x = rate[r["source"]][r["size"]]
            assert r["copies"] in (math.floor(x + 1e-6), math.floor(x - 1e-6), min(2, math.floor(x + 1e-6) + 1))


def test_no_document_is_taken_more_than_twice(spark):
    """Large groups of equal rows beside long documents: the carry of a group must not lift a full document."""
    rows = [(d, "w " * (20 + d), "a") for d in range(40) for _ in range(30)] + [(100 + d, "w " * (400 + 11 * d), "a") for d in range(40)]
    rows += [(200 + d, "w " * 900, "b") for d in range(40)] + [(300, "w " * 60_000, "c"), (301, None, "c"), (302, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = M.mix_plan(docs).collect()
    assert all(0 <= r["copies"] <= 2 for r in plan) and max(r["copies"] for r in plan) == 2
    given, taken = {}, {}
    for r in plan:
        given[r["source"]] = given.get(r["source"], 0) + r["size"] * r["n"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["n"] * r["copies"]
    want = targets(given)
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] for s in ("a", "b"))


def test_clashing_names_and_a_table_of_many_sources(spark, monkeypatch):
    rows = [(i, f"w{i} " * (i % 9 + 1), f"s{i % 5}", i, "t") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _words int, copies string")
    few = sorted(map(tuple, M.mix_sources(docs).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 1)
    many = M.mix_sources(docs)
    assert many.columns == docs.columns and sorted(map(tuple, many.collect())) == few
