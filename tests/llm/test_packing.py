import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlight.llm import packing as P
from ledgerlight.llm import packing_plan as L
from ledgerlight.llm.queries import op2_best_fit_packing


def laid_out(plan):
    """sequence -> [(offset, length)]"""
    out = {}
    for length, _, n, first, offset in plan.runs:
        for s in range(first, first + n):
            out.setdefault(s, []).append((offset, length))
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plan_places_all_and_leaves_no_gap(histogram):
    plan = L.plan(histogram, 64)
    sequences = laid_out(plan)
    assert set(sequences) == set(range(plan.sequences))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    for length, n in histogram.items():
        ranks = sorted((r, r + c) for x, r, c, _, _ in plan.runs if x == length)
        assert ranks[0][0] == 0 and ranks[-1][1] == n and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:], strict=False))


def test_knapsack_equals_brute_force():
    rng = random.Random(1)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(2, 20), 4)))
        prices, most = np.array([rng.random() for _ in lengths]), np.array([rng.randint(1, 3) for _ in lengths])
        config = L.best_configuration(prices, lengths, most, 30)
        got = sum(prices[i] * n for i, n in config)
        grid = np.array(np.meshgrid(*[range(m + 1) for m in most])).reshape(4, -1)
        assert sum(lengths[i] * n for i, n in config) <= 30
        assert got == pytest.approx((prices @ grid)[lengths @ grid <= 30].max())


def test_near_the_lower_bound():
    rng = random.Random(3)
    lengths = [min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000)]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    assert L.plan(histogram, 4096).sequences <= sum(lengths) / 4096 * 1.005 + 1


@pytest.mark.parametrize("n, mu", [(3000, 6.5), (40_000, 6.5), (40_000, 5.0)])
def test_the_program_places_nearly_all_items_near_its_bound(n, mu):
    rng = np.random.default_rng(n)
    lengths = np.minimum(4096, rng.lognormal(mu, 1.2, n).astype(int) + 1)
    histogram = {int(x): int(c) for x, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = L.plan(histogram, 4096)
    print(n, mu, plan.sequences, plan.bound, plan.configurations, plan.by_program / n)
    assert plan.by_program >= 0.9 * n
    assert plan.bound <= plan.sequences <= plan.bound * (1 + 2 * L.TOLERANCE) + 1 <= plan.bound + plan.configurations


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), min_size=1, max_size=5))
def test_dearest_configuration_equals_brute_force_and_the_bound_holds(histogram):
    lengths = np.array(sorted(histogram))
    prices = np.random.default_rng(len(histogram)).random(len(lengths))
    value = [0.0]
    for c in range(1, 25):  # brute force: any number of each
        value.append(max([value[c - 1], *(value[c - x] + p for x, p in zip(lengths.tolist(), prices, strict=True) if x <= c)]))
    assert L.dearest(prices, lengths, 24) == pytest.approx(value[24])
    plan = L.plan(histogram, 24)
    assert plan.bound <= plan.sequences + 1e-9


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(P.tokenizer_path())
    expected = []
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(r["doc_id"], k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    got = op2_best_fit_packing(spark, d).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    check_layout(got)
    assert len({r["sequence_id"] for r in got}) <= sum(x[3] for x in expected) / 4096 * 1.03 + 1


def check_layout(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096


def test_nulls_repeats_long_and_empty(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (2, "word " * 9000, "z"), (3, "", None), (4, "x<|endoftext|>y É ﬁn it's 12ab", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = P.pack(docs).collect()
    t = Tokenizer.from_file(P.tokenizer_path())
    ids = np.array([*t.encode(rows[5][1], add_special_tokens=False).ids, 1], "<u4")
    assert [r["ids_crc32"] for r in got if r["doc_id"] == 4] == [zlib.crc32(ids.tobytes())]
    assert sorted((r["doc_id"] or 0, r["piece"], r["length"]) for r in got if r["doc_id"] != 4) == [(0, 0, 3), (1, 0, 1), (1, 0, 1), (2, 0, 4096), (2, 1, 4096), (2, 2, 809), (3, 0, 1)]
    check_layout(got)
    assert P.pack(docs.limit(0)).count() == 0


WORDS = ["DENİZLİ.", "İ,", "Lİ!?", "naïve", "NAÏVE", "ΑΣ", "İstanbul", "e\u0301t", "don't", "it's", "x1y", "ñ", "ﬁn", "日本", "ß", "<|endoftext|>", "<|ENDOFTEXT|>", "a,b.", "--", "É.", "\u00a0z", "ǅ", "aͅ", "K"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(WORDS), st.text(max_size=8)), max_size=12), st.sampled_from([" ", "\t", "\n ", ""]))
def test_ids_word_by_word_equal_ids_of_the_text(words, joint):
    text = joint.join(words).encode("utf-8", "ignore").decode()
    tokens = P.WordTokens.of(P.tokenizer_path())
    want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert next(tokens.encode([text.encode()])).tolist() == want


def test_odd_words_before_marks_keep_their_ids():
    draw = random.Random(9)
    letters = [*"aZé1İıßſŉǰΐẖΣς٣½①", "\u0307", "\u0301", "\u0345", "\u200d", *P.MARKS, "'s", "-", " "]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 7))) for _ in range(30_000)]
    tokens = P.WordTokens(P.tokenizer_path())
    want = [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for lo in range(0, len(texts), 256):
        for text, ids, own in zip(texts[lo : lo + 256], tokens.encode([x.encode() for x in texts[lo : lo + 256]]), want[lo : lo + 256], strict=True):
            assert ids.tolist() == own, repr(text)
