import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlight.llm import queries, token_alignment as ta
from ledgerlight.llm.packing import tokenizer_path

ODD = [
    "a", "b", "the", "ing", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'", "’", "İ", "é", "ß", "▁", "　", "\xa0", "中", "文", "。", "0", "12", "<s>", "<|endoftext|>",
    "<0x41>", "!", "...", "\x00", "\x1c", "½", "é", "Foo", "🙂", "﻿", "​", "_.", " don't", ";\r", ".", ",",
]


@pytest.fixture(scope="module")
def tool():
    return ta.Aligner.of(tokenizer_path(ta.FIRST), tokenizer_path(ta.SECOND))


def plain(tool, text):
    """Whole texts through both tokenizers, ends compared as sets."""
    none = 0, 0, 0, "", []
    if not text:
        return none
    full = " " + text
    a, b = tool.a.encode(full, add_special_tokens=False).ids, tool.b.encode(text)
    if any(b"".join(own[x] for x in ids) != full.encode() for own, ids in ((tool.bytes_a, a), (tool.bytes_b, b))):
        return none
    ends_a, ends_b = ({e: k for k, e in enumerate(np.cumsum([len(own[x]) for x in ids]).tolist())} for own, ids in ((tool.bytes_a, a), (tool.bytes_b, b)))
    groups, links, i, j = [], [], 0, 0
    for end in sorted(ends_a.keys() & ends_b.keys()):
        x, y = ends_a[end], ends_b[end]
        groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
        links.append((a[x], b[y]))
        i, j = x + 1, y + 1
    return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def found(tool, text):
    *rest, links = next(ta.documents(tool, [text]))
    return *rest, [(int(c) // len(tool.bytes_b), int(c) % len(tool.bytes_b)) for c in tool.pairs[links]]


@given(st.lists(st.integers(0, 1), max_size=40), st.lists(st.integers(0, 1), max_size=40))
@settings(max_examples=300, deadline=None)
def test_common_ends_are_those_of_the_sets(x, y):
    a, b = (sorted({*np.flatnonzero(z).tolist(), 40}) for z in (x, y))
    at_a, at_b = ta.align(a, b)
    assert [a[i] for i in at_a] == [b[j] for j in at_b] == sorted({*a} & {*b})


def test_long_stretches_take_few_comparisons():
    class Counted(list):
        seen = 0

        def __getitem__(self, key):
            Counted.seen += 1
            return super().__getitem__(key)

    a = Counted(range(1, 1_000_001))
    assert ta.run_length(a, list(range(1, 1_000_001)), 0, 0) == 1_000_000
    assert Counted.seen < 50
    b = [*range(1, 700_000), *range(700_001, 1_000_002)]
    Counted.seen = 0
    assert ta.run_length(a, b, 0, 0) == 699_999
    assert Counted.seen < 500


def test_odd_texts_align_as_whole_texts_do(tool):
    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice(ODD) for _ in range(draw.randint(0, 14)))
        assert found(tool, text) == plain(tool, text), repr(text)


@pytest.mark.parametrize("letters", ["abcDEF123+/'xyzQ", "ab cd. ", "中文。字"])
def test_long_runs_and_texts_of_several_blocks(tool, letters, monkeypatch):
    monkeypatch.setattr(ta, "BLOCK", 1500)
    draw = random.Random(6)
    text = "".join(draw.choice(letters) for _ in range(20_000))
    assert found(tool, text) == plain(tool, text)


def test_stores_that_fill_up_change_nothing(tool, monkeypatch):
    monkeypatch.setattr(ta.Aligner, "LIMIT", 40)
    draw = random.Random(7)
    texts = [" ".join(draw.choice(["word", "Other", "längst", "öde,", "x.", "y!", "1,5"]) + draw.choice("abcdefgh") for _ in range(30)) + "." for _ in range(40)]
    for lo in range(0, 40, 4):
        for text, got in zip(texts[lo : lo + 4], ta.documents(tool, texts[lo : lo + 4]), strict=True):
            assert got[:4] == plain(tool, text)[:4]


def test_pairs_are_bounded_by_the_vocabularies(tool):
    assert len(tool.pairs) < 1_000_000
    assert ta.linkable([b"ab", b"b", b""], [b"b", b"cab"]).tolist() == [0, 1, 2, 3]


def test_query_equals_brute_force(spark, tool):
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in queries.op13_token_alignment(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {k: plain(tool, t) for k, t in texts.items()}
    counts = Counter(link for x in want.values() for link in x[4])
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    assert rows.keys() == want.keys()
    for k, (n_a, n_b, n, digest, links) in want.items():
        got = rows[k]
        assert (got["n_a"], got["n_b"], got["n_groups"], got["n_links"], got["groups_sha256"]) == (n_a, n_b, n, len(links), digest)
        assert got["n_best"] == sum(counts[x] == highest[x[1]] for x in links)
        assert got["count_sum"] == sum(counts[x] for x in links)


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a ▁ b", "x"), (4, "one word", "x"), (4, "one word", "y"), (None, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string")
    got = sorted(tuple(r) for r in ta.align_tokens(docs).where("doc_id is not null").collect())
    assert [r[1:] for r in got[:3]] == [(0, 0, 0, 0, 0, 0, "")] * 3
    assert got[3] == got[4] and got[3][1:6] == (2, 2, 2, 2, 2) and got[3][6] == 5
    assert ta.align_tokens(docs.where("false")).count() == 0
    assert ta.align_tokens(docs.where("doc_id is null")).first()["n_groups"] == 1
