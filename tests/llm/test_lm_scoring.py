import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import context_mixing as M
from ledgerlight.llm import lm_scoring as L
from ledgerlight.llm.queries import op5_lm_scoring


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def base(rows, training):
    c = Counter(x for d, t in rows if training(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(d, len(w), sum(x in c for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, t in rows for w in [tokens(t)]]


def model_of(texts):
    words = [L.tokens_of(t.encode()) for t in texts]
    seen = np.bincount(np.frombuffer(b"".join(x + b" " for w in words for x in w) + b"\n" * len(words), np.uint8), minlength=256)
    bits, code = M.table_bits(int(seen.sum())), M.Code(seen)
    tables = M.new_counts(bits)
    for w in words:
        M.add_counts(tables, code, [w], bits)
    return M.Model.of(code, bits, tables)


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    n, want = base(rows, lambda i: not held(i))
    got = sorted(op5_lm_scoring(spark, d).collect())
    assert all(r["train_tokens"] == n and r["held_out"] == held(r["doc_id"]) for r in got)
    for r, w in zip(got, sorted(want), strict=True):
        assert (r["doc_id"], r["n_tokens"], r["n_known"]) == w[:3] and r["base_score"] == pytest.approx(w[3], rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_held_out_documents_are_likelier_than_by_counts_alone(spark):
    rows = [r for r in op5_lm_scoring(spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_pieces_of_the_tables_add_up(spark, monkeypatch):
    texts = [f"the {i % 3} and of {w} b" for i, w in enumerate(["house", "tree", "stone", "river"] * 30)]
    monkeypatch.setattr(L, "FAN_IN", 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["score"] for r in L.score(docs, F.lit(True)).collect()}
    want = -model_of(texts).score([L.tokens_of(t.encode()) for t in texts]) * math.log10(2)
    assert [got[i] for i in range(len(texts))] == pytest.approx(list(want), rel=1e-6)


def test_tokens_beyond_the_head_count_as_known(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 3)
    texts = ["a a a b b c d", "a c e e f", "x y A z", None, "e e E"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, want = base(list(enumerate(texts)), lambda d: d != 2)
    got = sorted(L.score(docs, F.col("doc_id") != 2).collect())
    for r, w in zip(got, sorted(want), strict=True):
        assert (r["doc_id"], r["n_tokens"], r["n_known"]) == w[:3] and r["base_score"] == pytest.approx(w[3], rel=1e-9)


def test_frequent_tokens_are_those_of_the_highest_counts(spark, monkeypatch):
    rows = [(f"t{i}".encode(), 1 + i * i) for i in range(200)]
    counts = spark.createDataFrame(rows, "token binary, n long").repartition(5)
    for most in (0, 1, 17, 150, 1000):
        monkeypatch.setattr(L, "HEAD", most)
        tokens, n = L.frequent_tokens(counts)
        assert len(tokens) <= most and dict(zip(tokens, n.tolist(), strict=True)) == dict(sorted(rows, key=lambda r: -r[1])[: len(tokens)])
        assert len(tokens) >= min(most, 200) * 0.5 - 1
    every = L.byte_counts(spark.createDataFrame([(b"ab", 3), (b"b", 2), (b"", 4)], "token binary, n long"))
    assert {chr(i): int(x) for i, x in enumerate(every) if x} == {"a": 3, "b": 5, " ": 5, "\n": 4}


def paths(code):
    """leaf -> [(node, bit)], read off the code's arrays."""
    return [[(int(code.node[i]), int(code.sign[i] > 0)) for i in range(code.start[x], code.start[x] + code.size[x])] for x in range(M.LEAVES)]


def test_scores_equal_bit_by_bit_mixing():
    """Counts, logits, gates and weights done over again with dictionaries, one bit after another."""
    texts = ["the cat sat on the mat the cat " * 3, "a cat and a dog; the dog sat", "thé 日本 cat\x01", "mat " * 9]
    m, code = model_of(texts), None
    code = m.code
    path, prior = paths(code), M.prior_weights()
    ones, zeros, total = Counter(), Counter(), Counter()
    for t in texts:
        s = M.stream_of(code, [L.tokens_of(t.encode())], m.bits)
        for i, leaf in enumerate(s.symbols):
            for k in range(M.INPUTS):
                total[k, s.rows[k][i]] += 1
                for node, bit in path[leaf]:
                    (ones if bit else zeros)[k, s.rows[k][i], node] += 1
    level = lambda n: sum(n >= x for x in M.SEEN)
    for t in ("the cat and the mat " * 30, "zebra 日本 x", ""):
        words = L.tokens_of(t.encode())
        s, bits = M.stream_of(code, [words], m.bits), 0.0
        weights, power, lo, hi = prior.astype(float), np.full(M.GATES, M.CURVATURE), 0, M.BLOCK
        while lo < len(s.symbols):
            gradient = np.zeros_like(weights)
            more = np.zeros(M.GATES)
            for i in range(lo, min(hi, len(s.symbols))):
                rows = [int(r[i]) for r in s.rows]
                gate = level(total[2, rows[2]]) * M.LEVELS + level(total[1, rows[1]])
                logit = {n: np.array([round(M.STRETCH * math.log((ones[k, rows[k], n] + 0.4) / (zeros[k, rows[k], n] + 0.4))) / M.STRETCH for k in range(M.INPUTS)]) for n in range(M.LEAVES - 1)}
                p = {n: 1 / (1 + math.exp(-float(weights[:, gate] @ x))) for n, x in logit.items()}
                chance = [math.prod(p[n] if b else 1 - p[n] for n, b in steps) for steps in path]
                assert sum(chance) == pytest.approx(1)
                bits -= math.log2(chance[s.symbols[i]])
                bits += code.escaped[s.raw[i]]
                for n, b in path[s.symbols[i]]:
                    gradient[:, gate] += (b - p[n]) * logit[n]
                    more[gate] += float(logit[n] @ logit[n]) * p[n] * (1 - p[n])
            power += more
            weights += gradient / power
            lo, hi = hi, hi + max(M.BLOCK, hi // M.GROWTH)
        assert float(m.score([words])[0]) == pytest.approx(bits, rel=1e-3)


def test_codes_are_complete():
    rng = np.random.default_rng(2)
    for seen in (np.zeros(256, np.int64), rng.integers(0, 10**9, 256) * (rng.random(256) < 0.3), np.arange(256) ** 6):
        code = M.Code(seen)
        assert sum(2.0 ** -len(p) for p in paths(code)) == pytest.approx(1)
        rest = code.symbol == M.ESCAPE
        assert (2.0 ** -code.escaped[rest]).sum() == pytest.approx(1) and not code.escaped[~rest].any()


def test_a_document_does_not_bear_on_another():
    m = model_of(["the cat sat on the mat " * 40, "der hund und die katze " * 30])
    docs = [L.tokens_of(t.encode()) for t in ("the cat " * 200, "", "katze xyz", "die mat " * 90)]
    assert m.score(docs) == pytest.approx([float(m.score([d])[0]) for d in docs], rel=1e-5)


def test_defined_cases(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "word " * 60_000, None), (4, "É x ß", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = L.score(docs, F.lit(True)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 3), (1, 1), (1, 1), (2, 1), (3, 60_001), (4, 3)]
    none = L.score(docs, F.lit(False)).collect()
    assert {r["n_known"] for r in none} == {0} and {r["train_tokens"] for r in none} == {0}
    assert all(r["base_score"] == 0 for r in none) and all(math.isfinite(r["score"]) for r in none)
    assert L.score(docs.limit(0), F.lit(True)).count() == 0


def test_tables_grow_with_the_text_without_a_bound():
    for size in (1 << 20, 1 << 26, 1 << 31, 1 << 35):
        assert size <= 128 << M.table_bits(size) and M.hash_bits(M.table_bits(size))[1:] == (M.table_bits(size) - 1, M.table_bits(size))
    assert M.hash_bits(22)[0] == M.hash_bits(30)[0] == 3 * M.LEAF_BITS
    code = M.Code(np.arange(256))
    text = bytes(range(33, 120))
    rows, before = M.stream_of(code, [[text]], 22).rows[0], b"\n\n\n" + text
    assert len(set(rows.tolist())) == len({tuple(code.symbol[list(before[i : i + 3])]) for i in range(len(text) + 1)})


def some_texts():
    rng = np.random.default_rng(19)
    return [None if i == 7 else "" if i == 9 else " ".join(rng.choice(["the", "and", "Haus", "été", "tree", "river", "x\x01y", "of"], 1 + i % 40)) for i in range(150)]


def test_tables_in_pieces_give_the_scores_of_whole_tables(spark, monkeypatch):
    texts = some_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    training, exact = F.col("doc_id") % 3 != 1, ["doc_id", "training", "n_tokens", "n_known", "train_tokens"]
    whole = {r["doc_id"]: r for r in L.score(docs, training).collect()}
    monkeypatch.setattr(L, "WHOLE_BITS", 0)
    got = L.score(docs, training).collect()
    assert len(got) == len(texts)
    for r in got:
        want = whole[r["doc_id"]]
        assert all(r[c] == want[c] for c in exact) and [r["base_score"], r["score"]] == pytest.approx([want["base_score"], want["score"]], rel=1e-5)
    assert L.score(docs.limit(0), training).count() == 0
    none = L.score(docs, F.lit(False)).collect()
    assert len(none) == len(texts) and all(math.isfinite(r["score"]) for r in none)


def test_chunks_get_the_rows_that_they_meet_from_all_pieces(monkeypatch):
    for name, value in (("HELD", 300), ("PART_BITS", 4)):
        monkeypatch.setattr(L, name, value)
    monkeypatch.setattr(M, "INDEX_BITS", 3)
    words = [L.tokens_of((t or "").encode()) for t in some_texts()]
    train = np.arange(len(words)) % 3 != 1
    seen = np.bincount(np.frombuffer(b"".join(b" ".join(w) + b"\n" for w, t in zip(words, train, strict=True) if t), np.uint8), minlength=256)
    code, bits = M.Code(seen), 12
    tables, chunks = M.new_counts(bits), [L.Chunk() for _ in range(4)]
    M.add_counts(tables, code, [w for w, t in zip(words, train, strict=True) if t], bits)
    for lo in range(0, len(words), 10):
        chunks[lo // 10 % 4].add(code, words[lo : lo + 10], train[lo : lo + 10], bits, 1)
    entries = [(i, *x) for i, c in enumerate(chunks) for x in c.pieces()]
    sent = []
    for at in {x[1:3] for x in entries}:
        own = [x for x in entries if x[1:3] == at]
        sent += L.answered(pa.table(dict(zip(["chunk", "k", "piece", "entries"], map(list, zip(*own, strict=True)), strict=True)))).to_pylist()
    want = M.Model.of(code, bits, tables).score(words)
    for i in range(4):
        model = L.chunk_model(code, bits, pa.Table.from_pylist([x for x in sent if x["chunk"] == i]))
        assert len(model.levels[2]) < len(tables[2]) and len(model.places[2].some) == len(set(model.places[2].some.tolist()))
        own = [j for j in range(len(words)) if j // 10 % 4 == i]
        assert model.score([words[j] for j in own]) == pytest.approx(want[own], rel=1e-5)
