import hashlib
import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from ledgerlight.llm import substring_dedup as S
from ledgerlight.llm.queries import op1_substring_dedup


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    first = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        w = split(text)
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < doc:
                gone.update(range(i, i + 50))
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def digests(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in df.collect())


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op1_substring_dedup(spark, d).collect())
    assert got == brute(rows) and sum(r[2] for r in got) > 0


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10**6))
def test_spliced_passages_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(30 if k % 3 else 2)}" for _ in range(rng.randrange(45, 140))] for k in range(8)]
    rows = []
    for doc in range(80):
        text = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(0, 30)
            text += [f"n{rng.randrange(400)}" for _ in range(rng.randrange(0, 40))] + p[a : len(p) - rng.randrange(0, 20)]
        rows.append((doc, rng.choice([" ", "\t ", "\n"]).join(text)))
    rng.shuffle(rows)
    assert digests(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_defined_cases(spark):
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(5, same), (5, same), (6, same + " tail"), (7, None), (8, ""), (9, "a " * 30_000), (10, "a " * 49), (11, "b a " + "a " * 60), (12, "é ß " * 40), (13, "é ß " * 40)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(None, same, "y")], "doc_id long, text string, kept string")
    got = S.remove_repeats(docs)
    assert digests(got.where("doc_id is not null")) == brute(rows)
    assert [(r["n_words"], r["n_removed"]) for r in got.where("doc_id is null").collect()] == [(60, 0)]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_unitigs_are_the_unbranched_chains(spark):
    """Nodes are numbers; 1-2-3 is a chain, 4 and 5 leave one node, 6-7 are a circle, 8-9-...-28 a long chain."""
    rows = [(1, 10, 11, 5), (2, 11, 12, 7), (3, 12, 13, 2), (4, 13, 14, 1), (5, 13, 15, 1), (6, 20, 21, 3), (7, 21, 20, 4)]
    rows += [(8 + i, 100 + i, 101 + i, 1) for i in range(21)]
    got = {r["path"]: (r["unitig"], r["off"]) for r in S.unitigs(spark.createDataFrame(rows, "path long, head long, tail long, n int")).collect()}
    want = {1: (1, 0), 2: (1, 5), 3: (1, 12), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0)} | {8 + i: (8, i) for i in range(21)}
    assert got == want


def test_long_copies_become_one_span(spark):
    """Compaction leaves one span for a passage that two documents share, however many windows it has."""
    rng = random.Random(4)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(600)]
    rows = [(i, " ".join([f"a{i}{j}" for j in range(30)] + passage + [f"z{i}{j}" for j in range(30)])) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = docs.mapInArrow(S.occurrences, S.FOUND)
    shared = found.groupBy("path").agg(F.countDistinct("doc_id").alias("d")).where("d = 4").select("path")
    repeated = found.join(shared, "path")
    first = repeated.groupBy("path").agg(F.min(F.struct("doc_id", F.element_at("pos", 1).alias("pos"))).alias("f"), F.min("head").alias("head"), F.min("tail").alias("tail"), F.min("n").alias("n"))
    paths = first.select("path", F.col("f.doc_id").alias("source"), F.col("f.pos").alias("source_pos"), "head", "tail", "n")
    spans = S.spans_of_paths(repeated, paths).collect()
    assert len(spans) == 3 and all(r["source"] == 0 and r["pos"] == r["source_pos"] and 480 < r["n"] <= 551 for r in spans)
    assert digests(S.remove_repeats(docs)) == brute(rows)


def test_a_span_is_cut_only_where_the_words_agree():
    tokens = [b"w%d" % i for i in range(80)]
    good = S.span_digest(tokens, 10, 3)
    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": b" ".join(tokens).decode(), "spans": [{"pos": 10, "n": 3, "digest": good}, {"pos": 0, "n": 1, "digest": b"x" * 16}, {"pos": 60, "n": 5, "digest": good}]}])
    out = next(S.cut(iter([batch]))).to_pylist()[0]
    assert out["n_removed"] == 52 and out["kept"].split()[:11] == [f"w{i}" for i in range(10)] + ["w62"]


def test_rows_that_share_an_id(spark):
    """Each row of an id is cut by its own words; the windows of all rows of an id are one document's."""
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(90))
    rows = [(1, "x " * 70), (1, passage + " q"), (2, "y " + passage), (2, passage), (2, "nothing here"), (3, "x " * 60)]
    assert digests(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
