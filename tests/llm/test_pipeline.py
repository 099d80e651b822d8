import random

import corpus_pipeline
from test_packing import check_layout
from test_near_dedup import brute
from test_source_mixing import targets

from ledgerlight.llm import secret_scan

D = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        rows.append(docs.collect())
    given, spoken, single, masked, mixed = rows
    assert len(given) - len(spoken) <= 0.02 * len(given)
    component = brute([(r["doc_id"], r["text"]) for r in spoken], 80)  # stages on shingles link from 80 %
    assert {r["doc_id"] for r in single} == {d for d, (_, c) in component.items() if d == c}
    assert {(r["doc_id"], secret_scan.masked(r["text"], "[SECRET]")) for r in single} == {(r["doc_id"], r["text"]) for r in masked}
    sizes, taken = {}, {}
    for r in masked:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").encode().split())
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").encode().split())
    want, longest = targets(sizes), max(len((r["text"] or "").encode().split()) for r in masked)
    assert all(abs(taken.get(s, 0) - want[s]) <= longest for s in sizes)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    check_layout(packed)
    assert sum(1 for r in packed if r["piece"] == 0) == len(mixed)


def test_run(spark):
    got = corpus_pipeline.run(spark, D).collect()
    check_layout(got)
    assert len(got) > 0


def odd_documents(spark):
    rng = random.Random(1)
    words = {"en": "the of and house tree is not river stone walks".split(), "de": "der die und haus baum ist nicht fluss stein geht".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(8, 90))), x, ("a", "b", None)[i % 3], 0) for i in range(120) for x in [("en", "de")[i % 2]]]
    rows += [(500, None, "en", "a", None), (501, "", "de", None, 0), (None, rows[0][1], "en", "a", 1), (502, rows[1][1], None, "b", 2), (502, rows[1][1], None, "b", 2), (503, "the house " * 60_000, "en", "a", 0), (504, "password = hunter22x " + rows[3][1], "de", "c", 0)]
    return spark.createDataFrame([(*r, "k", 7, 0.5, "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, _words int, score double, size string"), rows


def test_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark):
    docs, rows = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {(r["kept"], r["_words"], r["score"], r["size"]) for r in got} == {("k", 7, 0.5, "c")}, name
        if name == "language_id":
            assert {r["doc_id"] for r in got} == {r[0] for r in rows} - {500, 501}
        elif name == "near_dedup":
            assert {500, 501, None, 503, 504} <= {r["doc_id"] for r in got} and [r["doc_id"] for r in got].count(502) == 0
        elif name == "secret_scan":
            assert len(got) == len(rows) and next(r for r in got if r["doc_id"] == 504)["text"].startswith("[SECRET] ")
        else:
            assert {r["doc_id"] for r in got} <= {r[0] for r in rows}
        assert stage(spark, docs.limit(0), D).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    check_layout(packed)
    assert sum(1 for r in packed if r["piece"] == 0) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), D).count() == 0
