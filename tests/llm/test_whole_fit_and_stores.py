"""Models count all training rows, stores of words change no result, and the driver broadcasts what is asked for."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlight.llm import collocations, language_id, packing
from ledgerlight.llm.common import documents

D = "/root/testdata/sf0.01"


def test_thresholds_and_centroids_come_from_all_training_rows(spark, monkeypatch):
    docs, seen = documents(spark, D), []
    given = language_id.thresholds
    monkeypatch.setattr(language_id, "SAMPLE", 20)
    monkeypatch.setattr(language_id, "thresholds", lambda languages, samples: seen.append(samples) or given(languages, samples))
    model = language_id.fit(docs, F.lit(True))
    rows = docs.where("lang is not null and text rlike '[A-Za-z\\\\x{80}-\\\\x{10ffff}]'").groupBy("lang").count().collect()
    assert {s[0]: int(s[3].sum()) for s in seen[0]} == {r["lang"]: r["count"] for r in rows}
    assert sum(r["count"] for r in rows) > 500
    # a further pass over all rows leaves the centroids where they are
    centres = {x: model.centroids.T[model.owner == i] for i, x in enumerate(model.languages)}
    moved, counts = language_id.met(docs.where("lang is not null and text is not null").select("text", "lang"), model.idf, centres)
    assert all((moved[x] * centres[x]).sum(axis=1).min() > 0.99 for x in centres)
    assert all(counts[s[0]].sum() == s[3].sum() for s in seen[0])


def test_low_quantiles_of_counted_values():
    rng = np.random.default_rng(3)
    values, counts = rng.random(70), rng.integers(1, 40, 70)
    assert abs(language_id.low_quantile(values, counts) - np.quantile(np.repeat(values, counts), language_id.QUANTILE)) < 1e-12


def test_pieces_are_the_same_with_a_small_store(spark, monkeypatch):
    docs, asked = documents(spark, "/root/testdata/sf0.001"), []
    want = sorted(packing.pieces(docs, packing.tokenizer_path(), 4096, 1).drop("part", "nth").collect())
    assert sorted(packing.pieces(docs, packing.tokenizer_path(), 4096, 1, 60).drop("part", "nth").collect()) == want
    monkeypatch.setattr(packing, "pack", lambda df, **options: asked.append(options) or df)
    corpus_pipeline.pack(spark, docs, D)
    assert asked[0]["store"] < packing.WordTokens.LIMIT


def test_only_rows_that_are_asked_for_are_picked(spark, monkeypatch):
    table = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("f"))
    rows = spark.createDataFrame([(3, 7), (7, 9), (3, 2000)], "a long, b long")
    for most in (100, 1):
        monkeypatch.setattr(collocations, "PICKED", most)
        got, n = collocations.picked(table, rows, "key", "a", "b")
        assert sorted(map(tuple, got.collect())) == [(3, 6), (7, 14), (9, 18)] and n == 4
