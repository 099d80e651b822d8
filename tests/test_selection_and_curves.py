"""Selection by rank, average ranks, curves, usage of models, and the registry's commits."""

import random
import threading

import pandas as pd
import pytest
from compare import differences
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerlight.operators import metrics, ml, ranking
from ledgerlight.plans import oracles, registry
from ledgerlight.sources import fixtures
from ledgerlight.streaming import jobs

D = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """40,000 rows: half of them 0, a sixth 7, a few nulls and NaNs, the others spread."""
    draw = random.Random(4)
    rows = [(i, 0.0 if i % 2 else 7.0 if i % 3 == 0 else None if i % 1000 == 2 else float("nan") if i % 1000 == 4 else draw.gauss(0, 100)) for i in range(40_000)]
    path = f"file://{tmp_path_factory.mktemp('tied')}"
    spark.createDataFrame(rows, "id long, v double").repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), rows


@pytest.mark.parametrize("fit", [10_000, 20, 1])
def test_values_at_ranks(tied, monkeypatch, fit):
    df, rows = tied
    monkeypatch.setattr(ranking, "FIT", fit)
    values = sorted((v for _, v in rows if v is not None), key=lambda v: (v != v, v))
    n = len(values)
    ranks = [1, 2, n // 7, n // 3, n // 2, n // 2 + 1, 2 * n // 3, n - 100, n, n + 1, 0]
    wanted = [(F.col("v"), r) for r in ranks] + [(F.when(F.col("v") == 0, F.col("id")), 5), (F.lit(None).cast("int"), 1)]
    got = ranking.at_ranks(df, wanted)
    assert [*map(str, got[:9])] == [str(values[r - 1]) for r in ranks[:9]]
    assert got[9:] == [None, None, 9, None]
    assert ranking.at_ranks(df, []) == []


@pytest.mark.parametrize("kind", ["int", "date", "decimal(22,2)", "double"])
def test_quantiles_of_any_ordered_type(spark, monkeypatch, kind):
    monkeypatch.setattr(ranking, "FIT", 10)
    df = spark.range(2000).select("id", F.expr(f"cast(date_add(date'2020-01-01', cast(id * 7919 % 500 as int)) as {kind})" if kind == "date" else f"cast(id * 7919 % 500 - 100 as {kind})").alias("v"))
    values = sorted(r["v"] for r in df.collect())
    assert ranking.at_ranks(df, [(F.col("v"), r) for r in (1, 3, 999, 1000, 1001, 2000)]) == [values[r - 1] for r in (1, 3, 999, 1000, 1001, 2000)]


def test_exact_quantiles_are_pandas_s_without_an_exchange(spark, tied):
    df, rows = tied
    clean = df.where("v is null or not isnan(v)")
    want = pd.Series([v for _, v in rows if v is not None and v == v])
    shares = {"a": 0.3, "b": 0.5, "c": 0.7, "d": 0.999, "e": 0.0, "f": 1.0}
    got = ranking.exact_quantiles(clean, "v", shares)
    assert [*got.first()] == pytest.approx([want.quantile(q) for q in shares.values()])
    assert "Exchange" not in plan(got)
    rough = ranking.approximate_quantiles(clean, "v", {"m": 0.9}).first()["m"]
    assert want.quantile(0.895) <= rough <= want.quantile(0.905)
    assert ranking.exact_quantiles(clean.where("false"), "v", {"a": 0.5}).first()["a"] is None


@pytest.mark.parametrize("fit", [10_000, 3])
def test_quartiles_of_ties_and_nulls_without_an_exchange(spark, monkeypatch, fit):
    monkeypatch.setattr(ranking, "FIT", fit)
    draw = random.Random(8)
    for n in (1, 2, 3, 5, 41, 400):
        rows = [(i, draw.choice([None, 0, 0, 0, 1, 5, draw.randint(-9, 9)]), draw.choice([0.0, draw.random()])) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, v int, w double")
        out = ranking.several_quartiles(df, {"v": "qv", "w": "qw"}, "id")
        assert "Exchange" not in plan(out)
        got = {r["id"]: (r["qv"], r["qw"]) for r in out.collect()}
        for j, place in ((0, 1), (1, 2)):
            order = sorted(rows, key=lambda r: (r[place] is not None, r[place] or 0, r[0]))
            for at, r in enumerate(order, start=1):
                assert got[r[0]][j] == next((k for k in (1, 2, 3) if at <= 1 + k * (n - 1) // 4), 4)
    assert ranking.quartiles(df.where("false"), "v", "id", "q").count() == 0


def test_rfm_segments_sort_nothing(spark):
    out = metrics.rfm_segments(fixtures.orders(spark, D), fixtures.customers(spark, D))
    assert "rangepartitioning" not in plan(out) and differences(spark, registry.queries()["rfm_segments"], oracles.oracle_sql()["rfm_segments"], D) == ""


@pytest.mark.parametrize("block", [10_000, 7, 1])
def test_average_ranks_of_runs_over_borders(spark, tied, monkeypatch, block):
    monkeypatch.setattr(ranking, "BLOCK", block)
    some = 40_000 if block > 7 else 300
    rows = [(i, v) for i, v in tied[1][:some] if v is not None and v == v]
    df = spark.createDataFrame(rows, "id long, v double")
    ranked = ranking.global_row_number(df, [F.col("v").asc(), F.col("id").asc()], "_rk")
    out = ranking.percent_rank_average(ranked, "v", "p")
    got = {r["id"]: r["p"] for r in out.collect()}
    want = pd.Series([v for _, v in rows]).rank(pct=True).tolist()
    assert [got[i] for i, _ in rows] == pytest.approx(want, abs=1e-12)
    joins = [line for line in plan(out).splitlines() if "Join" in line and "v#" in line]
    assert not joins


def test_many_tied_values_and_one_of_half_the_rows(spark):
    df = spark.range(400_000).select("id", F.expr("case when id % 2 = 0 then 0 else id % 200003 end").alias("v"))
    ranked = ranking.global_row_number(df, [F.col("v").asc(), F.col("id").asc()], "_rk")
    got = ranking.percent_rank_average(ranked, "v", "p").toPandas().sort_values("id")
    want = pd.Series([0 if i % 2 == 0 else i % 200003 for i in range(400_000)]).rank(pct=True)
    assert abs(got["p"].to_numpy() - want.to_numpy()).max() < 1e-12


def curve(spark, seed, n=300, ties=40):
    draw = random.Random(seed)
    rows = [(draw.randint(0, ties) / ties, int(draw.random() < 0.3)) for _ in range(n)]
    rows = [(s if not y else min(1.0, s + draw.choice([0, 0.2])), y) for s, y in rows]
    return ml.roc_points(spark.createDataFrame(rows, "score double, label int"))


def area(points):
    x = y = total = 0.0
    for a, b in points:
        total, x, y = total + (a - x) * (b + y) / 2, a, b
    return total


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hull_and_thinned_curve_keep_the_area(spark, seed):
    points = curve(spark, seed)
    full = [(r["tp"], r["fp"], r["fpr"], r["tpr"], r["threshold"]) for r in sorted(points.collect(), key=lambda r: -r["threshold"])]
    turns = [p for k, p in enumerate(full) if k in (0, len(full) - 1) or (p[1] - full[k - 1][1]) * (full[k + 1][0] - p[0]) != (full[k + 1][1] - p[1]) * (p[0] - full[k - 1][0])]
    hull = sorted(ml.roc_hull(points).collect(), key=lambda r: -r["threshold"])
    assert [r["threshold"] for r in hull] == [p[4] for p in turns]
    want = area([p[2:4] for p in full])
    assert area([(r["fpr"], r["tpr"]) for r in hull]) == pytest.approx(want, abs=1e-12)
    assert ml.curve_area(points).first()["area"] == pytest.approx(want, abs=1e-12)
    for most in (5, 9, 12, 1000):
        thin = sorted((r["fpr"], r["tpr"]) for r in ml.roc_thinned(points, most).collect())
        assert len(thin) <= most and area(thin) == pytest.approx(want, abs=1e-12)
        assert all(a[1] <= b[1] for a, b in zip(thin, thin[1:], strict=False))
    with pytest.raises(ValueError, match="5 points"):
        ml.roc_thinned(points, 4)


def test_neighbours_over_borders(spark):
    df = spark.range(1, 24).select(F.col("id").alias("rk"), (F.col("id") * 3).alias("x"))
    got = {r["rk"]: (r["_before"], r["_after"]) for r in ml.with_neighbours(df, ["x"], "rk", size=4).collect()}
    assert all((a and a["x"], b and b["x"]) == (3 * k - 3 if k > 1 else None, 3 * k + 3 if k < 23 else None) for k, (a, b) in got.items())


def test_curves_of_trained_models(spark):
    rows = [(i, float(i % 3 == 0), (i % 3 == 0) * 0.3 + (i % 7) / 10) for i in range(60)]
    test = spark.createDataFrame(rows, "customer_id long, label double, score double")
    one = test.where("label = 1")
    got = ml.curves({"a": ml.Trained("a", None, {}, test), "b": ml.Trained("b", None, {}, one)}).collect()
    assert {r["model_name"] for r in got} == {"a"} and max(r["tpr"] for r in got) == 1 and any(not r["on_hull"] for r in got)
    best = min(got, key=lambda r: -r["threshold"])
    assert best["on_hull"] and best["precision"] == 1


def test_usage_over_a_growing_stream_equals_that_of_the_table(spark, tmp_path):
    path, out = f"file://{tmp_path}/scored", f"file://{tmp_path}/usage"
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7 % 900 as int), 0)")
    versions = F.when(F.col("id") % 10 != 0, F.create_map(F.lit("churn"), F.concat(F.lit("model_v"), F.col("id") % 2 + 1), F.lit("next"), F.lit("model_v1")))
    scored = spark.range(1000).select("id", at.alias("scored_at"), versions.alias("model_versions"))
    for part in ("scored_at < '2024-01-01 08:00:00'", "scored_at >= '2024-01-01 08:00:00'"):
        scored.where(part).write.mode("append").parquet(path)
        jobs.usage_table(jobs.table_stream(spark, path), out)
    key = ("model", "model_version", "window_start")
    got = sorted(map(tuple, jobs.latest_windows(spark, out, key).select(*key, "predictions").collect()))
    want = sorted(map(tuple, jobs.version_usage(scored).select(*key, "predictions").collect()))
    assert got == want and sum(r[3] for r in got) == 1800 and {r[:2] for r in got} == {("churn", "model_v1"), ("churn", "model_v2"), ("next", "model_v1")}


def small_model(spark):
    return Pipeline(stages=[VectorAssembler(inputCols=["id"], outputCol="v")]).fit(spark.range(1))


def test_readers_never_see_half_a_version(spark, tmp_path):
    r, model = ml.Registry(spark, f"file://{tmp_path}/registry"), small_model(spark)
    seen, failures, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                newest = r.latest("m")
                if newest:
                    loaded, entry = r.load("m")
                    seen.append(entry["model_version_number"])
                    assert entry["model_version_number"] >= newest["latest_model_version_number"] and len(loaded.stages) == 1
            except Exception as e:  # noqa: BLE001
                failures.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(20):
        assert r.register(ml.Trained("m", model, {"k": k}, None), f"v{k}", "t")["model_version_number"] == k + 1
    done.set()
    reader.join()
    assert not failures and seen == sorted(seen) and r.latest("m")["latest_model_version"] == "model_v20"


def test_a_writer_that_stops_before_the_commit_leaves_no_entry(spark, tmp_path, monkeypatch):
    r, model = ml.Registry(spark, f"file://{tmp_path}/registry"), small_model(spark)
    r.register(ml.Trained("m", model, {}, None), "v", "t", "p")

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(ml.Registry, "commit", stop)
        r.register(ml.Trained("m", model, {}, None), "w", "t")
    assert r.latest("m")["latest_model_version"] == "model_v1" and r.entries().count() == 1
    assert r.register(ml.Trained("m", model, {}, None), "w", "t")["model_version_number"] == 3
    assert r.load("m", "v", "p")[1]["model_version"] == "model_v1"
    with pytest.raises(FileNotFoundError):
        r.load("m", "v", "other parameters")
    assert ml.parameters("churn", depth=4) != ml.parameters("churn") != ml.parameters("next_purchase_30d")


def test_boards_and_matrix_are_whole(spark):
    q, sql = registry.queries(), oracles.oracle_sql()
    for name in ("action_board", "cohort_matrix", "roc_hull", "roc_curve_areas", "roc_points", "recommendations"):
        assert differences(spark, q[name], sql[name], D) == "", name
    assert len(q["cohort_matrix"](spark, D).columns) > 100
