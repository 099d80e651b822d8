import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import ann_forest, exact_topk
from ledgerlight.llm.queries import op4_nearest_neighbours, op9_exact_top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def exact(x, ids, queries, score, k):
    """query -> [(vec_id, score)], lowest first."""
    out = {}
    for q in queries:
        s = score(x, x[np.flatnonzero(ids == q)[0]])
        order = [i for i in np.lexsort((ids, s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), s[i]) for i in order]
    return out


def distance(x, q):
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def table(spark, d):
    rows = spark.read.parquet(f"/root/testdata/{d}/embeddings.parquet").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)


@pytest.mark.parametrize("d", ["sf0.01", "sf0.1"])
def test_recall_over_the_whole_table(spark, d):
    ids, x = table(spark, d)
    got = by_query(op4_nearest_neighbours(spark, f"/root/testdata/{d}").collect())
    want = exact(x, ids, [i for i in ids if i % 100 == 0], distance, 10)
    assert got.keys() == want.keys()
    assert all(len(r) == 10 and r == sorted(r, key=lambda y: (y[1], y[0])) for r in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    print(d, np.mean(hits))
    assert np.mean(hits) >= 0.9
    own = {int(i): v for i, v in zip(ids, x, strict=True)}
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(float(np.sqrt(((own[i] - own[q]) ** 2).sum())), rel=1e-12)


@pytest.mark.parametrize("d", ["sf0.01", "sf0.1"])
def test_exact_over_the_whole_table(spark, d):
    ids, x = table(spark, d)
    z = np.floor(64 * x).astype(np.int64)
    want = exact(z, ids, [i for i in ids if i % 20 == 0], lambda a, q: -(a @ q), 20)
    got = by_query(op9_exact_top_k(spark, f"/root/testdata/{d}").collect())
    assert got == {q: [(i, -s) for i, s in r] for q, r in want.items()}


def odd_rows():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 6)).round(1)
    x[50:250] = x[0]  # very many copies
    x[300:320] = -x[300]
    rows = [(i, [float(y) for y in v], "x") for i, v in enumerate(x)]
    return rows + [(1000, None, "x"), (1020, [1.0, None, 2.0, 0.0, 0.0, 0.0], "x"), (1040, [float("nan")] * 6, "x"), (1060, [float("inf")] + [0.0] * 5, "x"), (1100, [0.0] * 6, None), (1120, [-0.0] * 6, None)]


def test_defined_cases(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    x, ids = np.array([np.float32(r[1]) for r in rows[:400]], float), np.arange(400)
    got = by_query(ann_forest.nearest(df, F.col("vec_id") % 20 == 0).collect())
    want = exact(x, ids, range(0, 400, 20), distance, 10)
    assert got.keys() == want.keys() and [i for i, _ in got[100]] == [i for i, _ in want[100]]
    more = [*rows[:400], rows[-2], rows[-1]]
    z, ids = np.floor(64 * np.array([np.float32(r[1]) for r in more], float)).astype(np.int64), np.array([r[0] for r in more])
    want = exact(z, ids, [i for i in ids if i % 20 == 0], lambda a, q: -(a @ q), 20)
    assert by_query(exact_topk.top_k(df, F.col("vec_id") % 20 == 0).collect()) == {q: [(i, -s) for i, s in r] for q, r in want.items()}
    few = df.where("vec_id < 3")
    assert [r["vec_id"] for r in ann_forest.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == sorted([1, 2], key=lambda i: (float(distance(x[[i]], x[0])[0]), i))
    assert exact_topk.top_k(few, F.col("vec_id") == 0).count() == 2
    for f in (ann_forest.nearest, exact_topk.top_k):
        assert f(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
        assert f(df.where("vec_id % 20 <> 0"), F.col("vec_id") % 20 == 0).count() == 0


def clustered(n, centres, width, spread):
    rng = np.random.default_rng(1)
    c = rng.standard_normal((centres, width))
    c *= 640 / np.sqrt((c * c).sum(axis=1))[:, None]
    return np.floor(c[rng.integers(0, centres, n)] + rng.standard_normal((n, width)) * spread)


def test_bounds_prune_but_lose_nothing():
    """Least scores are reached by k answers; rows nearer to their pivot than the least distance reach no least score."""
    for x in (clustered(400, 8, 12, 2.0), clustered(400, 1, 12, 60.0)):
        pivots, k = x[:16], 10
        d = np.sqrt(((x[:, None] - pivots) ** 2).sum(axis=2))
        cell, far = d.argmin(axis=1), d.min(axis=1)
        nearest = np.full((16, k + 1), np.inf)
        for c in range(16):
            own = np.sort(far[cell == c])[: k + 1]
            nearest[c, : len(own)] = own
        least = exact_topk.least_scores(x, pivots, nearest, k)
        scores = x @ x.T
        for i in range(len(x)):
            assert np.sort(np.delete(scores[i], i))[-k] >= least[i]
        need = exact_topk.least_distances(x, least, pivots)
        assert not ((scores >= least[:, None]) & (far[None, :] < need[:, cell])).any()


def share_scored(x, queries):
    """Of the pairs of queries and rows, how many a group of all queries scores."""
    pivots, k = x[np.random.default_rng(2).choice(len(x), 64, replace=False)], 20
    d = np.sqrt(((x[:, None] - pivots) ** 2).sum(axis=2))
    cell, far = d.argmin(axis=1), d.min(axis=1)
    nearest = np.full((64, k + 1), np.inf)
    for c in range(64):
        own = np.sort(far[cell == c])[: k + 1]
        nearest[c, : len(own)] = own
    least = exact_topk.least_scores(x[queries], pivots, nearest, k)
    rows = [(int(i), x[i].tobytes(), 1, int(cell[i]), far[i], 0.0, False) for i in range(len(x))]
    rows += [(int(i), x[i].tobytes(), 1, int(cell[i]), 0.0, s, True) for i, s in zip(queries, least, strict=True)]
    group = pd.DataFrame(rows, columns=["vec_id", "v", "times", "cell", "far", "least", "is_query"])
    found, scored = exact_topk.solve(group, k, pivots)
    want = exact(x, np.arange(len(x)), queries.tolist(), lambda a, q: -(a @ q), k)
    got = {q: [(int(v), -float(s)) for v, s in zip(g["vec_id"], g["score"], strict=True)] for q, g in found.groupby("query_id")}
    assert got == {q: [(i, float(s)) for i, s in r] for q, r in want.items()}
    return scored / len(x) / len(queries)


def test_clustered_vectors_are_pruned():
    share = share_scored(clustered(16_000, 40, 16, 4.0), np.arange(0, 16_000, 40))
    print("clustered", share)
    assert share < 0.3
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64))
    print("uniform", share_scored(np.floor(64 * x / np.sqrt((x * x).sum(axis=1))[:, None]), np.arange(0, 4000, 40)))


def test_large_cells_are_dealt_to_several_blocks():
    first, split = exact_topk.in_order(np.arange(10.0).reshape(5, 2), np.array([4, 25, 3, 0, 9]), 10)
    taken = {}
    for c, n in enumerate((4, 25, 3, 0, 9)):
        for j in range(split[c]):
            taken[first[c] + j] = taken.get(first[c] + j, 0) + n / split[c]
    assert all(n <= 10 for n in taken.values()) and split[1] == 3


def copies_of_queries(x, block, chunk, k=20):
    """To how many of all chunks a group's queries go, on average."""
    pivots = x[np.random.default_rng(2).choice(len(x), 64, replace=False)]
    d = np.sqrt(((x[:, None] - pivots) ** 2).sum(axis=2))
    cell, far = d.argmin(axis=1), d.min(axis=1)
    nearest, reach = np.full((64, k + 1), np.inf), np.full(64, -np.inf)
    for c in range(64):
        own = np.sort(far[cell == c])[: k + 1]
        nearest[c, : len(own)] = own
        reach[c] = far[cell == c].max()
    group, _ = exact_topk.in_order(pivots, np.bincount(cell, minlength=64), block)
    chunk_of, parts = exact_topk.in_order(pivots, np.bincount(cell, minlength=64), chunk)
    one = exact_topk.least_distances(x, exact_topk.least_scores(x, pivots, nearest, k), pivots)
    need = np.array([one[group[cell] == g].min(axis=0) for g in np.unique(group)])
    asked = exact_topk.chunks_asked(need, reach, chunk_of, parts)
    return np.mean([len(c) for c in asked]) / len({int(chunk_of[c]) + j for c in range(64) for j in range(parts[c])})


def test_queries_go_only_to_chunks_that_may_serve_them():
    x = clustered(8000, 40, 16, 4.0)
    assert copies_of_queries(x, 200, 400) < 0.5
    rng = np.random.default_rng(5)
    assert copies_of_queries(np.floor(64 * rng.standard_normal((4000, 64))), 200, 400) == 1  # nothing to prune


def test_small_groups_and_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 12)
    monkeypatch.setattr(exact_topk, "CHUNK", 40)
    x = clustered(600, 12, 8, 3.0) / 64
    df = spark.createDataFrame([(i, [float(y) for y in v], "x") for i, v in enumerate(x)], SCHEMA).repartition(3)
    z = np.floor(64 * np.float32(x).astype(float)).astype(np.int64)
    want = exact(z, np.arange(600), range(0, 600, 20), lambda a, q: -(a @ q), 20)
    assert by_query(exact_topk.top_k(df, F.col("vec_id") % 20 == 0).collect()) == {q: [(i, -s) for i, s in r] for q, r in want.items()}


def test_huge_components_have_results(spark):
    """Scores beyond a long are its greatest or least double, ties to the smaller id; no query is left without rows."""
    rows = [(i, [float(i % 7), 1.0], "x") for i in range(100)] + [(120, [1e200, 0.0], "x"), (121, [1e308, 1e308], "x"), (122, [-1e200, 0.0], "x"), (140, [1e308, -1e308], "x")]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double")).repartition(3)
    got = by_query(exact_topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect())
    top = int(exact_topk.LONG)
    assert {q: len(r) for q, r in got.items()} == {q: 5 for q in (0, 20, 40, 60, 80, 120, 140)}
    assert got[120] == [(i, top) for i in (1, 2, 3, 4, 5)]  # every positive product with it is beyond a long
    assert got[20][:3] == [(120, top), (121, top), (140, top)]
    assert got[0][0] == (121, top) and got[0][1][1] < top


def test_repeated_rows_take_ranks_of_their_own(spark):
    """As the query's SQL has it: rows repeated, ids with several vectors, a query repeated."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((300, 6)).round(2)
    rows = [(i, [float(y) for y in v], "x") for i, v in enumerate(x)]
    rows += [(41, [3.0] * 6, "x")] * 7 + [(43, [5.0] * 6, "x")] * 30 + [(47, [float(j)] * 6, "x") for j in range(9)] * 2
    rows += [rows[60]] * 2 + [(80, [float(j), 1.0, 0.0, 0.0, 0.0, -1.0], "x") for j in range(25)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    z, ids = np.floor(64 * np.array([np.float32(r[1]) for r in rows], float)).astype(np.int64), np.array([r[0] for r in rows])
    for k in (5, 20):
        want = {}
        for q in {int(i) for i in ids if i % 20 == 0}:
            all_ = [(int(-s), int(i)) for v in z[ids == q] for s, i in zip(z @ v, ids, strict=True) if i != q]
            want[q] = [(i, -s) for s, i in sorted(all_)[:k]]
        assert by_query(exact_topk.top_k(df, F.col("vec_id") % 20 == 0, k).collect()) == want
