"""Exact top-k by inner product: a Voronoi kNN join.

Vectors become integers, floor(SCALE * x). Pivots, a bounded number of rows,
split queries and data into cells. A cell's summary holds the k + 1 smallest
distances of its rows to its pivot. For a query q and a row x at the distance d
from its pivot s,

    q.s - |q| d  <=  q.x  <=  q.s + |q| d

so the k + 1 highest left sides of all summaries give each query a least score
that its k-th best answer has (one of the rows may be the query itself). Queries
of neighbouring cells form groups of at most about BLOCK. A group's bound for a
cell is the smallest d with which a row of the cell can still reach the least
score of any of the group's queries; a row goes to the groups whose bound its d
reaches, and to no other. Groups meet their rows in chunks of about CHUNK, made of
neighbouring cells or of a part of a large one; a group's queries are copied to
the chunks that hold a cell whose farthest row reaches the bound, and to no other.
There each tile of rows, near one another by cell, is scored against those queries
alone that it can serve. The results of a query are merged.

Defined cases: vectors that are null or hold null or non-finite components take
no part; shorter vectors count as filled up with zeros; scores are exact below
2 ** 53, those beyond what a long holds count as LONG or -LONG, those that double
precision can't tell (inf - inf) as -LONG; with fewer than k candidates all are returned; ties go to the smaller
id; rows that share a query's id count as the query's own; each row counts, as in
a join of queries and rows: a row that is there n times takes n ranks, and a
query that is there n times finds each row n times; an empty table gives an
empty result; further columns are ignored. Repeats of id and integers are one
entry with their number, so that they take one place in a cell's search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored
from ledgerlight.llm.vectors import SCHEMA, finite_vectors, matrix

FOUND = "query_id long, vec_id long, score long, times long"

SCALE = 64
BLOCK, CHUNK, TILE = 4096, 16_384, 512
#: Tiles after which a group's least scores rise to what was found.
RISE = 4
LEAST_PIVOTS, MOST_PIVOTS, CELL = 16, 256, 256
#: The greatest double that is a long.
LONG = float((1 << 63) - 1024)


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        with np.errstate(over="ignore"):
            out = [np.nan_to_num(np.floor(np.frombuffer(x, "<f8") * SCALE)).tobytes() for x in b.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])


def chosen_pivots(rows: DataFrame, count: int) -> np.ndarray:
    """`count` different vectors: those of the least hash."""
    order = F.xxhash64("v")
    few = rows.select("v", order.alias("h")).groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(count)
    return matrix([r["v"] for r in few.collect()])


def filled(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def in_cells(pivots: np.ndarray):
    """Adds to each row its cell, its distance to the pivot and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v").to_pylist(), width=pivots.shape[1])
            p = filled(pivots, x.shape[1])
            with np.errstate(over="ignore", invalid="ignore"):
                squares = (x * x).sum(axis=1)[:, None] - 2 * x @ p.T + (p * p).sum(axis=1)
                cell = squares.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
                far = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
            far[np.isnan(far)] = np.inf  # what can't be told counts as far: it is pruned nowhere
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*b.schema.names, "cell", "far"])

    return run


def least_scores(queries: np.ndarray, pivots: np.ndarray, nearest: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th best answer of each query reaches; nearest: pivots x (k + 1) distances, inf where there are fewer rows."""
    with np.errstate(over="ignore"):
        size = np.sqrt((queries * queries).sum(axis=1))
    every = nearest[np.isfinite(nearest)]
    if len(every) <= k:
        return np.full(len(queries), -np.inf)
    cells = np.nonzero(np.isfinite(nearest))[0]
    out = np.empty(len(queries))
    for lo in range(0, len(queries), 256):
        part = slice(lo, lo + 256)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = (queries[part] @ pivots.T)[:, cells] - size[part, None] * every
        bound[np.isnan(bound)] = -np.inf
        out[part] = -np.partition(-bound, k, axis=1)[:, k]
    return np.minimum(out - 1e-6 * (1 + np.abs(out)), LONG)  # scores beyond it are ties


def least_distances(queries: np.ndarray, least: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """queries x pivots: rows of the cell that are nearer to its pivot can't reach the query's least score."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        size = np.sqrt((queries * queries).sum(axis=1))
        d = (least[:, None] - queries @ pivots.T) / size[:, None]
    return np.where((size[:, None] > 0) & ~np.isnan(d), d, -np.inf)


def best_of(queries: np.ndarray, query_ids: np.ndarray, query_times: np.ndarray, x: np.ndarray, ids: np.ndarray, times: np.ndarray, k: int, of: np.ndarray) -> pd.DataFrame:
    """The k highest scores of each query; ids ascend; of: the queries' numbers."""
    with np.errstate(over="ignore", invalid="ignore"):
        scores = queries @ x.T
    n = len(ids)
    top = np.abs(scores).max(initial=0)
    if not top < LONG:
        scores = np.clip(np.nan_to_num(scores, nan=-LONG, posinf=LONG, neginf=-LONG), -LONG, LONG)
    scores[query_ids[:, None] == ids] = -np.inf
    k = min(k, n)
    if n and top * n < 2**52:
        best = np.argpartition(-(scores * n - np.arange(n)), k - 1, axis=1)[:, :k]  # unlike keys: no ties are left
    else:
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    got = np.take_along_axis(scores, best, axis=1)
    keep = np.isfinite(got)
    each = keep.sum(axis=1)
    return pd.DataFrame({"of": np.repeat(of, each), "query_id": np.repeat(query_ids, each), "vec_id": ids[best][keep], "score": got[keep].astype(np.int64), "times": np.repeat(query_times, each) * times[best][keep]})


def solve(group: pd.DataFrame, k: int, pivots: np.ndarray) -> tuple[pd.DataFrame, int]:
    """The k best answers of a group's queries among a chunk of rows, and how many scores were computed."""
    q, rows = group[group["is_query"]], group[~group["is_query"]].sort_values(["cell", "far"])
    empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score", "times")})
    if not len(q) or not len(rows):
        return empty, 0
    width = max(len(v) for v in group["v"]) // 8
    queries, data, p = matrix(q["v"], width=width), matrix(rows["v"], width=width), filled(pivots, width)
    ids, times, least = q["vec_id"].to_numpy(), q["times"].to_numpy(), q["least"].to_numpy(copy=True)
    cells, far, own, own_times = (rows[c].to_numpy() for c in ("cell", "far", "vec_id", "times"))
    need, found, scored = least_distances(queries, least, p), [], 0

    def best_so_far() -> pd.DataFrame:
        all_ = pd.concat(found).sort_values(["of", "score", "vec_id"], ascending=[True, False, True])
        return all_[all_.groupby("of").cumcount() < k]

    for number, lo in enumerate(range(0, len(rows), TILE)):
        if found and number % RISE == 0:
            found = [best_so_far()]
            have = found[0].groupby("of")["score"].agg(["size", "min"])
            full = have.index[have["size"] == k]
            least[full] = np.maximum(least[full], have.loc[full, "min"] - 0.5)  # scores are whole numbers
            need[full] = least_distances(queries[full], least[full], p)
        part = slice(lo, lo + TILE)
        inside, at = np.unique(cells[part], return_inverse=True)
        reach = np.zeros(len(inside))
        np.maximum.at(reach, at, far[part])
        wanted = np.flatnonzero((reach >= need[:, inside]).any(axis=1))
        if len(wanted):
            order = np.argsort(own[part], kind="stable") + lo
            scored += len(wanted) * len(order)
            found.append(best_of(queries[wanted], ids[wanted], times[wanted], data[order], own[order], own_times[order], k, wanted))
    if not found:
        return empty, scored
    return best_so_far().drop(columns="of"), scored


def top_k(table: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (integer inner product)."""
    spark = table.sparkSession
    rows = finite_vectors(table).mapInArrow(scaled, SCHEMA)
    rows = rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))
    once = F.row_number().over(W.partitionBy("vec_id").orderBy("v")) == 1
    rows = stored(rows.withColumns({"once": once, "is_query": is_query}), "integers")
    total = rows.count()
    pivots = chosen_pivots(rows, min(MOST_PIVOTS, max(LEAST_PIVOTS, total // CELL)))
    cells = rows.mapInArrow(in_cells(pivots), SCHEMA + ", times long, once boolean, is_query boolean, cell int, far double")
    cells = stored(cells, "cells")
    n = len(pivots)
    nearest, reach, counts, asked = np.full((n, k + 1), np.inf), np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = F.row_number().over(W.partitionBy("cell").orderBy("far", "vec_id"))
    for r in cells.where("once").select("cell", "far", first.alias("at")).where(F.col("at") <= k + 1).collect():
        nearest[r["cell"], r["at"] - 1] = r["far"]
    for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("asked"), F.max("far").alias("reach")).collect():
        counts[r["cell"]], asked[r["cell"]], reach[r["cell"]] = r["n"], r["asked"], r["reach"]
    if not asked.any():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    group_of, split = in_order(pivots, asked, BLOCK)
    chunk_of, parts = in_order(pivots, counts, CHUNK)
    shared = spark.sparkContext.broadcast((pivots, nearest, group_of, split))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their group and their least score."""
        pivots, nearest, group_of, split = shared.value
        for b in batches:
            x = matrix(b.column("v").to_pylist(), width=pivots.shape[1])
            cell = b.column("cell").to_numpy()
            to = group_of[cell] + b.column("hash").to_numpy() % split[cell]
            least = least_scores(x, filled(pivots, x.shape[1]), nearest, k) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "v", "times", "cell")), pa.array(to.astype(np.int32)), pa.array(least)], ["vec_id", "v", "times", "cell", "to", "least"])

    queries = cells.where("is_query").select("vec_id", "v", "times", "cell", F.pmod(F.xxhash64(F.lit(2), "vec_id"), 1 << 30).alias("hash"))
    queries = stored(queries.mapInArrow(placed, SCHEMA + ", times long, cell int, to int, least double"), "queries")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each group that a task has queries of, the least distances by cell."""
        pivots, found = shared.value[0], {}
        for b in batches:
            x = matrix(b.column("v").to_pylist(), width=pivots.shape[1])
            need, to = least_distances(x, b.column("least").to_numpy(), filled(pivots, x.shape[1])), b.column("to").to_numpy()
            for g in np.unique(to).tolist():
                low = need[to == g].min(axis=0)
                found[g] = np.minimum(found[g], low) if g in found else low
        lists = [x.tolist() for x in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(lists, pa.list_(pa.float64()))], ["to", "need"])

    # one row for each group and cell: BLOCK queries have at most MOST_PIVOTS of them
    each = queries.mapInArrow(bounds, "to int, need array<double>").select("to", F.posexplode("need").alias("cell", "need"))
    table_ = each.groupBy("to", "cell").agg(F.min("need").alias("need")).toPandas()
    groups = np.unique(table_["to"].to_numpy())
    need = np.full((len(groups), n), np.inf)
    need[np.searchsorted(groups, table_["to"].to_numpy()), table_["cell"].to_numpy()] = table_["need"].to_numpy()
    routes = spark.sparkContext.broadcast((groups, need, chunk_of, parts, chunks_asked(need, reach, chunk_of, parts)))

    def goes_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its chunk and the groups of queries that may need it."""
        groups, need, chunk_of, parts, _ = routes.value
        for b in batches:
            cell = b.column("cell").to_numpy()
            wanted = b.column("far").to_numpy()[:, None] >= need[:, cell].T
            chunk = chunk_of[cell] + b.column("hash").to_numpy() % parts[cell]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunk.astype(np.int32)), pa.array([groups[w].tolist() for w in wanted], pa.list_(pa.int32()))], [*b.schema.names, "chunk", "to"])

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the chunks that may serve its group."""
        groups, *_, chunks = routes.value
        for b in batches:
            lists = [chunks[g] for g in np.searchsorted(groups, b.column("to").to_numpy()).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))], [*b.schema.names, "chunks"])

    data = cells.select("vec_id", "v", "times", "cell", "far", F.pmod(F.xxhash64(F.lit(1), "vec_id"), 1 << 30).alias("hash"))
    data = data.mapInArrow(goes_to, SCHEMA + ", times long, cell int, far double, hash long, chunk int, to array<int>")
    data = data.select("vec_id", "v", "times", "cell", "far", F.lit(0.0).alias("least"), F.lit(False).alias("is_query"), F.explode("to").alias("to"), "chunk")
    asking = queries.mapInArrow(asks, SCHEMA + ", times long, cell int, to int, least double, chunks array<int>")
    asking = asking.select("vec_id", "v", "times", "cell", F.lit(0.0).alias("far"), "least", F.lit(True).alias("is_query"), "to", F.explode("chunks").alias("chunk"))
    found = data.unionByName(asking).groupBy("to", "chunk").applyInPandas(lambda g: solve(g, k, shared.value[0])[0], FOUND)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)  # entries; each has a row at least
    each = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    merged = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def chunks_asked(need: np.ndarray, reach: np.ndarray, chunk_of: np.ndarray, parts: np.ndarray) -> list[list[int]]:
    """Of each group, the chunks with a cell whose farthest row (reach) may serve one of its queries; need: groups x cells."""
    found = []
    for wanted in reach >= need:
        cells = np.flatnonzero(wanted)
        found.append(sorted({int(chunk_of[c]) + j for c in cells for j in range(int(parts[c]))}))
    return found


def in_order(pivots: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of neighbouring cells: the first block of each cell, and over how many blocks its members are dealt.

    Cells follow one another from each to the nearest one left; a block takes cells until it has `most` members.
    """
    left, at, order = set(range(len(pivots))), 0, []
    while left:
        order.append(at)
        left.discard(at)
        if left:
            rest = np.fromiter(left, np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                at = int(rest[((pivots[rest] - pivots[at]) ** 2).sum(axis=1).argmin()])
    first, split, block, size = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64), 0, 0
    for c in order:
        if size and size + sizes[c] > most:
            block, size = block + 1, 0
        first[c] = block
        if sizes[c] > most:
            split[c] = -(-sizes[c] // most)
            block, size = block + int(split[c]), 0
        else:
            size += int(sizes[c])
    return first, split
