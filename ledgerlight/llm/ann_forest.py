"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt by a hash of their id to shards of about SHARD rows. In a shard
each of TREES trees has a sorted array of BITS-bit strings, the signs of random
projections: each tree takes BITS of PLANES planes in an order of its own. A
query descends every tree to its longest matching prefix by binary search. Then
all trees ascend together from the longest of these, one bit at a time, until
the ranges of rows that share the prefix hold FILL times the shard's rows and
LEAST more, counted with repeats. The union of the ranges is scored exactly.

All rows are indexed and nothing is sampled. Equal vectors of a shard are one
entry that keeps its k + 1 smallest ids, all that any query can need of them,
so a vector with very many copies fills no range. A shard's forest is built
once for up to BLOCK queries, which meet it in one task of bounded size; the
shards' results of a query are merged.

Recall and the share of a shard that is scored are in README: the embeddings
are nearly uniform on a sphere, so close rows share few bits more than others.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part; shorter vectors count as filled up with zeros; with
fewer than k candidates all are returned; ties go to the smaller id; rows that
share a query's id count as the query's own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored
from ledgerlight.llm.vectors import finite_vectors, matrix

TREES, BITS, PLANES, FILL, LEAST = 256, 64, 1024, 0.6, 512
SHARD, BLOCK = 16_384, 32_768
TOGETHER = 1024  # queries that walk the trees at the same time
SEED = 20240229
ALL_ONES = np.uint64((1 << 64) - 1)


def agreeing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two strings."""
    differ = a ^ b
    half = (differ >> np.uint64(32)).astype(np.float64)
    top = np.where(half > 0, 32 + np.frexp(half)[1], np.frexp((differ & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
    return BITS - top


class Forest:
    def __init__(self, x: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.x, self.planes = x, rng.standard_normal((x.shape[1], PLANES))
        self.chosen = [rng.choice(PLANES, BITS, replace=False) for _ in range(TREES)]
        signs = x @ self.planes > 0
        self.order, self.sorted = [], []
        for t in range(TREES):
            strings = self.strings(signs, t)
            self.order.append(np.argsort(strings, kind="stable"))
            self.sorted.append(strings[self.order[-1]])

    def strings(self, signs: np.ndarray, tree: int) -> np.ndarray:
        return np.ascontiguousarray(np.packbits(signs[:, self.chosen[tree]], axis=1)).view(">u8").ravel().astype(np.uint64)

    def longest(self, strings: list[np.ndarray]) -> np.ndarray:
        """For each query the longest prefix that it shares with an entry of any tree."""
        out = np.zeros(len(strings[0]), np.int64)
        for t, own in enumerate(strings):
            at = np.searchsorted(self.sorted[t], own)
            for side in (at - 1, at):
                inside = (side >= 0) & (side < len(self.sorted[t]))
                out = np.maximum(out, np.where(inside, agreeing_bits(own, self.sorted[t][np.clip(side, 0, len(self.sorted[t]) - 1)]), 0))
        return out

    def candidates(self, queries: np.ndarray, fill: float = FILL):
        """For each query the entries in the union of its ranges."""
        for first in range(0, len(queries), TOGETHER):
            yield from self.some(queries[first : first + TOGETHER], fill * len(self.x) + LEAST)

    def some(self, queries: np.ndarray, need: float):
        signs = queries @ self.planes > 0
        strings = [self.strings(signs, t) for t in range(TREES)]
        lo, hi = np.zeros((2, TREES, len(queries)), np.int64)
        reach, done = self.longest(strings), np.zeros(len(queries), bool)
        for level in range(int(reach.max(initial=0)), -1, -1):  # all trees ascend together
            left = np.flatnonzero(~done & (reach >= level))
            if not len(left):
                continue
            had = (hi[:, left] - lo[:, left]).sum(axis=0)
            rest = ALL_ONES >> np.uint64(level) if level < BITS else np.uint64(0)
            for t in range(TREES):
                start = strings[t][left] & ~rest
                more = had < need  # a query that has enough stops, if need be between two trees
                a = np.searchsorted(self.sorted[t], start)
                b = np.searchsorted(self.sorted[t], start | rest, side="right")
                had += np.where(more, (b - a) - (hi[t, left] - lo[t, left]), 0)
                lo[t, left], hi[t, left] = np.where(more, a, lo[t, left]), np.where(more, b, hi[t, left])
            done[left] = had >= need
        for i in range(len(queries)):
            mask = np.zeros(len(self.x), bool)
            for t in range(TREES):
                mask[self.order[t][lo[t, i] : hi[t, i]]] = True
            yield np.flatnonzero(mask)


def search(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """One block of queries against one shard: rows (query_id, vec_id, score)."""
    q, rows = group[group["is_query"]], group[~group["is_query"]]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(q) and len(rows):
        rows = rows.sort_values("vec_id")
        entries: dict[bytes, list[int]] = {}
        for i, v in zip(rows["vec_id"], rows["v"], strict=True):
            ids = entries.setdefault(v, [])
            if len(ids) <= k and (not ids or ids[-1] != i):
                ids.append(i)
        width = max(len(v) for v in group["v"]) // 8
        x, owned = matrix(entries, width=width), list(entries.values())
        counts = np.array([len(o) for o in owned])
        flat, starts = np.concatenate([np.array(o, np.int64) for o in owned]), np.cumsum(counts) - counts
        qx = matrix(q["v"], width=width)
        for query, point, found in zip(q["vec_id"], qx, Forest(x).candidates(qx), strict=True):
            d = np.sqrt(((x[found] - point) ** 2).sum(axis=1))
            if len(found) > k + 1:
                near = d <= np.partition(d, k)[k]  # k + 1 entries and their ties: one of them may be the query
                found, d = found[near], d[near]
            n = counts[found]
            ids = flat[np.repeat(starts[found] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            d = np.repeat(d, n)
            d, ids = d[ids != query], ids[ids != query]
            best = np.lexsort((ids, d))[:k]
            out.append((np.full(len(best), query, np.int64), ids[best], d[best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def nearest(table: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    rows = finite_vectors(table)
    rows = stored(rows.where(~is_zero("v")), "vectors")
    total = rows.count()
    shards = max(1, -(-total // SHARD))
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // BLOCK))
    number = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("vec_id", "v", F.lit(False).alias("is_query"), number(shards, 1).alias("shard"), each(blocks).alias("block"))
    asked = queries.select("vec_id", "v", F.lit(True).alias("is_query"), number(blocks, 2).alias("block"), each(shards).alias("shard"))
    found = data.unionByName(asked).groupBy("shard", "block").applyInPandas(lambda g: search(g, k), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    merged = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def is_zero(column: str) -> Column:
    """All components zero: each double's bytes are 0, but for the sign bit."""
    return F.hex(column).rlike("^(?:00000000000000[08]0)*$")
