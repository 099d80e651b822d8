"""MinHash near-duplicate detection with circulant signatures.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Circulant MinHash takes two permutations: the first scatters the elements over
2^32 places, the second is shifted by k places to give signature coordinate k.
Bands of a few coordinates each make the buckets.

Equal sets become one class, whose smallest doc_id stands for it. Buckets join
their classes into groups: a bucket of n classes gives n - 1 meetings with its
smallest, and groups are components of these. A group's hub is the class that
most others met. Each class of a group is compared with the hub. Classes that
have no link with it are then compared with others of the group, but only with
those that share a shingle outside the hub among the first few (a prefix
filter), or that may have all that a link takes inside the hub. Other pairs
cannot be linked, so near copies whose edits differ cost no pair. Pairs are
confirmed on full sets, read again from the whole texts; the pairs of a hub are
dealt to tasks in parts of about PART. Links give connected components.

Defined cases: null or wordless text has no shingle and is linked with nothing;
fewer words than a shingle make one shingle of them all; a null doc_id is
linked with nothing, has a null component and is kept; rows that share a doc_id
share a component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import BROADCAST_ROWS, WordHash, as_bytes, attached, mix, only_ids, small, stored, window_hashes, words
from ledgerlight.llm.components import connected_components

SHINGLE = 5
BLOCK, PART = 1 << 15, 256


@dataclass(frozen=True)
class Near:
    """Link where 100 * intersection >= threshold * union; candidates by `bands` bands of `rows` coordinates."""

    threshold: int = 80
    bands: int = 36
    rows: int = 5

    def lost(self) -> float:
        """How probably a link at exactly the threshold shares no bucket."""
        return (1 - (self.threshold / 100) ** self.rows) ** self.bands


#: Links from 80 % are the default (lost: 6e-7); the query's contract has them from 85 % (1e-5).
DEFAULT, CONTRACT = Near(), Near(85, 24, 6)


def shingle_set(text: bytes | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, ASCII lower-cased."""
    tokens = words(text.lower()) if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    w = hashes.array(tokens)
    if len(w) < SHINGLE:
        return mix(window_hashes(w, len(w)) + np.uint64(len(w)))
    return np.unique(window_hashes(w, SHINGLE))


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """One row of `count` circulant MinHash coordinates for each of the sets, none of which is empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    place = (mix(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((count, len(sets)), np.uint32)
    t, u = np.empty_like(place), np.empty_like(place)
    for k in range(count):
        np.add(place, np.uint32(k), out=t)  # the circular shift, modulo 2^32
        for multiplier, shift in ((0x85EBCA6B, 15), (0xC2B2AE35, 13), (0x27D4EB2F, 16)):
            np.multiply(t, np.uint32(multiplier), out=t)
            np.right_shift(t, np.uint32(shift), out=u)
            np.bitwise_xor(t, u, out=t)
        out[k] = np.minimum.reduceat(t, starts)
    return out.T


def band_keys(signature: np.ndarray, near: Near) -> np.ndarray:
    """documents x bands signed 64-bit keys."""
    s = signature.reshape(len(signature), near.bands, near.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, near.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), s.shape[:2]).copy()
    for r in range(near.rows):
        key = mix(key + s[:, :, r])
    return key.view(np.int64)


def sketch(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for b in small(batches):
        texts, ids = as_bytes(b.column("text")), b.column("doc_id")
        lo = 0
        while lo < len(texts):
            sets, total, hi = [], 0, lo
            while hi < len(texts) and total < BLOCK:
                sets.append(shingle_set(texts[hi], hashes))
                total += len(sets[-1])
                hi += 1
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, names = [None] * len(sets), [None] * len(sets)
            if full:
                for i, k in zip(full, band_keys(signatures([sets[i] for i in full], near.bands * near.rows), near), strict=True):
                    keys[i], names[i] = k, xxhash.xxh3_128_digest(sets[i].tobytes())
            columns = [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "bands"])
            lo = hi


def overlaps(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> sizes of b's full set, of the intersection and of the union, and b's keys against a.

    Keys are shingles of b outside a. Let y share a link with b, and b none with a. Then b and y have at least
    threshold * |b| shingles in common, at most |b and a| of them inside a, so they share `need` outside a, and one of the first
    |b outside a| - need + 1 in any fixed order. Where b is linked with a, all shingles outside a are keys.

    Inner keys, of those b alone that are short enough to have all that a link takes inside a, are the first
    |b| - threshold * |b| + 1 shingles of all: two such sets that are linked share one.
    """
    hashes, hubs = WordHash(), {}
    names = ["a", "b", "size", "inter", "total", "keys", "inner"]
    for batch in small(batches):
        rows = []
        for a, ta, tb in zip(batch.column("a").to_pylist(), as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b")), strict=True):
            if a not in hubs:
                if len(hubs) >= 16:
                    hubs.clear()
                hubs[a] = ta, shingle_set(ta, hashes)
            one = hubs[a][1] if hubs[a][0] == ta else shingle_set(ta, hashes)
            other = shingle_set(tb, hashes)
            outside = np.setdiff1d(other, one, assume_unique=True)
            n = len(other) - len(outside)
            total = len(one) + len(outside)
            need = 1 if n * 100 >= total * threshold else max(1, -(-len(other) * threshold // 100) - n)
            inner = other[: len(other) + 1 - -(-len(other) * threshold // 100)] if n * 100 >= len(other) * threshold else other[:0]
            rows.append((len(other), n, total, outside[: max(0, len(outside) - need + 1)].view(np.int64), inner.view(np.int64)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)


def confirmed(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """pairs (a, b), stored, with the overlap of their full sets; texts: doc_id, text of all documents."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = stored(only_ids(texts, stored(ids, "ids")), "texts")
    parts = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "parts")
    dealt = attached(pairs, parts, "a", "b").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    with_b = dealt.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    hubs = hubs.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_b.join(hubs, ["a", "part"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda batches: overlaps(batches, near.threshold), "a long, b long, size long, inter long, total long, keys array<long>, inner array<long>")


def linked(overlap: DataFrame, near: Near) -> DataFrame:
    return overlap.where((F.col("total") > 0) & (F.col("inter") * 100 >= F.col("total") * near.threshold)).select("a", "b")


def sizes_fit(m, n, near: Near):
    return F.least(m, n) * 100 >= F.greatest(m, n) * near.threshold


def near_duplicates(docs: DataFrame, near: Near = DEFAULT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = stored(texts.mapInArrow(lambda batches: sketch(batches, near), "doc_id long, n_shingles long, set_id binary, bands array<long>"), "sketches")
    classes = rows.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands")
    )
    classes = stored(classes, "classes")
    buckets = classes.select(F.explode("bands").alias("key"), "rep", "n")
    pivots = buckets.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    meet = stored(buckets.join(pivots, "key").where("rep <> p.rep").select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct(), "meetings")
    groups = stored(connected_components(meet), "groups")
    often = meet.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(groups, F.col("a") == F.col("node"))
    hubs = stored(often.groupBy("component").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("hub")), "hubs")
    pairs = attached(groups, hubs, "component", "node").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    star = stored(confirmed(stored(pairs, "pairs"), texts, near), "overlaps")
    links = linked(star, near)
    found = stored(connected_components(links), "components")

    rest = stored(residual_pairs(star, found, near), "rest")
    if not rest.isEmpty():
        links = links.unionByName(linked(confirmed(rest, texts, near), near))
        found = stored(connected_components(links), "components")

    named = classes.select("set_id", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    # copies of one text share a key, and rows without words have none: these go past the join. Texts are too many to broadcast
    of_class = F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()
    out = rows.select("doc_id", "n_shingles", "set_id")
    joined = attached(out.where(of_class), stored(named, "named"), "set_id", "doc_id", BROADCAST_ROWS + 1)
    out = joined.unionByName(out.where(~of_class).withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def residual_pairs(star: DataFrame, found: DataFrame, near: Near) -> DataFrame:
    """Pairs of a group, in different components, that may still be linked: one of them, x, has no link with the hub.

    They share a key, or else all that they need to share may lie inside the hub, for which both must be short, be
    of the same class of size or the next, and share an inner key:
    (100 + threshold) / threshold * |x and hub| >= |x| + |y|, and the same for y.
    """
    least = near.threshold
    label = lambda df, of, to: df.join(found.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col(of) == F.col("_n"), "left").withColumn(to, F.coalesce("_c", of)).drop("_n", "_c")
    m = label(label(star, "b", "comp"), "a", "hub_comp")
    open_ = F.col("comp") != F.col("hub_comp")
    some = m.where(open_).select("a").distinct()
    m = stored(m.join(some, "a", "left_semi").withColumn("cell", F.floor(F.log(F.col("size").cast("double")) / math.log(100 / least))), "open")
    may = (
        (F.col("x.comp") != F.col("y.comp"))
        & ((F.col("y.comp") == F.col("y.hub_comp")) | (F.col("x.b") < F.col("y.b")))
        & sizes_fit(F.col("x.size"), F.col("y.size"), near)
    )
    pair = lambda df: df.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()
    keyed = m.select("a", "b", "comp", "hub_comp", "size", F.explode("keys").alias("key"))
    x, y = keyed.where(open_).alias("x"), keyed.alias("y")
    by_key = pair(x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.key") == F.col("y.key")) & may))

    short = m.where(F.col("inter") * 100 >= F.col("size") * least).select("a", "b", "comp", "hub_comp", "size", "inter", "cell", F.explode("inner").alias("key"))
    x = short.where(open_).withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).alias("x")
    both = F.col("x.size") + F.col("y.size")
    room = lambda c: F.col(c) * (100 + least) >= both * least
    inside = pair(x.join(short.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.key") == F.col("y.key")) & may & room("x.inter") & room("y.inter")))
    return by_key.unionByName(inside).distinct()


def keep_one_of_each(docs: DataFrame, near: Near = DEFAULT) -> DataFrame:
    """The rows of docs that stand for their component; columns as given."""
    gone = stored(near_duplicates(docs, near).where("not kept").select("doc_id").distinct(), "gone")
    return only_ids(docs, gone, "left_anti").select(*docs.columns)
