"""Substring deduplication on a compacted de Bruijn graph of token k-mers.

Edges of the graph are the windows, k-mers of WIDTH words; its nodes are the
(WIDTH - 1)-mers in which they begin and end. As in genome assembly, edges are
partitioned by minimizers: of the ANCHOR-word stretches of a window the one with
the least hash is its anchor, so equal windows have equal anchors wherever they
stand. The windows of one anchor that follow each other in a document are a path,
known by the hash of its words, with the nodes at its two ends. An anchor that
only one document has holds no repeated window, so its paths leave at once.

1. Spark counts the documents of anchors, then of paths.
2. Compaction: a node that one repeated path enters and one leaves joins these
   two. Pointer doubling over such links, a join a round, gives each path the
   first one of its chain (a unitig) and its offset there. A document's paths on
   one diagonal of a unitig become one span, if nothing is missing between them.
3. Where an anchor has several paths, the graph branches inside of them: their
   edges are compared one by one. The first document of each path reads its
   windows, an aggregate gives each window's first document, and windows next to
   each other in both documents become one span.
4. Every span has the coordinates of its first document, the source. The words
   there are read again and hashed to 128 bits; a span is cut only where the
   document's own words have the same digest.

A word goes if a window over it also starts in a document of smaller id: what is
cut is in the source, by digest; what is not cut has no equal, but for a
collision of the 64-bit hashes.

Defined cases: null text has no words; documents shorter than a window stay
whole; a window repeated only inside one document (or under one id) stays; rows
that share an id are cut each by its own words; rows with a null doc_id lose
nothing and cause no loss; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.llm.common import Powers, WordHash, as_bytes, attached, discard, mix, only_ids, small, stored, words

WIDTH, ANCHOR = 50, 10
POSITION_BITS = 28
#: Spans whose source is read by one task, for each source.
PART = 4096


@dataclass
class Paths:
    """The paths of a document: hashes of anchor, words and end nodes, first and last window of each."""

    anchor: np.ndarray
    path: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    first: np.ndarray
    last: np.ndarray
    windows: np.ndarray  # of all windows of the document


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    rest = width - span
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def paths_of(tokens: list[bytes], hashes: WordHash, powers: Powers) -> Paths | None:
    n = len(tokens)
    if n < WIDTH:
        return None
    powers.reach(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes.array(tokens) * powers.up[:n], out=sums[1:])
    short = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * powers.down[: n - ANCHOR + 1])
    low = np.uint64(POSITION_BITS)
    keyed = (short >> low << low) | np.arange(len(short), dtype=np.uint64)  # ties go to the leftmost
    at = (sliding_min(keyed, WIDTH - ANCHOR + 1) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [len(at) - 1]])
    place = (at[first] - first).astype(np.uint64) * np.uint64(64) + (last - first).astype(np.uint64)
    path = mix(mix((sums[last + WIDTH] - sums[first]) * powers.down[first]) + place)
    node = lambda i: mix((sums[i + WIDTH - 1] - sums[i]) * powers.down[i])
    windows = mix((sums[WIDTH:] - sums[:-WIDTH]) * powers.down[: n - WIDTH + 1])
    return Paths(short[at[first]], path, node(first), node(last + 1), first, last, windows)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


FOUND = "doc_id long, anchor long, path long, head long, tail long, pos array<int>, n int"


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of each document, once each, with the windows at which they begin and how many they have."""
    hashes, powers = WordHash(), Powers()
    names = [c.split()[0] for c in FOUND.split(", ")]
    for b in small(batches):
        docs, found = [], []
        for doc, text in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text")), strict=True):
            if (p := paths_of(words(text), hashes, powers)) is not None:
                order = np.argsort(p.path, kind="stable")
                own = p.path[order]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                one = order[starts]  # of each path the first place
                docs.append(np.full(len(one), doc, np.int64))
                found.append((p.anchor[one], p.path[one], p.head[one], p.tail[one], (p.last - p.first + 1)[one], p.first[order], np.diff(np.append(starts, len(own)))))
        if docs:
            anchor, path, head, tail, n, pos, times = (np.concatenate(c) for c in zip(*found, strict=True))
            places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(times)), pa.int32()), pa.array(pos, pa.int32()))
            arrays = [pa.array(np.concatenate(docs)), *map(signed, (anchor, path, head, tail)), places, pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names)


def windows_of_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, paths) -> (doc_id, window, pos): the windows of the paths asked for, read at their source coordinates."""
    hashes, powers = WordHash(), Powers()
    for b in small(batches):
        docs, found, places = [], [], []
        for doc, text, asked in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text")), b.column("paths").to_pylist(), strict=True):
            if (p := paths_of(words(text), hashes, powers)) is not None:
                at = np.flatnonzero(np.repeat(np.isin(p.path.view(np.int64), np.array(asked, np.int64)), p.last - p.first + 1))
                docs.append(np.full(len(at), doc, np.int64))
                found.append(p.windows[at])
                places.append(at)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), signed(np.concatenate(found)), pa.array(np.concatenate(places), pa.int32())], ["doc_id", "window", "pos"])


def span_digest(tokens: list[bytes], pos: int, n: int) -> bytes | None:
    """Of the words under n windows from pos on."""
    end = pos + n + WIDTH - 1
    return xxhash.xxh3_128_digest(b" ".join(tokens[pos:end])) if end <= len(tokens) else None


def source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, asked) -> (source, source_pos, n, digest)."""
    for b in small(batches):
        rows = []
        for doc, text, asked in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text")), b.column("asked").to_pylist(), strict=True):
            tokens = words(text)
            rows += [(doc, x["source_pos"], x["n"], d) for x in asked if (d := span_digest(tokens, x["source_pos"], x["n"])) is not None]
        if rows:
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["source", "source_pos", "n", "digest"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> (doc_id, n_words, n_removed, kept); spans (pos, n, digest) that go where the words agree, or null."""
    for b in small(batches):
        totals, removed, kept = [], [], []
        for text, spans in zip(as_bytes(b.column("text")), b.column("spans").to_pylist(), strict=True):
            tokens = words(text)
            gone = bytearray(len(tokens))
            for x in spans or ():
                own = span_digest(tokens, x["pos"], x["n"])
                if own is not None and own == x["digest"]:
                    size = x["n"] + WIDTH - 1
                    gone[x["pos"] : x["pos"] + size] = b"\1" * size
            totals.append(len(tokens))
            removed.append(gone.count(1))
            kept.append(b" ".join([t for t, g in zip(tokens, gone, strict=True) if not g] if removed[-1] else tokens))
        arrays = [b.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept"])


def unitigs(paths: DataFrame) -> DataFrame:
    """path, unitig, off: the first path of each path's chain, and how many windows of the chain come before.

    paths: path, head, tail, n. A chain goes on where its last node has one path in and one out. Paths on a
    circle of such nodes have no first one; each is a unitig of its own.
    """
    into = paths.groupBy(F.col("tail").alias("node")).agg(F.count(F.lit(1)).alias("c"), F.min("path").alias("to"), F.min("n").alias("off")).where("c = 1").drop("c")
    out = paths.groupBy(F.col("head").alias("node")).agg(F.count(F.lit(1)).alias("c"), F.min("path").alias("path")).where("c = 1").drop("c")
    links = into.join(out, "node").where("path <> to").select("path", "to", F.col("off").cast("long"))
    state = paths.select("path").join(links, "path", "left")
    state = stored(state.select("path", F.coalesce("to", "path").alias("to"), F.coalesce("off", F.lit(0)).cast("long").alias("off"), F.col("to").isNull().alias("done")), "chains")
    settled = -1
    while (now := state.where("done").count()) > settled:  # while any chain is longer than what pointers span
        settled = now
        open_ = state.where("not done").alias("s").join(state.alias("t"), F.col("s.to") == F.col("t.path"))
        moved = open_.select("s.path", "t.to", (F.col("s.off") + F.col("t.off")).alias("off"), "t.done")
        last, state = state, stored(state.where("done").unionByName(moved), "chains")
        discard(last)
    return state.select("path", F.when(F.col("done"), F.col("to")).otherwise(F.col("path")).alias("unitig"), F.when(F.col("done"), F.col("off")).otherwise(F.lit(0)).alias("off"))


def spans_of_paths(repeated: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, pos, n, source, source_pos of what later documents share with the first ones of repeated paths."""
    own = stored(paths.join(unitigs(paths), "path").select("path", "source", "source_pos", "unitig", "off"), "own")
    later = attached(repeated.select("doc_id", "path", "pos", "n"), own, "path", "doc_id").where("doc_id > source").withColumn("pos", F.explode("pos"))
    diagonal = [F.col("doc_id"), F.col("unitig"), (F.col("pos") - F.col("off")).alias("d"), F.col("source"), (F.col("source_pos") - F.col("off")).alias("e")]
    runs = later.groupBy(*diagonal).agg(
        F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("n")).alias("hi"), F.sum("n").alias("total"), F.min("source_pos").alias("at"), F.collect_list(F.struct("pos", "n", "source_pos")).alias("parts")
    )
    whole = F.struct(F.col("lo").alias("pos"), (F.col("hi") - F.col("lo")).alias("n"), F.col("at").alias("source_pos"))
    runs = runs.select("doc_id", "source", F.explode(F.when(F.col("hi") - F.col("lo") == F.col("total"), F.array(whole)).otherwise(F.col("parts"))).alias("s"))
    return runs.select("doc_id", "s.pos", "s.n", "source", "s.source_pos")


def spans_of_windows(windows: DataFrame) -> DataFrame:
    """The same of single windows: those next to each other in both documents are one span."""
    first = windows.groupBy("window").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.max("doc_id").alias("hi")).where("f.doc_id < hi")
    first = stored(first.select("window", F.col("f.doc_id").alias("source"), F.col("f.pos").alias("source_pos")), "first")
    again = attached(windows, first, "window", "doc_id").where("doc_id > source")
    on = ["doc_id", "source", "d"]
    again = again.select("doc_id", "pos", "source", "source_pos", (F.col("pos") - F.col("source_pos")).alias("d"))
    again = again.withColumn("island", F.col("pos") - F.dense_rank().over(W.partitionBy(*on).orderBy("pos")))
    runs = again.groupBy(*on, "island").agg(F.min("pos").alias("pos"), (F.max("pos") - F.min("pos") + 1).alias("n"), F.min("source_pos").alias("source_pos"))
    return runs.select("doc_id", "pos", "n", "source", "source_pos")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space): one row for each row of docs."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = stored(texts.where("doc_id is not null").mapInArrow(occurrences, FOUND), "paths")

    # 1. anchors that several documents have; the graph branches in one if its least and its greatest path differ
    anchors = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("path").alias("p"), F.max("path").alias("q"))
    anchors = stored(anchors.where("lo < hi").select("anchor", (F.col("p") != F.col("q")).alias("branches")), "anchors")
    repeated = stored(attached(found, anchors, "anchor", "doc_id").drop("anchor"), "repeated")
    paths = repeated.groupBy("path").agg(
        F.min(F.struct("doc_id", F.element_at("pos", 1).alias("pos"))).alias("f"), F.max("doc_id").alias("hi"), F.max("branches").alias("branches"), F.min("head").alias("head"), F.min("tail").alias("tail"), F.min("n").alias("n")
    )
    paths = stored(paths.select("path", F.col("f.doc_id").alias("source"), F.col("f.pos").alias("source_pos"), "hi", "branches", "head", "tail", "n"), "paths")

    # 2. chains of repeated paths
    by_path = spans_of_paths(repeated, paths.where("source < hi"))

    # 3. where anchors branch, the windows of each path's first document
    asked = stored(paths.where("branches").groupBy(F.col("source").alias("doc_id")).agg(F.collect_list("path").alias("paths")), "asked")
    windows = only_ids(texts, asked.select("doc_id")).join(asked, "doc_id").mapInArrow(windows_of_paths, "doc_id long, window long, pos int")
    by_window = spans_of_windows(stored(windows, "windows"))

    # 4. the words at the sources
    spans = stored(by_path.unionByName(by_window).select("doc_id", F.col("pos").cast("int"), F.col("n").cast("int"), "source", F.col("source_pos").cast("int")).distinct(), "spans")
    different = stored(spans.select("source", "source_pos", "n").distinct(), "different")
    parts = stored(different.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "parts")
    dealt = attached(different, parts, "source", "source_pos").withColumn("part", F.pmod(F.xxhash64("source_pos", "n"), "parts"))
    lists = dealt.groupBy(F.col("source").alias("doc_id"), "part").agg(F.collect_list(F.struct("source_pos", "n")).alias("asked"))
    digests = only_ids(texts, parts.select(F.col("source").alias("doc_id"))).join(lists, "doc_id").select("doc_id", "text", "asked")
    digests = stored(digests.mapInArrow(source_digests, "source long, source_pos int, n int, digest binary"), "digests")
    gone = spans.join(digests, ["source", "source_pos", "n"]).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n", "digest")).alias("spans"))
    gone = stored(gone, "gone")

    ids = gone.select("doc_id")
    touched = only_ids(texts, ids).join(gone, "doc_id").select("doc_id", "text", "spans")
    whole = only_ids(texts, ids, "left_anti").select("doc_id", "text", F.lit(None).cast(gone.schema["spans"].dataType).alias("spans"))
    return touched.unionByName(whole).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
