"""Language-model scores of documents by online logistic context mixing (context_mixing).

1. Spark counts all training tokens. From the counts come how often each byte
   is seen, which gives the code of bytes, and the size of the tables.
2. Each task counts the symbols of its training documents by context in tables.
   They are summed in Spark, piece by piece and FAN_IN tasks at a time, so no
   group grows with the number of tasks.
3. Tables of at most 2 ** WHOLE_BITS rows are broadcast; each document is scored
   on its own, so scores do not depend on how rows are dealt.
4. Larger tables, which grow with the text, are never in one place: a task counts
   its texts chunk by chunk, the counts of a chunk's contexts go to the pieces of
   the tables, and each piece sends back to a chunk the sums of the rows that it
   meets. The chunk's texts are scored with these. Both ways give the same scores.

The base score needs the count of every token. The counts of frequent tokens, at
most HEAD, go with the model: those of the highest classes of counts, which a
histogram of classes gives without a sort. All other tokens of a document are
joined with the table of counts.

Defined cases: null text counts as empty and has one token, the end; equal rows
are scored each on its own; with no training document all tokens are unknown;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import context_mixing as M
from ledgerlight.llm.common import as_bytes, stored, words

HEAD = 1 << 18  # frequent tokens that go with the model, at most
CLASSES = 8  # of counts, for each doubling
COUNTED = 300_000  # different tokens that a task counts before it hands them on
PIECE_ROWS = 4096  # of a table, at most
FAN_IN = 64
GROUP_BYTES = 1 << 17  # of texts that are scored or counted together; one at least
WHOLE_BITS = 18  # of tables that are broadcast
#: Bytes and entries of a chunk, about, a group of texts at least; rows of a piece of a table that isn't broadcast; occurrences and entries held unsummed.
CHUNK_BYTES, CHUNK_ENTRIES, PART_BITS, HELD = 1 << 24, 6 << 20, 14, 1 << 20


def tokens_of(text: bytes | None) -> list[bytes]:
    return words(text.lower()) if text else []


def groups_of(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for hi, text in enumerate(texts, start=1):
        size += len(text or b"")
        if size >= GROUP_BYTES or hi == len(texts):
            yield lo, hi
            lo, size = hi, 0


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    counts: Counter = Counter()
    for b in batches:
        for text in as_bytes(b.column("text")):
            counts.update(tokens_of(text))
            counts[M.END] += 1
        if len(counts) > COUNTED:
            yield rows(counts)
            counts = Counter()
    yield rows(counts)


def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) -> (byte, n): of the tokens, each with the space or, for the end, the line end behind it."""
    seen = np.zeros(256, np.int64)
    for b in batches:
        tokens, n = b.column("token").to_pylist(), b.column("n").to_numpy()
        sizes = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        seen += np.bincount(raw, np.repeat(n, sizes), minlength=256).astype(np.int64)
        seen[M.SPACE] += int(n[sizes > 0].sum())
        seen[M.NEWLINE] += int(n[sizes == 0].sum())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(seen)], ["byte", "n"])


def byte_counts(counts: DataFrame) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for r in counts.mapInArrow(count_bytes, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def frequent_tokens(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The tokens of the highest classes of counts that make at most HEAD together, and their counts."""
    of = F.floor(F.log2("n") * CLASSES).cast("int")
    total, least = 0, math.inf
    for r in sorted(counts.groupBy(of.alias("c")).agg(F.count(F.lit(1)).alias("kinds")).collect(), key=lambda r: -r["c"]):
        total += r["kinds"]
        if total > HEAD:
            break
        least = r["c"]
    if math.isinf(least):
        return [], np.zeros(0, np.int64)
    head = counts.where(of >= least).select("token", "n").toArrow()
    return head.column("token").to_pylist(), head.column("n").to_numpy()


def fit_tables(texts: DataFrame, code: M.Code, bits: int) -> M.Model:
    def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, some = M.new_counts(bits), False
        for b in batches:
            raw = as_bytes(b.column("text"))
            for lo, hi in groups_of(raw):
                M.add_counts(tables, code, [tokens_of(t) for t in raw[lo:hi]], bits)
                some = True
        if some:
            part = TaskContext.get().partitionId()
            for k, t in enumerate(tables):
                pieces = [(k, i, part, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(t[lo : lo + PIECE_ROWS] for lo in range(0, len(t), PIECE_ROWS))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["k", "piece", "part", "counts"])

    def added(group: pd.DataFrame) -> np.ndarray:
        total = 0
        for x in group["counts"]:
            total = total + np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)
        return total

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.minimum(added(group), 2**32 - 1).astype(np.uint32)
        return pd.DataFrame({"k": group["k"].iloc[:1], "piece": group["piece"].iloc[:1], "part": group["part"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        logits, levels = code.packed(added(group).reshape(-1, M.LEAVES))
        return pd.DataFrame({"k": group["k"].iloc[:1], "piece": group["piece"].iloc[:1], "logits": [zlib.compress(logits.tobytes(), 1)], "levels": [levels.tobytes()]})

    schema = "k int, piece int, part long, counts binary"
    rows = stored(texts.mapInArrow(one_task, schema), "tables")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while parts > FAN_IN:
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN))
        rows = stored(rows.groupBy("k", "piece", "part").applyInPandas(add, schema), "tables")
        parts = -(-parts // FAN_IN)
    sizes = M.table_rows(bits)
    logits, levels = [np.zeros((n, M.LEAVES), np.int16) for n in sizes], [np.zeros(n, np.uint8) for n in sizes]
    for r in rows.groupBy("k", "piece").applyInPandas(finish, "k int, piece int, logits binary, levels binary").toLocalIterator():
        part = np.frombuffer(zlib.decompress(r["logits"]), np.int16).reshape(-1, M.LEAVES)
        lo = r["piece"] * PIECE_ROWS
        logits[r["k"]][lo : lo + len(part)] = part
        levels[r["k"]][lo : lo + len(part)] = np.frombuffer(r["levels"], np.uint8)
    return M.Model(code, bits, [x.reshape(-1) for x in logits], levels)


def planes(x: np.ndarray) -> bytes:
    """First the lowest byte of each number, then the next: mostly zeros, which take no room when compressed."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def of_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def packed_entries(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys of a piece and their numbers."""
    return zlib.compress(planes(np.concatenate([np.diff(keys, prepend=0), n])), 1)


def entries_of(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = of_planes(zlib.decompress(x)).reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


class Chunk:
    """The (row, symbol) pairs of texts, by predictor, and how often training texts have them."""

    def __init__(self) -> None:
        self.size, self.raw, self.sums = 0, [[] for _ in range(M.INPUTS)], [[] for _ in range(M.INPUTS)]

    def add(self, code: M.Code, group: list[list[bytes]], counted: np.ndarray, bits: int, size: int) -> None:
        self.size += size
        for held, x in zip(self.raw, M.occurrences(code, group, counted, bits), strict=True):
            held.append(x)
        if sum(map(len, self.raw[0])) >= HELD:
            self.settle()

    def settle(self, whole: bool = False) -> None:
        for k, (raw, sums) in enumerate(zip(self.raw, self.sums, strict=True)):
            if raw:
                sums.append(M.sparse_counts(np.concatenate(raw)))
            if len(sums) > 1 and (whole or sum(len(x) for x, _ in sums[1:]) >= max(HELD, len(sums[0][0]))):
                self.sums[k] = [M.sparse_sum(*map(list, zip(*sums, strict=True)))]
            self.raw[k] = []

    def entries(self) -> int:
        return sum(len(x) for sums in self.sums for x, _ in sums)

    def full(self) -> bool:
        if self.size < CHUNK_BYTES and self.entries() >= CHUNK_ENTRIES:
            self.settle(whole=True)
        return self.size >= CHUNK_BYTES or self.entries() >= CHUNK_ENTRIES

    def pieces(self) -> Iterator[tuple[int, int, bytes]]:
        self.settle(whole=True)
        for k, sums in enumerate(self.sums):
            for key, n in sums:
                piece = key >> PART_BITS + M.LEAF_BITS
                first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
                for lo, hi in zip(first, [*first[1:], len(key)], strict=True):
                    yield k, int(piece[lo]), packed_entries(key[lo:hi] & (1 << PART_BITS + M.LEAF_BITS) - 1, n[lo:hi])


def compressed(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(b)
    return sink.getvalue().to_pybytes()


def in_chunks(texts: DataFrame, code: M.Code, bits: int) -> DataFrame:
    """The texts by chunk, some in a row, compressed, and the chunks' entries by piece, in one table."""
    names = ["chunk", "texts", "k", "piece", "entries"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 16, Chunk()

        def table(n: int, own: dict) -> pa.RecordBatch:
            own = {"chunk": pa.array(np.full(n, number))} | own
            return pa.RecordBatch.from_arrays([own[c].cast(t) if c in own else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names)

        def closed() -> Iterator[pa.RecordBatch]:
            found = [*chunk.pieces()]
            for lo in range(0, len(found), 1024):
                k, piece, entries = zip(*found[lo : lo + 1024], strict=True)
                yield table(len(k), {"k": pa.array(k), "piece": pa.array(piece), "entries": pa.array(entries, pa.binary())})

        for b in batches:
            raw = as_bytes(b.column("text"))
            counted = np.array([bool(x) for x in b.column("training").to_pylist()], bool)
            for lo, hi in groups_of(raw):
                yield table(1, {"texts": pa.array([compressed(b.slice(lo, hi - lo))], pa.binary())})
                chunk.add(code, [tokens_of(t) for t in raw[lo:hi]], counted[lo:hi], bits, sum(len(t or b"") + 1 for t in raw[lo:hi]))
                if chunk.full():
                    yield from closed()
                    number, chunk = number + 1, Chunk()
        yield from closed()

    return stored(texts.mapInArrow(run, "chunk long, texts binary, k int, piece int, entries binary"), "chunks")


def answered(group: pa.Table) -> pa.Table:
    """Of a piece: to each chunk, the rows that it has, with the symbols seen in training and how often."""
    found, total = [entries_of(x.as_py()) for x in group.column("entries")], np.zeros(1 << PART_BITS + M.LEAF_BITS, np.int64)
    for key, n in found:
        total[key] += n
    total, out = np.minimum(total, 2**32 - 1).astype(np.uint32).reshape(-1, M.LEAVES), []
    for key, _ in found:
        row = key >> M.LEAF_BITS
        row = row[np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))]
        counts = total[row]
        of, symbol = np.nonzero(counts)
        parts = np.array([len(row)], np.uint32), row.astype(np.uint16), np.bincount(of, minlength=len(row)).astype(np.uint8), symbol.astype(np.uint8)
        out.append(zlib.compress(b"".join(x.tobytes() for x in parts) + planes(counts[of, symbol]), 1))
    return pa.table([group.column("chunk"), group.column("k"), group.column("piece"), pa.array(out, pa.binary())], ["chunk", "k", "piece", "rows"])


def chunk_model(code: M.Code, bits: int, rows: pa.Table) -> M.Model:
    """Of the rows that a chunk was sent."""
    parts: list[list[tuple]] = [[] for _ in range(M.INPUTS)]
    for k, piece, x in zip(rows.column("k").to_pylist(), rows.column("piece").to_pylist(), rows.column("rows"), strict=True):
        x = zlib.decompress(x.as_py())
        n = int(np.frombuffer(x, np.uint32, 1)[0])
        times = np.frombuffer(x, np.uint8, n, 4 + 2 * n)
        m = int(times.sum())
        parts[k].append(((piece << PART_BITS) + np.frombuffer(x, np.uint16, n, 4).astype(np.int64), times, np.frombuffer(x, np.uint8, m, 4 + 3 * n), of_planes(x[4 + 3 * n + m :])))
    logits, levels, places = [], [], []
    for b, own in zip(M.hash_bits(bits), parts, strict=True):
        row, times, symbol, n = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.argsort(row & (1 << min(b, M.INDEX_BITS)) - 1, kind="stable")
        to = np.empty(len(row), np.int64)
        to[order] = np.arange(len(row))
        logit, level, ends = np.empty((len(row), M.LEAVES), np.int16), np.empty(len(row), np.uint8), np.cumsum(times, dtype=np.int64)
        for lo in range(0, len(row), PIECE_ROWS):
            hi = min(lo + PIECE_ROWS, len(row))
            some = slice(ends[lo] - times[lo], ends[hi - 1])
            counts = np.zeros((hi - lo, M.LEAVES), np.int64)
            counts[np.repeat(np.arange(hi - lo), times[lo:hi]), symbol[some]] = n[some]
            logit[to[lo:hi]], level[to[lo:hi]] = code.packed(counts)
        logits.append(logit.reshape(-1))
        levels.append(level)
        places.append(M.Rows(row[order], b))
    return M.Model(code, bits, logits, levels, places)


class Base:
    """Logarithms of the counts of the frequent tokens; a worker builds its index once."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray) -> None:
        self.tokens, self.logs, self.index = tokens, np.log10(counts + 1.0), {}

    def of(self, token_lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each document, ends included: how many tokens are frequent, the sum of their logarithms, hashes of the others."""
        if not self.index and self.tokens:
            self.index = {t: i for i, t in enumerate(self.tokens)}
        sizes = np.array([len(w) + 1 for w in token_lists])
        flat = [*chain.from_iterable(chain(w, (M.END,)) for w in token_lists)]
        ids = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        known = np.flatnonzero(ids >= 0)
        logs = np.bincount(doc[known], self.logs[ids[known]], minlength=len(sizes))
        other = np.flatnonzero(ids < 0)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(flat[i]) - (1 << 63) for i in other.tolist()), np.int64, len(other))
        return np.bincount(doc[known], minlength=len(sizes)), logs, np.split(hashes, np.cumsum(np.bincount(doc[other], minlength=len(sizes)))[:-1])


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: one row for each row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), training.alias("training"))
    known = texts.where("training").select("text")
    counts = known.mapInArrow(count_tokens, "token binary, n long").where("n > 0").groupBy("token").agg(F.sum("n").alias("n"))
    counts = stored(counts, "counts")
    train_tokens, kinds = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    seen = byte_counts(counts)
    base = spark.sparkContext.broadcast(Base(*frequent_tokens(counts)))
    code, bits = M.Code(seen), M.table_bits(int(seen.sum()))

    def scores(b: pa.RecordBatch, model: M.Model, first: int) -> Iterator[pa.RecordBatch]:
        """Rows are numbered from first on."""
        raw = as_bytes(b.column("text"))
        for lo, hi in groups_of(raw):
            group = [tokens_of(t) for t in raw[lo:hi]]
            n, logs, rest = base.value.of(group)
            cost = model.score(group)
            rows = [b.column("doc_id").slice(lo, hi - lo), b.column("training").slice(lo, hi - lo)]
            rows.append(pa.array(first + lo + np.arange(hi - lo)))
            rows.append(pa.array([len(w) + 1 for w in group], pa.int64()))
            rows.append(pa.array(n, pa.int64()))
            rows.append(pa.array(logs.astype(float)))
            rows.append(pa.array(cost * -math.log10(2), pa.float64()))
            rows.append(pa.array([x / max(1, len(t or b"")) for x, t in zip(cost, raw[lo:hi], strict=True)], pa.float64()))
            rows.append(pa.array(rest, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "training", "row", "n_tokens", "n_known", "logs", "score", "bits_per_byte", "rest"])

    schema = "doc_id long, training boolean, row long, n_tokens long, n_known long, logs double, score double, bits_per_byte double, rest array<long>"
    if bits <= WHOLE_BITS:
        model = spark.sparkContext.broadcast(fit_tables(known, code, bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = TaskContext.get().partitionId() << 36
            for b in batches:
                yield from scores(b, model.value, first)
                first += len(b)

        scored = texts.mapInArrow(run, schema)
    else:
        both = in_chunks(texts, code, bits)
        tasks = max(1, both.select("chunk").distinct().count())  # given, as a chunk's bytes don't tell how long it takes
        entries = both.where(F.col("k").isNotNull()).select("chunk", "k", "piece", "entries")
        rows = entries.repartition(tasks, "k", "piece").groupBy("k", "piece").applyInArrow(answered, "chunk long, k int, piece int, rows binary")

        def run_chunk(key: tuple, own: pa.Table, rows: pa.Table) -> pa.Table:
            model, first, out = chunk_model(code, bits, rows), key[0].as_py() << 25, []
            for x in own.column("texts"):
                for b in pa.ipc.open_stream(x.as_buffer()):
                    out += scores(b, model, first)
                    first += len(b)
            return pa.Table.from_batches(out)

        own, spread = both.where(F.col("k").isNull()).select("chunk", "texts"), 4 * tasks  # so that few tasks get several chunks
        scored = own.repartition(spread, "chunk").groupBy("chunk").cogroup(rows.repartition(spread, "chunk").groupBy("chunk")).applyInArrow(run_chunk, schema)
    scored = stored(scored, "scores")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in b.column("token").to_pylist()], pa.int64()), b.column("n")], ["token", "n"])

    by_hash = counts.mapInArrow(hashed, "token long, n long")
    others = scored.select("row", F.explode("rest").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("times"))
    more = others.join(by_hash, "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more_logs"))
    scale = math.log10(train_tokens + kinds + 1)
    return scored.join(more, "row", "left").select(
        "doc_id",
        "training",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
        "bits_per_byte",
    )
