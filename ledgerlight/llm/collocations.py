"""Phrase collocation mining: frequent phrases of two to four words of each language, scored by their weakest cut.

Words have 64-bit hashes by language; that no two words share one is checked on
the table of all words, else another seed is taken. Frequent words are numbered
by the sorted hashes (8 bytes each are broadcast, for one word in `least` of the
corpus at most). Candidates are Apriori-safe: pairs must consist of frequent
words, longer phrases of frequent pairs. Tasks sum the candidates of their texts,
Spark sums these by the words' numbers, packed into longs, and those that can't
reach the least count go. The others form double-array tries, in shards of at
most about NODES phrases by first word, built in tasks and broadcast without the
phrases' keys, which stay in the shared folder. To count, numpy advances the states
of all text positions of a block at once, level by level; accepting states are
binned, the shards' and partitions' bins summed and put beside the keys.

Cutting a phrase after its first k words gives l = f(first part), r = f(rest)
and score = floor(SCALE * a / (l + r)); the lowest cut counts. Phrases that lie in
a longer candidate with at least KEPT percent of their count are dropped. As both
parts of a cut are as frequent as the phrase, its first and last word bound its
score from above, and pairs' words give theirs: phrases that can't reach what
enough pairs of their language have are not cut. Ranks are taken within a
language; Spark limits each partition before it deals rows by language. Products
are decimals, as they may pass 64 bits.

Texts are read twice: to count words, and to store the numbers of frequent ones.

Defined cases: null text is empty and has no words; null languages are `und`;
equal rows count each on its own, whatever doc_id is; an empty table gives an
empty result; further columns are ignored; texts are taken as valid UTF-8.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.llm.common import as_bytes, attached, mix, release, small, stored

LONGEST, LEAST, KEPT, SCALE, TOP = 4, 30, 80, 2_000_000, 2000
#: Phrases of a trie's shard; phrases that a task keeps before it sums them (summing takes five times their 16 bytes).
NODES, HELD = 1 << 18, 1 << 19
#: What goes to a worker at once, where the session has Spark's own defaults: blocks of numbers are some MB a row.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}
#: Rows that go from a worker to Spark at once; states whose bins are a row; tasks whose bins are summed together.
SLICE, PART, FAN_IN = 1 << 16, 1 << 16, 64
#: Bytes of texts whose positions are advanced together (longer texts are a block each, read in such parts); seeds to try.
BLOCK, SEEDS = 1 << 22, 8
#: Columns of a phrase: numbers of its first and second, third and fourth word, 32 bits each; 0 is no word.
PACKED = ["head", "tail"]
#: ASCII capitals in lower case, blanks for tabs, and line feeds for all that ends a piece.
FOLDED = bytes(0x0A if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A word that no text has; it stands between pieces.
END = b"\xff"


class Reader:
    """Numbers words by language as they come; 0 is the end of a piece. A full reader is emptied between blocks."""

    LIMIT = 250_000

    def __init__(self, seed: int) -> None:
        self.seed, self.generation = seed, 0
        self.clear()

    def clear(self) -> None:
        self.generation += 1
        self.index: dict[str, dict[bytes, int]] = {}
        self.names: list[tuple[str, bytes]] = [("", b"")]
        self.hashes = [0]

    def full(self) -> bool:
        return len(self.names) > self.LIMIT

    def learn(self, lang: str, words: set[bytes]) -> None:
        index, n = self.index[lang], len(self.names)
        seed = xxhash.xxh3_64_intdigest(lang.encode(), self.seed)
        self.hashes += [xxhash.xxh3_64_intdigest(w, seed) or 1 for w in words]
        self.names += [(lang, w) for w in words]
        index.update(zip(words, range(n, n + len(words)), strict=True))

    def read(self, lang: str, text: bytes) -> Iterator[np.ndarray]:
        """Numbers of the words of a text, in parts, the last of which ends the piece."""
        index = self.index.setdefault(lang, {END: 0})
        text = text.translate(FOLDED)
        lo = 0
        while lo < len(text):
            hi = text.find(b" ", lo + BLOCK) if len(text) - lo > BLOCK else -1
            words = text[lo : hi if hi >= 0 else len(text)].replace(b"\n", b" \xff ").split()
            lo = hi if hi >= 0 else len(text)
            out = np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))
            if len(new := np.flatnonzero(out < 0)):
                self.learn(lang, {words[k] for k in new.tolist()})
                out[new] = np.fromiter(map(index.__getitem__, map(words.__getitem__, new.tolist())), np.int32, len(new))
            yield out
        yield np.zeros(LONGEST, np.int32)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Numbers of all words of many texts; between blocks the caller may clear the reader."""
        for batch in small(batches):
            parts, size = [], 0
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
                parts += self.read(lang, text)
                size += len(text)
                if size >= BLOCK:
                    yield np.concatenate(parts)
                    parts, size = [], 0
            if parts:
                yield np.concatenate(parts)


class Lookup:
    """A value for each number of a reader, computed from the hashes of those that are new."""

    def __init__(self, compute, dtype) -> None:
        self.compute, self.values, self.generation = compute, np.zeros(0, dtype), 0

    def of(self, reader: Reader) -> np.ndarray:
        if self.generation != reader.generation:
            self.generation, self.values = reader.generation, self.values[:0]
        if len(self.values) < len(reader.hashes):
            new = np.array(reader.hashes[len(self.values) :], np.uint64)
            self.values = np.concatenate([self.values, self.compute(new).astype(self.values.dtype)])
        return self.values


def phrase_keys(w: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's words."""
    key = w[:, 0].copy()
    for k in range(1, w.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + w[:, k] + np.uint64(k))
    return key


@dataclass(frozen=True)
class Trie:
    """A double array: from state s the symbol c leads to t = base[s] + c if check[t] is s. State 0 is the root; keys of the states' phrases (none in one that is broadcast)."""

    alphabet: np.ndarray
    base: np.ndarray
    check: np.ndarray
    keys: np.ndarray

    def symbols(self, numbers: np.ndarray) -> np.ndarray:
        """Of words by their numbers, from 1; 0 for those that the trie hasn't."""
        most = int(max(numbers.max(initial=0), self.alphabet[-1] if len(self.alphabet) else 0))
        table = np.zeros(most + 1, np.int32)
        table[self.alphabet.astype(np.int64)] = np.arange(1, len(self.alphabet) + 1)
        return table[numbers]

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        to = self.base[states] + symbols
        to[(symbols == 0) | (to < 0) | (to >= len(self.check))] = 0
        return np.where(self.check[to] == states, to, -1)

    def levels(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: the positions where a phrase of that length begins, and its states."""
        symbols = np.append(self.symbols(numbers), np.zeros(LONGEST, np.int32))
        at = np.flatnonzero(symbols)
        states = np.zeros(len(at), np.int32)
        for k in range(LONGEST):
            states = self.advance(states, symbols[at + k])
            on = states >= 0
            at, states = at[on], states[on]
            yield at, states


class Places:
    """Slots of a double array that are still free."""

    def __init__(self, size: int) -> None:
        self.free, self.low = np.ones(size, bool), 1

    def grow(self, size: int) -> None:
        if size > len(self.free):
            self.free = np.append(self.free, np.ones(max(size, 2 * len(self.free)) - len(self.free), bool))

    def several(self, symbols: np.ndarray) -> int:
        """A base for sorted symbols: the first of the free slots, as they come, from which all have room. Slots passed over are left to single symbols."""
        some, span = max(16, 8192 // len(symbols)), int(symbols[-1] - symbols[0]) + 1
        while True:
            self.grow(self.low + 64 * some + span)
            slots = self.low + np.flatnonzero(self.free[self.low : self.low + 64 * some])[:some]
            base = slots - symbols[0]
            fits = np.flatnonzero(self.free[base[:, None] + symbols].all(axis=1)) if len(slots) else slots
            if len(fits):
                base = int(base[fits[0]])
                self.free[base + symbols] = False
                return base
            self.low = int(slots[-1]) + 1 if len(slots) else self.low + 64 * some

    def single(self, n: int) -> np.ndarray:
        """n free slots."""
        slots = np.flatnonzero(self.free[1:])[:n] + 1
        if len(slots) < n:
            more = np.arange(len(self.free), len(self.free) + n - len(slots))
            self.grow(int(more[-1]) + 1)
            slots = np.append(slots, more)
        self.free[slots] = False
        return slots


def build_trie(w: np.ndarray) -> Trie:
    """Of phrases (rows of word hashes, 0 beyond the end); with each phrase all that it begins with of two and more words must be there."""
    alphabet = np.unique(w[w != 0])
    symbols = np.where(w == 0, 0, np.searchsorted(alphabet, w) + 1)
    size = (w != 0).sum(axis=1)
    places = Places(len(alphabet) + 1)
    slots = np.unique(symbols[:, 0])  # the root's base is 0
    places.free[slots] = False
    parts = [(slots, np.zeros(len(slots), np.int64), alphabet[slots - 1])]
    bases: list[tuple[np.ndarray, np.ndarray]] = []
    known, known_slots = alphabet[slots - 1], slots
    for k in range(2, LONGEST + 1):
        rows = np.flatnonzero(size == k)
        if not len(rows):
            break
        order = np.argsort(known)
        parent = known_slots[order][np.searchsorted(known[order], phrase_keys(w[rows, : k - 1]))]
        own = symbols[rows, k - 1]
        order = np.lexsort((own, parent))
        rows, parent, own = rows[order], parent[order], own[order]
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        count = np.diff(np.append(first, len(rows)))
        base = np.zeros(len(first), np.int64)
        for g in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():
            base[g] = places.several(own[first[g] : first[g] + count[g]])
        alone = count == 1
        base[alone] = places.single(int(alone.sum())) - own[first[alone]]
        known, known_slots = phrase_keys(w[rows, :k]), np.repeat(base, count) + own
        bases.append((parent[first], base))
        parts.append((known_slots, parent, known))
    n = int(max(p[0].max() for p in parts)) + 1
    table, check, keys = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n, np.uint64)
    for states, values in bases:
        table[states] = values
    for states, parent, own in parts:
        check[states], keys[states] = parent, own
    leaves = np.ones(n, bool)
    leaves[0] = False
    for states, _ in bases:
        leaves[states] = False
    table[leaves] = n  # leads nowhere
    return Trie(alphabet, table, check, keys)


def longs(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, pa.int64()) for c in columns], names)


def packed(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (one.astype(np.int64) << 32) | other


def matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Rows of word numbers, 0 beyond a phrase's end."""
    columns = [batch.column(c).to_numpy() for c in PACKED]
    return np.stack([x for c in columns for x in (c >> 32, c & 0xFFFFFFFF)], axis=1).astype(np.uint64)


def count_words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    reader, counts = Reader(seed), np.zeros(0, np.int64)

    def flush() -> pa.RecordBatch:
        some = np.flatnonzero(counts[1:]) + 1
        names = [reader.names[k] for k in some.tolist()]
        word = pa.array([w for _, w in names], pa.binary()).view(pa.string())
        hashes = np.array(reader.hashes, np.uint64)[some].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([x for x, _ in names], pa.string()), word, pa.array(counts[some], pa.int64())], ["h", "lang", "word", "n"])

    for ids in reader.blocks(batches):
        new = np.bincount(ids, minlength=len(reader.names))
        new[: len(counts)] += counts
        counts = new
        if reader.full():
            yield flush()
            reader.clear()
            counts = counts[:0]
    yield flush()
    release()


def emitted(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows of packed columns with their counts, summed HELD at a time."""
    held: list[tuple[np.ndarray, ...]] = []

    def summed() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        if len(columns) > 1:
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
        else:
            columns[0].sort()
        new = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
        n = np.diff(np.append(new, len(columns[0])))
        for lo in range(0, len(new), SLICE):
            yield longs([*(c[new[lo : lo + SLICE]] for c in columns), n[lo : lo + SLICE]], [*PACKED[: len(columns)], "n"])

    size = 0
    for columns in found:
        if len(columns[0]):
            held.append(columns)
            size += len(columns[0])
        if size >= HELD:
            yield from summed()
            size = 0
    if held:
        yield from summed()
    release()


def numbered(vocabulary: np.ndarray):
    """Numbers of words by their hashes: from 1 in the vocabulary's order, 0 for others."""

    def compute(hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(vocabulary, hashes).clip(max=max(0, len(vocabulary) - 1))
        return np.where(vocabulary[at] == hashes, at + 1, 0) if len(vocabulary) else np.zeros(len(hashes), np.int64)

    return compute


def encoded(batches: Iterator[pa.RecordBatch], seed: int, known: Broadcast) -> Iterator[pa.RecordBatch]:
    """numbers: those of the words of many texts, 32 bits each; pieces end in 0, as do rows."""
    reader, table = Reader(seed), Lookup(numbered(known.value), np.int32)
    for ids in reader.blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([table.of(reader)[ids].tobytes()], pa.binary())], ["numbers"])
        if reader.full():
            reader.clear()
    release()


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.column("numbers"):
            yield np.frombuffer(row.as_buffer(), np.int32)


def frequent_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words of the vocabulary."""

    def found() -> Iterator[tuple[np.ndarray, ...]]:
        for w in blocks_of(batches):
            at = np.flatnonzero((w[:-1] != 0) & (w[1:] != 0))
            yield (packed(w[at], w[at + 1]),)

    return emitted(found())


def longer_phrases(batches: Iterator[pa.RecordBatch], tries: dict[int, Broadcast]) -> Iterator[pa.RecordBatch]:
    """Phrases of three and four words all of whose pairs are frequent."""

    def found() -> Iterator[tuple[np.ndarray, ...]]:
        for w in blocks_of(batches):
            pair = np.zeros(len(w), bool)
            for t in tries.values():
                for size, (at, _) in enumerate(t.value.levels(w), start=1):
                    if size == 2:
                        pair[at] = True
                        break
            three = pair[:-1] & pair[1:]
            at = np.flatnonzero(three)
            yield packed(w[at], w[at + 1]), packed(w[at + 2], np.zeros(len(at), np.int64))
            at = np.flatnonzero(three[:-1] & pair[2:])
            yield packed(w[at], w[at + 1]), packed(w[at + 2], w[at + 3])

    return emitted(found())


BINS = "shard int, part int, task int, counts binary"


def binned(batches: Iterator[pa.RecordBatch], tries: dict[int, Broadcast]) -> Iterator[pa.RecordBatch]:
    """Counts of the partition's accepting states (two words and more), PART states a row."""
    shards = {shard: (t.value, np.zeros(len(t.value.check), np.int64)) for shard, t in tries.items()}
    for w in blocks_of(batches):
        for trie, bins in shards.values():
            for size, (_, states) in enumerate(trie.levels(w), start=1):
                if size > 1 and len(states):
                    bins += np.bincount(states, minlength=len(bins))
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    for shard, (_, bins) in shards.items():
        for part, lo in enumerate(range(0, len(bins), PART)):
            if bins[lo : lo + PART].any():
                row = shard, part, task, zlib.compress(bins[lo : lo + PART].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["shard", "part", "task", "counts"])
    release()


def added(group: pa.Table) -> pa.Table:
    """One row for the rows of a part of a shard: the sum of their bins."""
    total = np.zeros(0, np.int64)
    for row in group.column("counts"):
        bins = np.frombuffer(zlib.decompress(row.as_buffer()), np.int64)
        total = bins + total if len(total) else bins
    first = [group.column(c)[0].as_py() for c in ("shard", "part", "task")]
    return pa.table([pa.array([x], t) for x, t in zip((*first, zlib.compress(total.tobytes(), 1)), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["shard", "part", "task", "counts"])


def key_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a shard's states in the parts in which its bins are counted."""
    for b in batches:
        for shard, row in zip(b.column("shard").to_pylist(), b.column("keys"), strict=True):
            keys = row.as_buffer()
            for part, lo in enumerate(range(0, keys.size, 8 * PART)):
                own = keys.slice(lo, min(8 * PART, keys.size - lo)).to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([own], pa.binary())], ["shard", "part", "keys"])
    release()


def counted(numbers: DataFrame, tries: dict[int, Broadcast], built: DataFrame) -> DataFrame:
    """key, a: how often each phrase of the tries occurs. Bins are summed over FAN_IN tasks, then over what these give, and meet their keys."""

    def spread(sums: pa.Table, keys: pa.Table) -> pa.Table:
        if not sums.num_rows:  # none of the part's phrases occurs
            return pa.Table.from_batches([longs([np.zeros(0, np.int64)] * 2, ["key", "a"])])
        bins = np.frombuffer(zlib.decompress(added(sums).column("counts")[0].as_buffer()), np.int64)
        some = np.flatnonzero(bins)
        out = pa.Table.from_batches([longs([np.frombuffer(keys.column("keys")[0].as_buffer(), np.uint64)[some], bins[some]], ["key", "a"])])
        release()
        return out

    rows = numbers.mapInArrow(lambda batches: binned(batches, tries), BINS)
    sums = rows.groupBy("shard", "part", (F.col("task") / FAN_IN).cast("int").alias("_group")).applyInArrow(added, BINS)
    keys = built.select("shard", "keys").mapInArrow(key_parts, "shard int, part int, keys binary")
    return sums.groupBy("shard", "part").cogroup(keys.groupBy("shard", "part")).applyInArrow(spread, "key long, a long")


#: What is broadcast of a trie, by type.
SENT = {"alphabet": np.uint64, "base": np.int32, "check": np.int32}


def shared_tries(phrases: DataFrame) -> tuple[dict[int, Broadcast], DataFrame]:
    """Broadcast tries of the phrases by shard, each of about NODES of them, built in tasks of their own, and the stored table of what was built."""
    spark = phrases.sparkSession
    shards = max(1, -(-phrases.count() // NODES))

    def build(group: pa.Table) -> pa.Table:
        t = build_trie(matrix(group))
        return pa.table({"shard": group.column("shard").slice(0, 1), **{n: pa.array([zlib.compress(getattr(t, n).tobytes(), 1)], pa.binary()) for n in SENT}, "keys": pa.array([t.keys.tobytes()], pa.binary())})

    shard = F.pmod(F.xxhash64(F.shiftright("head", 32)), F.lit(shards)).cast("int")
    built = stored(phrases.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard int, alphabet binary, base binary, check binary, keys binary"), "tries")
    out = {}
    for n in sorted(r["shard"] for r in built.select("shard").collect()):
        # a shard at a time passes the driver, compressed and as Arrow: pickled rows of such arrays take many times their size there
        t = built.where(F.col("shard") == n).select(*SENT).toArrow()
        out[n] = spark.sparkContext.broadcast(Trie(**{c: np.frombuffer(zlib.decompress(t.column(c)[0].as_buffer()), kind) for c, kind in SENT.items()}, keys=np.zeros(0, np.uint64)))
        del t
        release()
    return out, built


def forget(shared: Iterable[Broadcast]) -> None:
    """What these were for is stored: executors and driver drop them."""
    for b in shared:
        b.destroy()


def keyed(phrases: DataFrame) -> DataFrame:
    """With size and key."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = matrix(b)
            size = (w != 0).sum(axis=1)
            key = np.zeros(len(w), np.uint64)
            for k in range(2, LONGEST + 1):
                key[size == k] = phrase_keys(w[size == k, :k])
            yield longs([*(b.column(c).to_numpy() for c in PACKED), size, key], [*PACKED, "size", "key"])
        release()

    return phrases.select(*PACKED).mapInArrow(add, ", ".join(f"{c} long" for c in [*PACKED, "size", "key"]))


def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, a, k, left, right: the keys of both parts of each phrase's cuts."""
    for b in batches:
        w, size, key, a = matrix(b), *(b.column(c).to_numpy() for c in ("size", "key", "a"))
        for n in range(2, LONGEST + 1):
            own = np.flatnonzero(size == n)
            for k in range(1, n):
                yield longs([key[own], a[own], np.full(len(own), k), phrase_keys(w[own, :k]), phrase_keys(w[own, k:n])], ["key", "a", "k", "left", "right"])


def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, longer: the keys of the phrases in each phrase, with its count."""
    for b in batches:
        w, size, a = matrix(b), *(b.column(c).to_numpy() for c in ("size", "a"))
        for n in range(3, LONGEST + 1):
            own = np.flatnonzero(size == n)
            for width in range(2, n):
                for lo in range(n - width + 1):
                    yield longs([phrase_keys(w[own, lo : lo + width]), a[own]], ["key", "longer"])
    release()


def numbered_words(frequent: DataFrame, known: Broadcast) -> DataFrame:
    """number (of the vocabulary), lang, word, n."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = numbered(known.value)(b.column("h").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), *(b.column(c) for c in ("lang", "word", "n"))], ["number", "lang", "word", "n"])

    return stored(frequent.mapInArrow(add, "number long, lang string, word string, n long"), "vocabulary")


def within_reach(phrases: DataFrame, langs: Broadcast, counts: Broadcast, top: int) -> DataFrame:
    """Phrases whose score may be among the `top` highest of their language. Bounds leave room for rounding."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, of = langs.value
        for b in batches:
            w, a = matrix(b).astype(np.int64), b.column("a").to_numpy().astype(float)
            f = np.append(0, counts.value).astype(float)
            size = (w != 0).sum(axis=1)
            first, last = f[w[:, 0]], f[w[np.arange(len(w)), size - 1]]
            most = SCALE * a / np.where(size == 2, first + last, a + np.maximum(first, last))
            lang = pa.DictionaryArray.from_arrays(pa.array(of[w[:, 0] - 1]), names).cast(pa.string())
            arrays = [*b.columns, lang, pa.array(most * (1 - 1e-9) - 1), pa.array(most * (1 + 1e-9))]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, "lang", "low", "high"])
        release()

    schema = ", ".join(f"{n} {t}" for n, t in phrases.dtypes)
    rows = stored(phrases.mapInArrow(bounds, f"{schema}, lang string, low double, high double"), "bounds")
    order = W.partitionBy("lang").orderBy(F.col("low").desc())
    least = rows.where("size = 2").select("lang", "low").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= top).where(F.col("_at") == top).select("lang", F.col("low").alias("least"))
    return rows.join(least, "lang", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select(*phrases.columns)


#: Keys of which a table's rows are picked by broadcast; more are shuffled.
PICKED = 100_000


def picked(table: DataFrame, rows: DataFrame, name: str, *columns: str) -> tuple[DataFrame, int]:
    """The table's rows whose `name` is in one of the columns, stored, and how many these are at most: what the driver broadcasts follows what is asked for."""
    keys = stored(rows.select(F.explode(F.array(*columns)).alias(name)).distinct(), "keys")
    n = keys.count()
    return stored(table.join(F.broadcast(keys) if n <= PICKED else keys, name, "left_semi"), "picked"), n


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is set otherwise than by Spark stays; what is changed here is set back."""
    was = {k: spark.conf.get(k) for k, (usual, _) in BATCHES.items() if spark.conf.get(k) == usual}
    for k in was:
        spark.conf.set(k, BATCHES[k][1])
    try:
        yield
    finally:
        for k, value in was.items():
            spark.conf.set(k, value)


def decimal(c: str) -> F.Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    with small_batches(docs.sparkSession):
        return ranked_phrases(docs, least, top)


def ranked_phrases(docs: DataFrame, least: int, top: int) -> DataFrame:
    """All that runs in Python is stored before this returns."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for seed in range(SEEDS):
        words = texts.mapInArrow(lambda batches: count_words(batches, seed), "h long, lang string, word string, n long")  # noqa: B023
        words = stored(words.groupBy("h", "lang", "word").agg(F.sum("n").alias("n")), "words")
        if not words.groupBy("h").count().where("count > 1").isEmpty():
            continue
        frequent = stored(words.where(F.col("n") >= least), "frequent")
        seen = frequent.select("h", "lang", "n").toArrow()
        h, n = (seen.column(c).to_numpy() for c in ("h", "n"))
        order = np.argsort(h.view(np.uint64))
        known = spark.sparkContext.broadcast(h.view(np.uint64)[order])
        numbers = stored(texts.mapInArrow(lambda batches: encoded(batches, seed, known), "numbers binary"), "numbers")  # noqa: B023

        def enough(rows: DataFrame, name: str) -> DataFrame:
            return stored(rows.groupBy(*rows.columns[:-1]).agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("n"), name)

        pairs = enough(numbers.mapInArrow(frequent_pairs, "head long, n long"), "pairs").withColumn("tail", F.lit(0).cast("long"))
        tries, _ = shared_tries(pairs)
        longer = enough(numbers.mapInArrow(lambda batches: longer_phrases(batches, tries), "head long, tail long, n long"), "longer")  # noqa: B023
        forget(tries.values())
        candidates = stored(keyed(pairs.unionByName(longer)), "candidates")
        if candidates.groupBy("key").count().where("count > 1").isEmpty() and candidates.where(F.col("key").between(0, len(known.value))).isEmpty():
            break  # keys differ, from words' numbers as well
    else:
        raise RuntimeError(f"{SEEDS} seeds gave two words or phrases one hash")
    tries, built = shared_tries(candidates.select(*PACKED))
    phrases = stored(candidates.join(counted(numbers, tries, built), "key").where(F.col("a") >= least), "phrases")
    forget(tries.values())
    longest = phrases.where("size > 2").mapInArrow(inside, "key long, longer long").groupBy("key").agg(F.max("longer").alias("longer"))
    kept = phrases.join(longest, "key", "left").where(F.col("longer").isNull() | (decimal("longer") * 100 < decimal("a") * KEPT)).drop("longer")
    said = numbered_words(frequent, known)
    lang = seen.column("lang").combine_chunks().dictionary_encode()
    lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    shared = [spark.sparkContext.broadcast(x) for x in ((lang.dictionary, lang.indices.to_numpy()[order]), n[order])]
    kept = stored(within_reach(kept, *shared, top), "kept")
    forget([known, *shared])
    f = phrases.select("key", F.col("a").alias("f")).unionByName(said.select(F.col("number").alias("key"), F.col("n").alias("f")))
    cut = stored(kept.mapInArrow(cuts, "key long, a long, k long, left long, right long"), "cuts")
    f, size = picked(f, cut, "key", "left", "right")
    cut = attached(cut, f.select(F.col("key").alias("left"), F.col("f").alias("l")), "left", "key", size)
    cut = attached(cut, f.select(F.col("key").alias("right"), F.col("f").alias("r")), "right", "key", size)
    score = F.expr(f"({SCALE}BD * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cut.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    number = {f"w{2 * i + j + 1}": (F.shiftright(c, 32) if j == 0 else F.col(c).bitwiseAND(0xFFFFFFFF)) for i, c in enumerate(PACKED) for j in (0, 1)}
    rows = kept.join(best, "key").select("key", *[c.alias(n) for n, c in number.items()], "a", "cut.l", "cut.r", "cut.score")
    rows = stored(rows, "scored")
    words_by_number = said.select("number", "lang", "word").unionByName(spark.createDataFrame([(0, "", "")], "number long, lang string, word string"))
    words_by_number, most = picked(words_by_number, rows, "number", *number)
    for c in number:
        rows = attached(rows, words_by_number.select(F.col("number").alias(c), F.col("word").alias(f"{c}_text"), F.col("lang").alias(f"{c}_lang")), c, "key", most)
    phrase = F.concat_ws(" ", *[F.when(F.col(c) != 0, F.col(f"{c}_text")) for c in number])
    rows = rows.select(F.col("w1_lang").alias("lang"), phrase.alias("phrase"), "a", "l", "r", "score")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
