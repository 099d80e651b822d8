"""Online logistic context mixing over the bits of bytes.

A document is the bytes of its words, joined by one space, and an end. Each byte
is one of LEAVES symbols, the most frequent bytes or an escape (then a fixed
price for the byte), and a symbol is the bits of its Huffman code. So all bits
of all bytes are predicted, but frequent bytes have few.

Each bit is predicted by INPUTS bit predictors, whose contexts are hashes of the
three symbols before, of the letters of the word so far (the last NEAR of them),
and of these with the first HEAD letters of the word before (in longer words, one
letter more instead). A predictor's logit
comes from how often its context went on with a 0 and with a 1 in the training
documents. The logits are mixed by weights. A gate, by how often the two
contexts of words were seen, chooses among GATES sets of weights; they start at
a prior and are refined, document by document, after each block of bytes by the
gradient of what the bits cost, over the curvature seen so far. All costs add up
to the bits of the document; nothing is paid outside the mixer but escaped bytes.

A context's row of symbol counts has LEAVES numbers. Tables grow with the
training text (table_bits), without a bound. A model may hold only the rows that
its documents meet; it then finds them by their numbers (Rows).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from ledgerlight.llm.common import Powers, mix

END = b""
SPACE, NEWLINE = 0x20, 0x0A
LEAF_BITS = 6
LEAVES = 1 << LEAF_BITS
ESCAPE = LEAVES - 1
INPUTS, LEVELS = 3, 4
GATES = LEVELS * LEVELS
LEAST_BITS = 10
#: Of the index of a model that holds some rows only.
INDEX_BITS = 22
#: Bytes of a document after which its weights are first refined; blocks later grow by a share of what was seen.
BLOCK, GROWTH, MOST_BLOCK = 128, 2, 1 << 12
#: Letters of the word so far, and of the word before, that contexts hold; beyond NEAR letters, the last ones.
NEAR, HEAD = 4, 3
STRETCH = 1024.0
SCATTER = np.uint64(0xD6E8FEB86659FD93)
CURVATURE, LIMIT = 25.0, 22.0
#: A context's level: how often it was seen, at least.
SEEN = (2, 16, 256)
#: Prior weights of the predictors without words; those of the others by their level.
PRIOR_PLAIN, PRIOR_WORD, PRIOR_PAIR = (0.55,), (0.1, 0.35, 0.45, 0.45), (0.0, 0.25, 0.45, 0.6)


def table_bits(train_bytes: int) -> int:
    """Rows of the largest table, as a power of two: one for 64 to 128 bytes of training text, LEAST_BITS at least."""
    return max(LEAST_BITS, int(train_bytes).bit_length() - 7)


class Code:
    """Symbols of bytes and their Huffman code, from how often each byte was seen."""

    def __init__(self, seen: np.ndarray) -> None:
        order = np.lexsort((np.arange(256), -seen))
        self.symbol = np.full(256, ESCAPE, np.uint8)
        self.symbol[order[:ESCAPE]] = np.arange(ESCAPE)
        rest = np.sort(order[ESCAPE:])
        # an escaped byte costs its share among the escaped ones, each counted once more
        self.escaped = np.zeros(256)
        self.escaped[rest] = -np.log2((seen[rest] + 1) / (seen[rest] + 1).sum())
        weight = np.append(seen[order[:ESCAPE]], seen[rest].sum()).astype(np.int64) + 1
        heap = [(int(w), i, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        self.left, self.right = np.zeros((2, LEAVES, LEAVES - 1), np.float32)  # which leaves lie below each inner node, by side
        below, node = {i: [i] for i in range(LEAVES)}, 0
        paths: list[list[tuple[int, int]]] = [[] for _ in range(LEAVES)]
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for side, child, bit in ((self.left, x, 0), (self.right, y, 1)):
                side[below[child], node] = 1
                for leaf in below[child]:
                    paths[leaf].append((node, bit))
            below[LEAVES + node] = below.pop(x) + below.pop(y)
            heapq.heappush(heap, (a + b, LEAVES + node, LEAVES + node))
            node += 1
        self.size = np.array([len(p) for p in paths])
        self.start = np.cumsum(self.size) - self.size
        self.node = np.array([n for p in paths for n, _ in p[::-1]], np.int64)
        self.sign = np.array([2 * b - 1 for p in paths for _, b in p[::-1]], np.float32)

    def packed(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of symbol counts: each node's logit (STRETCH to one), with room for LEAVES, and the row's level."""
        c = counts.astype(np.float32)
        logit = np.log((c @ self.right + np.float32(0.4)) / (c @ self.left + np.float32(0.4)))
        out = np.zeros(counts.shape, np.int16)
        out[:, :-1] = np.clip(np.rint(STRETCH * logit), -32767, 32767)
        return out, np.searchsorted(SEEN, counts.sum(axis=1), side="right").astype(np.uint8)


@dataclass
class Stream:
    """Documents one after another: symbols, row of each predictor's context, and where the documents begin and end."""

    symbols: np.ndarray
    rows: list[np.ndarray]
    starts: np.ndarray
    sizes: np.ndarray
    raw: np.ndarray


_powers = Powers()


def stream_of(code: Code, documents: list[list[bytes]], bits: int) -> Stream:
    texts = [b" ".join(words) + b"\n" for words in documents]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    n = len(raw)
    symbols = code.symbol[raw]
    third = np.zeros(n, np.uint64)
    for k in (1, 2, 3):
        s = np.empty(n, np.uint64)
        s[:k], s[k:] = code.symbol[NEWLINE], symbols[:-k] if k < n else symbols[:0]
        for j in range(k):  # documents begin as after ends
            s[starts[sizes > j] + j] = code.symbol[NEWLINE]
        third = third << np.uint64(LEAF_BITS) | s
    # words: the polynomial hash of a word's bytes so far, from sums over all bytes before
    _powers.reach(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers.up[:n], out=sums[1:])
    begins = np.zeros(n, bool)
    begins[starts] = True
    begins[1:] |= raw[:-1] == SPACE
    first = np.flatnonzero(begins)
    lengths = np.diff(np.append(first, n))
    heads = (sums[first + np.minimum(lengths - 1, HEAD)] - sums[first]) * _powers.down[first]  # without the space or the end
    last = np.concatenate([[np.uint64(0)], heads[:-1]]).astype(np.uint64)
    last[np.isin(first, starts, assume_unique=True)] = 0
    at, here = np.repeat(first, lengths), np.arange(n)
    letters = here - at
    prefix = (sums[:-1] - sums[at]) * _powers.down[at]

    def tail(k: int) -> np.ndarray:
        """The hash of the k bytes before, where the word has as many."""
        out = np.zeros(n, np.uint64)
        if n > k:
            out[k:] = (sums[k:-1] - sums[: n - k]) * _powers.down[: n - k]
        return out

    long = tail(NEAR + 1)
    long[letters == NEAR] = prefix[letters == NEAR]  # the letters end there
    hashed = (third, np.where(letters <= NEAR, prefix + np.uint64(1), tail(NEAR)), np.where(letters < NEAR, prefix + np.repeat(mix(last), lengths), long))
    rows = []
    for x, b in zip(hashed, hash_bits(bits), strict=True):
        if x is third and b == 3 * LEAF_BITS:  # each context has a row of its own
            rows.append(x.view(np.int64))
            continue
        x ^= x >> np.uint64(29)
        x *= SCATTER
        x >>= np.uint64(64 - b)
        rows.append(x.view(np.int64))
    return Stream(symbols, rows, starts, sizes, raw)


def hash_bits(bits: int) -> tuple[int, int, int]:
    """Rows of the hashed tables, as powers of two: three bytes (at last as many as there are contexts), letters of a word, letters of two words."""
    return max(min(bits, 14), min(bits - 4, 3 * LEAF_BITS)), bits - 1, bits


def table_rows(bits: int) -> tuple[int, ...]:
    return tuple(1 << b for b in hash_bits(bits))


def new_counts(bits: int) -> list[np.ndarray]:
    return [np.zeros((n, LEAVES), np.uint32) for n in table_rows(bits)]


def add_counts(tables: list[np.ndarray], code: Code, documents: list[list[bytes]], bits: int) -> None:
    s = stream_of(code, documents, bits)
    for table, rows in zip(tables, s.rows, strict=True):
        np.add.at(table.reshape(-1), (rows << LEAF_BITS) + s.symbols, np.uint32(1))


def sparse_sum(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sums of their numbers."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(np.concatenate(n)[order], first) if len(first) else np.zeros(0, np.int64)


def sparse_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers whose last bit tells if they count: the different others before it, sorted, and how many of each count."""
    key = np.sort(keys)
    pair = key >> 1
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), pair[1:] != pair[:-1]]))
    return pair[first], np.add.reduceat(key & 1, first) if len(first) else np.zeros(0, np.int64)


def occurrences(code: Code, documents: list[list[bytes]], counted: np.ndarray, bits: int) -> list[np.ndarray]:
    """Of each predictor and byte: the row, the symbol, and in the last bit if its document counts."""
    s = stream_of(code, documents, bits)
    last = s.symbols.astype(np.int64) << 1 | np.repeat(counted, s.sizes)
    return [rows << LEAF_BITS + 1 | last for rows in s.rows]


class Rows:
    """Where rows are among some rows, which are sorted by their last INDEX_BITS bits."""

    def __init__(self, some: np.ndarray, bits: int) -> None:
        self.some, self.mask = some, (1 << min(bits, INDEX_BITS)) - 1
        self.first = np.zeros(self.mask + 1, np.int32)
        slots = some & self.mask
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(some)), bool), slots[1:] != slots[:-1]]))
        self.first[slots[begins]] = begins

    def find(self, rows: np.ndarray) -> np.ndarray:
        """All of them must be there."""
        at = self.first.take(rows & self.mask).astype(np.int64)
        while len(off := np.flatnonzero(self.some.take(at) != rows)):
            at[off] += 1
        return at


def prior_weights() -> np.ndarray:
    """INPUTS x GATES; a gate is the pair's level times LEVELS plus the word's."""
    out = np.zeros((INPUTS, GATES), np.float32)
    for gate in range(GATES):
        pair, word = PRIOR_PAIR[gate // LEVELS], PRIOR_WORD[gate % LEVELS]
        rest = max(0.3, 1.15 - pair - word) / sum(PRIOR_PLAIN)
        out[:, gate] = [*(rest * x for x in PRIOR_PLAIN), word, pair]
    return out


@dataclass
class Model:
    code: Code
    bits: int
    logits: list[np.ndarray]  # of Code.packed, flat
    levels: list[np.ndarray]
    places: list[Rows] | None = None  # of the rows that it holds; none: of all, by their numbers

    @classmethod
    def of(cls, code: Code, bits: int, counts: list[np.ndarray]) -> Model:
        both = [code.packed(c) for c in counts]
        return cls(code, bits, [x.reshape(-1) for x, _ in both], [y for _, y in both])

    def score(self, documents: list[list[bytes]]) -> np.ndarray:
        """Bits of each document; no document bears on another's."""
        n = len(documents)
        if not n:
            return np.zeros(0)
        s, code = stream_of(self.code, documents, self.bits), self.code
        if self.places:
            s.rows = [p.find(rows) for p, rows in zip(self.places, s.rows, strict=True)]
        out = np.bincount(np.repeat(np.arange(n), s.sizes), code.escaped[s.raw], minlength=n)
        gate = (self.levels[2][s.rows[2]] * LEVELS + self.levels[1][s.rows[1]]).astype(np.int64)
        weights = np.tile(prior_weights(), (1, n))  # INPUTS x (document, gate)
        seen = np.full(n * GATES, CURVATURE, np.float32)
        longest, unit = np.argsort(-s.sizes, kind="stable"), np.float32(1 / STRETCH)
        lo, hi = 0, BLOCK
        while len(live := longest[: np.count_nonzero(s.sizes > lo)]):
            take = np.minimum(s.sizes[live], hi) - lo
            ends = np.cumsum(take)
            at = np.repeat(s.starts[live] + lo - ends + take, take) + np.arange(ends[-1])
            key = np.repeat(live * GATES, take) + gate[at]
            order = np.argsort(key.astype(np.int16) if n * GATES < 1 << 15 else key, kind="stable")
            at, key = at[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            groups = key[first]
            # from bytes to the bits of their codes
            symbols = s.symbols[at]
            size = code.size[symbols]
            ends = np.cumsum(size)
            owner = np.repeat(np.arange(len(size)), size)
            path = (code.start[symbols] - ends + size)[owner] + np.arange(ends[-1])
            node, sign = code.node[path], code.sign[path]
            first = (ends - size)[first]
            times = np.diff(np.append(first, ends[-1]))
            now = weights[:, groups] * unit
            x, dot, power = [], None, None
            for k in range(INPUTS):
                index = (s.rows[k][at] << LEAF_BITS)[owner]
                index += node
                v = self.logits[k][index].astype(np.float32)
                w = np.repeat(now[k], times)
                w *= v
                dot = w if k == 0 else np.add(dot, w, out=dot)
                square = v * v
                power = square if k == 0 else np.add(power, square, out=power)
                x.append(v)
            dot *= sign
            np.clip(dot, -LIMIT, LIMIT, out=dot)
            np.negative(dot, out=dot)
            e = np.exp(dot, out=dot)
            q = e + np.float32(1)
            e /= q  # how improbable the bit was
            np.add.at(out, groups // GATES, np.add.reduceat(np.log(q, out=q), first) / np.log(2))
            power *= e
            power *= np.subtract(np.float32(1), e, out=q)
            seen[groups] += np.add.reduceat(power, first) * (unit * unit)
            e *= sign
            for k in range(INPUTS):
                weights[k, groups] += np.add.reduceat(np.multiply(x[k], e, out=x[k]), first) * unit / seen[groups]
            lo, hi = hi, hi + min(MOST_BLOCK, max(BLOCK, hi // GROWTH))
        return out
