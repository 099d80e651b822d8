"""Cross-tokenizer alignment of the tokens of two vocabularies over the same bytes.

Both tokenizers give a text's tokens; running sums of their byte lengths are
the end arrays. Byte offsets that both arrays hold cut the tokens into groups.
Diagonal run skipping finds them: at the current index shift, slices of both
arrays are compared in widths that double, so a stretch of one-to-one tokens
costs a logarithm of its length in comparisons; the window that fails is halved
until the stretch's end is known. There an irregular group begins: the array
that is behind moves on until both ends meet, and the shift is updated.

Texts are cut into units before a blank or a line feed that follows no white
space. No token of either vocabulary covers such a place (checked when the
tokenizers are loaded), so a unit's tokens don't depend on what is around it.
Units are tokenized and aligned once and then remembered, up to a bound of
units; new ones are aligned together as one stream. Unbroken runs beyond LONG
characters are also cut where no token of either has both bytes side by side.

A link is a pair of tokens that end together, so the bytes of one are a suffix
of the other's. The vocabularies alone therefore bound the number of different
pairs (some 300,000 here): the table of counts that is broadcast cannot grow
with the corpus. Documents keep their links as pair numbers in the stored table.

Defined cases: null and empty texts, and texts that a tokenizer doesn't give
back byte by byte (such as those with U+2581), have no tokens: zeros and an
empty digest; equal rows count each on its own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import REMEMBERED, small, stored
from ledgerlight.llm.packing import BYTE_LETTERS, tokenizer_path

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a text that are looked up together; of a unit, from which it is cut between bytes that no token joins.
BLOCK, LONG = 1 << 19, 1 << 12
#: Texts whose units are looked up together: so many, of so many characters but for a longer last one.
TOGETHER, TOGETHER_CHARS = 256, 1 << 20
#: Letters before this one have one class in all versions of Unicode that the encoders know.
LATIN = "\u0250"
BLANK, PLACE = "▁", re.compile(r"(?<=\S)(?=[ \n])")
#: What ends a unit's word without changing its tokens, where no piece ends in a letter and it.
MARKS = ".,;:!?"
#: White space but for blanks and line feeds.
ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def run_length(a: Sequence[int], b: Sequence[int], i: int, j: int) -> int:
    """How many entries of a from i on equal those of b from j on: widths double until one fails, which then bounds what is left."""
    n, width, most = 0, 1, min(len(a) - i, len(b) - j)
    while n < most:
        step = min(width, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, width = n + step, 2 * width
        else:
            most, width = n + step - 1, max(1, step // 2)
    return n


def align(a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int]]:
    """For increasing end arrays with the same last entry: indexes into a and into b of the ends that both have."""
    i = j = 0
    at_a: list[int] = []
    at_b: list[int] = []
    while i < len(a):
        n = run_length(a, b, i, j)  # at the shift j - i
        at_a += range(i, i + n)
        at_b += range(j, j + n)
        i, j = i + n, j + n
        if i == len(a):
            break
        x, y = a[i], b[j]
        while x != y:  # an irregular group
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        at_a.append(i)
        at_b.append(j)
        i, j = i + 1, j + 1
    return at_a, at_b


def linkable(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """Sorted codes a * len(second) + b of all pairs of ids of which one's bytes are a suffix of the other's."""
    codes = set()
    for swap, own, others in ((False, first, second), (True, second, first)):
        ids: dict[bytes, list[int]] = {}
        for k, x in enumerate(others):
            if x:
                ids.setdefault(x, []).append(k)
        for k, x in enumerate(own):
            for cut in range(len(x)):
                for other in ids.get(x[cut:], ()):
                    codes.add((other * len(second) + k) if swap else (k * len(second) + other))
    return np.array(sorted(codes), np.int64)


class Rows:
    """Of units: numbers of tokens, groups as text, links (one for each group); bad: a tokenizer changes its bytes."""

    def __init__(self, n_a: Sequence[int], n_b: Sequence[int], bad: Sequence[bool], shown: list[bytes], sizes: Sequence[int], links: Sequence[int]) -> None:
        self.n_a, self.n_b, self.bad = np.asarray(n_a, np.int32), np.asarray(n_b, np.int32), np.asarray(bad, bool)
        self.shown, self.links = shown, np.asarray(links, np.uint32)
        self.starts = np.append(0, np.cumsum(sizes, dtype=np.int64))

    def sizes_and_links(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.starts[at]
        n = self.starts[at + 1] - first
        return n, self.links[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.n_a[at], self.n_b[at], self.bad[at], [self.shown[k] for k in at.tolist()], *self.sizes_and_links(at))

    def then(self, other: Rows) -> Rows:
        """Row by row: the groups of the one before those of the other."""
        n = np.diff(self.starts), np.diff(other.starts)
        links = np.empty(len(self.links) + len(other.links), np.uint32)
        own = np.repeat(other.starts[:-1], n[0]) + np.arange(len(self.links))
        links[own] = self.links
        links[np.repeat(self.starts[1:], n[1]) + np.arange(len(other.links))] = other.links
        return Rows(self.n_a + other.n_a, self.n_b + other.n_b, self.bad | other.bad, [x + b";" + y for x, y in zip(self.shown, other.shown, strict=True)], n[0] + n[1], links)


class Store(Rows):
    """Rows by key; their arrays grow by doubling."""

    def __init__(self) -> None:
        super().__init__([0] * 4096, [0] * 4096, [False] * 4096, [], [0] * 4096, [0] * 4096)
        self.index: dict[str, int] = {}

    def add(self, keys: list[str], rows: Rows) -> None:
        n, new = len(self.index), len(keys)
        while n + new + 1 > len(self.starts):
            self.n_a, self.n_b, self.bad, self.starts = (np.resize(x, 2 * len(self.starts)) for x in (self.n_a, self.n_b, self.bad, self.starts))
        first = int(self.starts[n])
        while first + len(rows.links) > len(self.links):
            self.links = np.resize(self.links, 2 * len(self.links))
        self.n_a[n : n + new], self.n_b[n : n + new], self.bad[n : n + new] = rows.n_a, rows.n_b, rows.bad
        self.starts[n + 1 : n + 1 + new], self.links[first : first + len(rows.links)] = first + rows.starts[1:], rows.links
        self.shown += rows.shown
        self.index.update(zip(keys, range(n, n + new), strict=True))


class Aligner:
    """Units' tokens, groups and links. A store of LIMIT units becomes the old one, which still answers."""

    LIMIT = 350_000
    _loaded: dict[tuple[str, str], Aligner] = {}

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = {c: b for b, c in BYTE_LETTERS.items()}
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(map(letters.get, token)) if set(token) <= letters.keys() else token.encode()
        special = self.a.get_added_tokens_decoder()
        ranks = {x: k for k, x in enumerate(self.bytes_a) if k not in special}
        self.fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        whole = ["" if self.b.is_control(k) or self.b.is_unknown(k) else x.replace(BLANK, " ") for k, x in enumerate(pieces)]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else w.encode() for k, (x, w) in enumerate(zip(pieces, whole, strict=True))]
        if any(" " in w.lstrip(" ") or "\n" in w or (w[-1:] in MARKS and w[-2:-1].isalpha()) for w in whole):
            raise ValueError("a piece reaches over white space or from a letter into a mark: units can't be told apart")
        self.blank = self.b.piece_to_id(BLANK)
        self.sizes_a, self.sizes_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.pairs = linkable(self.bytes_a, self.bytes_b)
        self.joined = np.zeros((256, 256), bool)
        for x in chain(self.bytes_a, self.bytes_b):
            codes = np.frombuffer(x, np.uint8)
            self.joined[codes[:-1], codes[1:]] = True
        self.store = self.old = Store()
        self.marks = self.rows(["\n" + m for m in MARKS], 1)

    @classmethod
    def of(cls, first: str, second: str) -> Aligner:
        if (first, second) not in cls._loaded:
            cls._loaded[first, second] = cls(first, second)
        REMEMBERED["token_alignment"] = cls._loaded.clear
        return cls._loaded[first, second]

    def safe_parts(self, unit: str) -> list[str]:
        """A long unit, cut where neither vocabulary has both bytes side by side in a token (nor an apostrophe begins a part)."""
        raw = unit.encode()
        codes = np.frombuffer(raw, np.uint8)
        left, right = codes[:-1], codes[1:]
        may = ~self.joined[left, right] & (left > 0x20) & (right > 0x20) & (right != 0x27) & (right < 0x80) & (left < 0x80)
        cuts = [0, *(np.flatnonzero(may) + 1).tolist(), len(raw)]
        return [raw[x:y].decode() for x, y in zip(cuts, cuts[1:], strict=False)]

    def tokens_of(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers for each unit, which begins with a blank or a line feed."""
        long = [k for k, u in enumerate(units) if len(u) >= LONG]
        parts = {k: self.safe_parts(units[k]) for k in long}
        flat = [*chain.from_iterable(parts.get(k) or [u] for k, u in enumerate(units))] if long else units
        a = self.first_ids(flat)
        # the model puts a blank before every text: it stands for that of the unit, or goes
        b = self.b.encode([x[1:] if x[0] == " " else x for x in flat], num_threads=1)
        b = [ids if x[0] == " " and ids else self.unblanked(ids, x) for ids, x in zip(b, flat, strict=True)]
        if long:
            a, b = iter(a), iter(b)
            a, b = ([[*chain.from_iterable(next(it) for _ in parts.get(k) or [u])] for k, u in enumerate(units)] for it in (a, b))
        return a, b

    def first_ids(self, units: list[str]) -> list[list[int]]:
        """Of the first tokenizer. Latin units go to an equal but faster encoder, joined to one text, which its tokens tell apart again."""
        latin = [(u.isascii() or max(u) < LATIN) and not u[-1].isspace() for u in units]
        joined = [u for u, own in zip(units, latin, strict=True) if own]
        ids = self.fast.encode_ordinary("".join(joined))
        ends = np.cumsum([len(u.encode()) for u in joined], dtype=np.int64)
        cuts = [0, *np.searchsorted(np.cumsum(self.sizes_a[np.array(ids, np.int64)]), ends, side="right").tolist()]
        fast = iter([ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)])
        slow = iter([e.ids for e in self.a.encode_batch([u for u, own in zip(units, latin, strict=True) if not own], add_special_tokens=False)])
        return [next(fast if own else slow) for own in latin]

    def unblanked(self, ids: list[int], part: str) -> list[int]:
        """The ids without the blank that the model has put before the part: a token of its own, or else the part goes behind a line feed."""
        if not ids:  # of a unit that is one blank
            return [self.blank]
        return ids[1:] if ids[0] == self.blank else self.b.encode("\n" + part)[2:]

    def rows(self, units: list[str], skip: int = 0) -> Rows:
        """Tokens of the units, aligned as one stream; skip: groups that each unit begins with and that don't count."""
        a, b = self.tokens_of(units)
        bad = [False] * len(units)
        flat_a, flat_b = [*chain.from_iterable(a)], [*chain.from_iterable(b)]
        text = "".join(units).encode()
        if b"".join(map(self.bytes_a.__getitem__, flat_a)) != text or b"".join(map(self.bytes_b.__getitem__, flat_b)) != text:
            bad = [any(b"".join(map(own.__getitem__, x)) != u.encode() for own, x in ((self.bytes_a, x), (self.bytes_b, y))) for u, x, y in zip(units, a, b, strict=True)]
            a, b = ([[] if wrong else x for wrong, x in zip(bad, side, strict=True)] for side in (a, b))
            flat_a, flat_b = [*chain.from_iterable(a)], [*chain.from_iterable(b)]
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        at_a, at_b = align(np.cumsum(self.sizes_a[ids_a]).tolist(), np.cumsum(self.sizes_b[ids_b]).tolist())
        links = np.searchsorted(self.pairs, ids_a[at_a] * len(self.bytes_b) + ids_b[at_b]) if at_a else []
        say_a, say_b = [*map(str, flat_a)], [*map(str, flat_b)]
        groups, i, j = [], 0, 0
        for x, y in zip(at_a, at_b, strict=True):
            groups.append(say_a[x] + "|" + say_b[y] if i == x and j == y else ",".join(say_a[i : x + 1]) + "|" + ",".join(say_b[j : y + 1]))
            i, j = x + 1, y + 1
        n_a, n_b = np.array([*map(len, a)], np.int64), np.array([*map(len, b)], np.int64)
        last = np.searchsorted(np.array(at_a, np.int64), np.cumsum(n_a))  # groups that end before each unit's end
        spans = [*zip([skip, *(last[:-1] + skip).tolist()], last.tolist(), strict=True)]
        if skip:
            links = np.concatenate([links[lo:hi] for lo, hi in spans])
        return Rows(n_a - skip, n_b - skip, bad, [";".join(groups[lo:hi]).encode() for lo, hi in spans], [hi - lo for lo, hi in spans], links)

    def learn(self, keys: list[str]) -> None:
        """Different keys that are not in the store. A word before a mark is a unit of its own, as no token reaches into the mark."""
        if self.old is not self.store and (known := [k for k in keys if k in self.old.index]):
            self.store.add(known, self.old.take(np.fromiter(map(self.old.index.__getitem__, known), np.int64, len(known))))
            keys = [k for k in keys if k not in self.old.index]
        marked = [k for k in keys if k[-1] in MARKS and k[:-1].isalpha() and (k.isascii() or max(k) < LATIN)]
        plain = {*keys}.difference(marked) if marked else {*keys}
        plain.update(k for k in (m[:-1] for m in marked) if k not in self.store.index)
        if plain:
            plain = [*plain]
            self.store.add(plain, self.rows([k if k[0] in " \n" else " " + k for k in plain]))
        if marked:
            stems = self.store.take(np.fromiter((self.store.index[k[:-1]] for k in marked), np.int64, len(marked)))
            self.store.add(marked, stems.then(self.marks.take(np.fromiter((MARKS.index(k[-1]) for k in marked), np.int64, len(marked)))))

    def keys(self, block: str) -> list[str]:
        """Units of a block, which begins with a blank or a line feed; those that begin with one blank alone come without it."""
        if not any(c in block for c in ODD):
            parts = block.replace("\n", " \n")[1:].split(" ")
            if "" not in parts and "\n" not in parts:
                return parts
        return [u if u[0] == "\n" or u[1:2].isspace() or len(u) == 1 else u[1:] for u in PLACE.split(block)]

    def blocks(self, texts: list[str]) -> list[tuple[int, int, int, np.ndarray, bytes, bool]]:
        """For each block: numbers of tokens and groups, links, groups as text, whether bytes differ."""
        split = [*map(self.keys, texts)]
        keys = [*chain.from_iterable(split)]
        at = np.fromiter(map(self.store.index.get, keys, repeat(-1)), np.int64, len(keys))
        if len(new := np.flatnonzero(at < 0)):
            missed = {keys[k] for k in new.tolist()}
            if len(self.store.index) + len(missed) > self.LIMIT and len(self.store.index) > self.LIMIT // 2:
                self.old, self.store = self.store, Store()
                missed, new = set(keys), np.arange(len(keys))
            self.learn([*missed])
            at[new] = np.fromiter(map(self.store.index.__getitem__, map(keys.__getitem__, new.tolist())), np.int64, len(new))
        n, links = self.store.sizes_and_links(at)
        ends = np.cumsum(n)
        shown, out, lo, done = [*map(self.store.shown.__getitem__, at.tolist())], [], 0, 0
        for own in split:
            hi = lo + len(own)
            k, end = at[lo:hi], int(ends[hi - 1])
            out.append((int(self.store.n_a[k].sum()), int(self.store.n_b[k].sum()), end - done, links[done:end], b";".join(shown[lo:hi]), bool(self.store.bad[k].any())))
            lo, done = hi, end
        return out


def cut(text: str) -> Iterator[str]:
    """Blocks of a text and the blank before it, each of whole units; without places to cut, of any length."""
    lo, text = 0, " " + text
    while len(text) - lo > BLOCK:
        if not (m := PLACE.search(text, lo + BLOCK)):
            break
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:] if lo else text


TABLE = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, uses binary, counts boolean"
COLUMNS = [x.split()[0] for x in TABLE.split(", ")]
TYPES = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.bool_()]


def aligned(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its links; last, a row (counts) with the pairs of the partition and how often each came."""
    tool = Aligner.of(first, second)
    uses = np.zeros(len(tool.pairs), np.int64)
    for batch in small(batches, owner="token_alignment"):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        lo = chars = 0
        for hi in range(1, len(texts) + 1):
            chars += len(texts[hi - 1] or "")
            if hi - lo < TOGETHER and chars < TOGETHER_CHARS and hi < len(texts):
                continue
            found = [*documents(tool, texts[lo:hi])]
            uses += np.bincount(np.concatenate([x[-1] for x in found]), minlength=len(uses))
            rows = [(doc, *x[:4], x[4].tobytes(), None, False) for doc, x in zip(ids[lo:hi], found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], COLUMNS)
            lo, chars = hi, 0
    seen = np.flatnonzero(uses)
    row = (None, 0, 0, 0, "", seen.astype(np.uint32).tobytes(), uses[seen].tobytes(), True)
    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, TYPES, strict=True)], COLUMNS)


def documents(tool: Aligner, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
    """n_a, n_b, n_groups, digest and links of each text."""
    none = (0, 0, 0, "", np.zeros(0, np.uint32))
    pending: list[str] = []
    for text in texts:
        if text and len(text) <= BLOCK:
            pending.append(" " + text)
    done = iter(tool.blocks(pending)) if pending else iter(())
    for text in texts:
        if not text:
            yield none
            continue
        total, digest, links, bad = np.zeros(3, np.int64), hashlib.sha256(), [], False
        parts = [next(done)] if len(text) <= BLOCK else (tool.blocks([b])[0] for b in cut(text))
        for k, (n_a, n_b, n, own, shown, wrong) in enumerate(parts):
            bad |= wrong
            total += (n_a, n_b, n)
            digest.update(b";" + shown if k else shown)
            links.append(own)
        yield none if bad else (*total.tolist(), digest.hexdigest(), links[0] if len(links) == 1 else np.concatenate(links))


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, n: how many links of the stored table hold each pair."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, uses in zip(batch.column("links").to_pylist(), batch.column("uses").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(pairs, np.uint32), pa.int64()), pa.array(np.frombuffer(uses, np.int64))], ["pair", "n"])

    return table.where("counts").select("links", "uses").mapInArrow(read, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokens(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of docs."""
    first, second = first or tokenizer_path(FIRST), second or tokenizer_path(SECOND)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = stored(texts.mapInArrow(lambda batches: aligned(batches, first, second), TABLE), "aligned")
    tool = Aligner.of(first, second)
    counts = np.zeros(len(tool.pairs), np.int64)
    for batch in pair_counts(table).toArrow().to_batches():  # at most as many rows as the vocabularies have linkable pairs
        counts[batch.column("pair").to_numpy()] = batch.column("n").to_numpy()
    to = tool.pairs % len(tool.bytes_b)
    highest = np.zeros(len(tool.bytes_b), np.int64)
    np.maximum.at(highest, to, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[to]))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = shared.value
        for b in batches:
            links = [np.frombuffer(x, np.uint32) for x in b.column("links").to_pylist()]
            found = [pa.array([f(x) for x in links], pa.int64()) for f in (len, lambda x: int(best[x].sum()), lambda x: int(n[x].sum()))]
            columns = [*(b.column(c) for c in COLUMNS[:4]), *found, b.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, [*COLUMNS[:4], "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = table.where("not counts").select(*COLUMNS[:4], "groups_sha256", "links")
    return rows.mapInArrow(judged, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
