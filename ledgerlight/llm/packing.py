"""Best-fit packing of documents into sequences of at most `capacity` tokens.

Documents become pieces: ids of the tokenizer, then the end id; only documents
longer than the capacity are cut. The histogram of piece lengths, at most
`capacity` numbers, goes to the driver, where a configuration linear program is
solved by multiplicative weights and rounded (packing_plan). The result is a
bounded list of runs; each piece finds its run by its length and its rank among
the pieces of that length. Ranks come from counts by partition, so no task
holds all pieces of a length.

Defined cases: null text counts as empty and gives a piece with the end id
alone; equal rows are packed each on its own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.llm.common import REMEMBERED, as_bytes, small, stored
from ledgerlight.llm.packing_plan import plan

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Lower case of these depends on their place in the word.
SIGMA = frozenset("σς")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = byte_letters()
#: The units into which the tokenizer splits ASCII text in lower case.
UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)


#: What may follow a word without changing its ids.
MARKS = ".,;:!?"
MARKS_BYTES = MARKS.encode()


class WordTokens:
    """Token ids of words, remembered up to a bound of words: a full store becomes the old one, which still answers.

    The tokenizer ignores case, drops white space, and no token reaches over
    white space or from a letter or digit into punctuation, so a text's ids are
    its words' ids one after another. Only strings like <|endoftext|> depend on case.
    """

    LIMIT = 500_000
    _loaded: dict[str, WordTokens] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks: dict[str, list[int]] = {}
        self.clear()
        self.old = self.index, self.starts, self.flat

    @classmethod
    def of(cls, path: str, limit: int | None = None) -> WordTokens:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        REMEMBERED["packing"] = cls._loaded.clear
        cls._loaded[path].LIMIT = limit or cls.LIMIT
        return cls._loaded[path]

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.starts, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint32)  # both grow by doubling

    def tokenized(self, word: bytes) -> list[int]:
        """Of one word. A run of letters is one unit of the tokenizer's: its model alone gives the ids."""
        stem = word.rstrip(MARKS_BYTES)
        if stem.isalpha():  # ASCII letters, and what may follow them
            ids = [t.id for t in self.model.tokenize(stem.decode().lower())]
            return ids if len(stem) == len(word) else ids + self.of_unit(word[len(stem) :].decode())
        text = word.decode("utf-8", "replace")
        stem = text.rstrip(MARKS)
        if stem and len(stem) < len(text) and stem.lower()[-1].isalnum() and "<|" not in text:  # some letters end in a mark in lower case
            return self.of_stem(stem) + self.of_unit(text[len(stem) :])
        return self.of_stem(text)

    def of_unit(self, unit: str) -> list[int]:
        """Of what the tokenizer doesn't split before its model sees it, in ASCII lower case."""
        if unit.isalpha():
            return [t.id for t in self.model.tokenize(unit)]
        if unit not in self.marks:
            if len(self.marks) > self.LIMIT // 10:
                self.marks.clear()
            self.marks[unit] = [t.id for t in self.model.tokenize(unit.translate(BYTE_LETTERS))]
        return self.marks[unit]

    def of_stem(self, text: str) -> list[int]:
        low = text.lower()
        if text.isascii() and "<|" not in text:
            return [*chain.from_iterable(map(self.of_unit, UNITS.findall(low)))]
        if low.isalpha() and not SIGMA & set(low) and is_normalized("NFC", text) and is_normalized("NFC", low):
            return [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def remembered(self, word: bytes) -> list[int]:
        index, starts, flat = self.old
        at = index.get(word)
        return self.tokenized(word) if at is None else flat[starts[at] : starts[at + 1]].tolist()

    def learn(self, words: list[bytes]) -> None:
        """Different words that are not in the store."""
        found = [*map(self.remembered if self.old[0] is not self.index else self.tokenized, words)]
        n, sizes = len(self.index), np.fromiter(map(len, found), np.int64, len(found))
        ends = int(self.starts[n]) + np.cumsum(sizes)
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * len(self.starts))
        while ends[-1] > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[int(self.starts[n]) : ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.starts[n + 1 : n + 1 + len(words)] = ends
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        split = [(text if b"<|" in text else text.lower()).split() if text else [] for text in texts]
        words = [*chain.from_iterable(split)]
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            missed = {words[i] for i in new.tolist()}
            if len(self.index) + len(missed) > self.LIMIT and len(self.index) > self.LIMIT // 2:
                self.old = self.index, self.starts, self.flat
                self.clear()
                missed = set(words)
            self.learn([*missed])
            if len(missed) == len(self.index):
                new = np.arange(len(words))
            at[new] = np.fromiter(map(self.index.__getitem__, map(words.__getitem__, new.tolist())), np.int64, len(new))
        first = self.starts[at]
        n = self.starts[at + 1] - first
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum([len(w) for w in split])
        ends = np.append(ends, 0)[last - 1]  # of each text, unless no word is before its end
        ends[last == 0] = 0
        yield from np.split(ids, ends[:-1])


#: Texts whose words are looked up together: so many, and of so many bytes but for a longer last one.
TOGETHER, TOGETHER_BYTES = 256, 1 << 21


def together(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for hi, text in enumerate(texts, start=1):
        size += len(text or b"")
        if hi - lo == TOGETHER or size >= TOGETHER_BYTES or hi == len(texts):
            yield lo, hi
            lo, size = hi, 0


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, store: int | None = None) -> DataFrame:
    """The pieces of the documents; nth counts the pieces of a length in a partition, from 0. Workers remember about `store` words, twice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tokens = WordTokens.of(path, store)
        for b in small(batches, owner="packing"):
            rows, texts, ids = [], as_bytes(b.column("text")), b.column("doc_id").to_pylist()
            for lo, hi in together(texts):
                for doc, own in zip(ids[lo:hi], tokens.encode(texts[lo:hi]), strict=True):
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start : start + capacity]
                        rows.append((doc, k, start, len(piece), zlib.crc32(piece.tobytes()), part, int(seen[len(piece)])))
                        seen[len(piece)] += 1
            if rows:
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, store: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    table = stored(pieces(docs, path or tokenizer_path(), capacity, end_id, store), "pieces")
    by_part = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(histogram, capacity).arrays())
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = by_part.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = table.join(starts, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = runs.value.T
        key = length * (1 << 48) + first
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(key, b.column("length").to_numpy() * (1 << 48) + rank, side="right") - 1
            ids = sequence[at] + rank - first[at]
            columns = [*b.columns[:-1], pa.array(ids, pa.int64()), pa.array(offset[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
