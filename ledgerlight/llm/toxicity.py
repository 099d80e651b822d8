"""Toxicity scores: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases.

Folding lower-cases, replaces homoglyphs, reads digits and signs inside words as
the letters they stand for (1, l and i are one letter), and leaves one blank
where there are no letters. Entries are words and beginnings of words, learnt
from labelled rows: what enough different toxic documents have, in several
different contexts (copies of one text give one), and clearly fewer others. An
entry weighs the logarithm of the ratio of both shares of documents. A word
counts by its longest entry. Exception phrases are a hit's word, or this word
with a neighbour, where labelled rows show that it is as common in others as in
toxic ones; hits inside them count nothing. The sum of weights and its ratio to
the number of words go through a logistic curve, fitted to a table of counts.

Entries must be in SHARE of the toxic documents at least. As a document has so
many words, their number is bounded by words a document over SHARE, whatever the
corpus; only entries and the table of counts reach the driver.

Defined cases: null text is empty; texts without a word get the lowest score;
without toxic or other labelled rows all scores are 0; of labels that differ for
one doc_id the toxic one holds; null labels teach nothing; repeated rows are
scored each on its own and learnt from once for each doc_id and text; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import BROADCAST_IDS, small, stored

#: Letters of a word's beginning that may be an entry.
SHORTEST, LONGEST = 3, 8
#: An entry is in so large a share of the toxic documents, in so many of them, in so many contexts, and has this weight.
SHARE, DOCUMENTS, CONTEXTS, WEIGHT = 0.002, 3, 3, 1.5
#: The table of counts: steps of summed weights, and how many.
STEP, STEPS, SIZES = 0.5, 400, 40
PREDICTED = 0.7
#: Letters that look like others, and what signs inside words stand for.
LETTERS_ALIKE = "аa вb еe ёe зe иn іi їi јj кk мm нh оo рp сc тt уy хx ѕs ԁd ԛq ԝw αa βb εe ιi κk νv οo ρp τt υu χx"
SIGNS_ALIKE = "0o 1i 3e 4a 5s 7t 8b 9g @a $s !i |i"
HOMOGLYPHS, SIGNS = ({ord(pair[0]): pair[1] for pair in alike.split()} for alike in (LETTERS_ALIKE, SIGNS_ALIKE))
LOOKALIKE = re.compile(f"[{''.join(map(chr, HOMOGLYPHS))}]")
INSIDE = re.compile(r"(?<=[^\W\d_])[0-9@$!|]+(?=[^\W\d_])|(?<!\S)[0-9@$!|](?=[^\W\d_])")
SIGNED, BLANKS = re.compile(r"[0-9@$!|]"), re.compile(rb"  +")
#: ASCII letters in lower case with l read as i, blanks for other ASCII, and other bytes as they are.
LETTERS = bytes((c | 32 if chr(c).lower() != "l" else ord("i")) if chr(c).isalpha() else 32 for c in range(128)) + bytes(range(128, 256))


def fold(text: str | None) -> str:
    """Words of letters, each between blanks."""
    if not text:
        return " "
    low = text.lower()
    if not low.isascii() and LOOKALIKE.search(low):
        low = low.translate(HOMOGLYPHS)
    if SIGNED.search(low):
        low = INSIDE.sub(lambda m: m[0].translate(SIGNS), low)
    return BLANKS.sub(b" ", b" " + low.encode("utf-8", "replace").translate(LETTERS) + b" ").decode()


def entries(word: str) -> list[str]:
    """What a word may be known by, after the blank before it: beginnings, and the word with the blank behind it."""
    return [f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)] + [f" {word} "]


class Remembered(dict):
    """entries of words, of those that are `known` if that is given; up to a bound of words."""

    LIMIT = 100_000

    def __init__(self, known: set[str] | None = None) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = out = [e for e in entries(word) if self.known is None or e in self.known]
        return out


def counted(batches: Iterator[pa.RecordBatch], known: set[str] | None) -> Iterator[pa.RecordBatch]:
    """entry, n (documents that have it), contexts (a bit for each class of words before it); of rows with folded text."""
    names, found = Remembered(known), {}

    def flush() -> pa.RecordBatch:
        arrays = [pa.array([*found], pa.string()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["entry", "n", "contexts"])

    for batch in small(batches):
        for text in batch.column("folded").to_pylist():
            own: dict[str, int] = {}
            before = ""
            words = text.split()
            for word in words if known is None else set(words):
                bit = 1 << (xxhash.xxh3_64_intdigest(before) % 62) if known is None else 0
                for e in names[word]:
                    own[e] = own.get(e, 0) | bit
                before = word
            for e, bits in own.items():
                n, seen = found.get(e, (0, 0))
                found[e] = n + 1, seen | bits
            if len(found) > 1_000_000:
                yield flush()
                found.clear()
    yield flush()


@dataclass
class ToxicityModel:
    """Weights of entries, exception phrases (with their blanks), coefficients of the curve."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = ()
    _matcher: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> tuple:
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.exceptions, self.curve = state
        self._matcher = None

    def matcher(self):
        if self._matcher is None:
            import ahocorasick

            self._matcher = ahocorasick.Automaton()
            for e, weight in self.weights.items():
                self._matcher.add_word(e, (len(e), weight))
            for e in self.exceptions:  # a word that is an entry and an exception is an exception
                self._matcher.add_word(e, (len(e), None))
            self._matcher.make_automaton()
        return self._matcher

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """Where words begin that count (the blank before them), and their weights."""
        longest: dict[int, tuple[int, float]] = {}
        excepted: list[tuple[int, int]] = []
        for end, (size, weight) in self.matcher().iter(folded) if self.weights else ():
            start = end - size + 1
            if weight is None:
                excepted.append((start, end))
            elif size > longest.get(start, (0, 0.0))[0]:
                longest[start] = size, weight
        covered = {k for a, b in excepted for k in longest if a <= k < b} if excepted and longest else ()
        return [(k, w) for k, (_, w) in longest.items() if k not in covered]

    def measured(self, folded: str) -> tuple[float, int]:
        """Summed weights and number of words."""
        return sum(w for _, w in self.hits(folded)), max(0, folded.count(" ") - 1)

    def score(self, folded: str) -> float:
        if not self.curve:
            return 0.0
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, float(np.dot(shaped(*self.measured(folded)), self.curve))))))


def shaped(weight: float, words: int) -> tuple[float, float, float]:
    """What the curve sees."""
    return 1.0, math.log1p(weight), math.log1p(100 * weight / (words + 10))


def phrases(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    """phrase, toxic, n: how many documents have a hit in it; the hit's word, and with each neighbour."""
    for batch in small(batches):
        found: dict[tuple[str, int], int] = {}
        for text, toxic in zip(batch.column("folded").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = set()
            for start, _ in model.hits(text):
                end = text.index(" ", start + 1)
                own.add(text[start : end + 1])
                if start:
                    own.add(text[text.rindex(" ", 0, start) : end + 1])
                if end + 1 < len(text):
                    own.add(text[start : text.index(" ", end + 1) + 1])
            for p in own:
                found[p, toxic] = found.get((p, toxic), 0) + 1
        arrays = [pa.array([p for p, _ in found], pa.string()), pa.array([t for _, t in found], pa.int32()), pa.array([*found.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["phrase", "toxic", "n"])


def table_of(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    """step, size, toxic, n: documents by classes of summed weights and of words."""
    counts = np.zeros((STEPS, SIZES, 2), np.int64)
    for batch in small(batches):
        for text, toxic in zip(batch.column("folded").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            weight, words = model.measured(text)
            counts[min(STEPS - 1, math.ceil(weight / STEP)), min(SIZES - 1, int(2 * math.log2(words + 1))), toxic] += 1
    at = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in at), pa.array(counts[at], pa.int64())], ["step", "size", "toxic", "n"])


def fitted_curve(step: np.ndarray, size: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps over the table of counts, with a small penalty, as classes may be separable."""
    x = np.array([shaped(s * STEP, 2 ** ((z + 0.5) / 2)) for s, z in zip(step, size, strict=True)])
    beta, penalty = np.zeros(x.shape[1]), np.diag([0.0, 0.05, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (toxic - p)) - penalty @ beta
        change = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta)), gradient)
        beta += change * min(1.0, 4 / max(1e-12, float(np.abs(change).max())))
        if np.abs(change).max() < 1e-8:
            break
    return tuple(beta.tolist())


def labelled(docs: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """folded, toxic of the training rows, stored. Labels are broadcast only after their number was checked."""
    toxic = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    few = toxic.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.where(training).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(toxic) if few else toxic, "doc_id")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = pa.array([*map(fold, b.column("text").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, b.column("toxic")], ["doc_id", "folded", "toxic"])

    return stored(rows.mapInArrow(folded, "doc_id long, folded string, toxic int"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, training: Column) -> ToxicityModel:
    """docs: doc_id, text and what the condition needs; labels: doc_id, toxic."""
    spark = docs.sparkSession
    rows = labelled(docs, labels, training)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return ToxicityModel({})
    schema = "entry string, n long, contexts long"
    least = max(DOCUMENTS, math.ceil(SHARE * toxic))
    often = rows.where("toxic = 1").select("folded").mapInArrow(lambda batches: counted(batches, None), schema)
    often = often.groupBy("entry").agg(F.sum("n").alias("n"), F.bit_count(F.expr("bit_or(contexts)")).alias("contexts"))
    often = {r["entry"]: r["n"] for r in often.where((F.col("n") >= least) & (F.col("contexts") >= CONTEXTS)).select("entry", "n").collect()}
    known = spark.sparkContext.broadcast(set(often))
    others = rows.where("toxic = 0").select("folded").mapInArrow(lambda batches: counted(batches, known.value), schema)
    others = {r["entry"]: r["n"] for r in others.groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    weights = {e: math.log((n + 0.5) / (toxic + 1)) - math.log((others.get(e, 0) + 0.5) / (other + 1)) for e, n in often.items()}
    model = ToxicityModel({e: w for e, w in sorted(weights.items()) if w >= WEIGHT})

    first = spark.sparkContext.broadcast(model)
    said = rows.select("folded", "toxic").mapInArrow(lambda batches: phrases(batches, first.value), "phrase string, toxic int, n long")
    said = said.groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("o"))
    harmless = (F.col("o") >= max(DOCUMENTS, math.ceil(SHARE * other / 4))) & (F.col("o") * toxic >= F.col("t") * other)
    model = ToxicityModel(model.weights, frozenset(r["phrase"] for r in said.where(harmless).select("phrase").collect()))

    second = spark.sparkContext.broadcast(model)
    table = rows.select("folded", "toxic").mapInArrow(lambda batches: table_of(batches, second.value), "step long, size long, toxic long, n long")
    table = table.groupBy("step", "size", "toxic").agg(F.sum("n").alias("n")).collect()
    return ToxicityModel(model.weights, model.exceptions, fitted_curve(*np.array([tuple(r) for r in sorted(table)], float).T))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted: one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            scores = [shared.value.score(fold(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= PREDICTED) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(apply, "doc_id long, score double, predicted int")
