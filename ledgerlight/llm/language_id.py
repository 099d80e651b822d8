"""Language identification by nearest centroid.

Features are byte n-grams (2, 3 and 4 bytes) of the whole text, of whose ASCII
only letters count: they are lower-cased, and what lies between words becomes
one blank. They are hashed to DIMS cells; a cell weighs log(1 + tf) * idf and
the vector has length 1. The document frequencies count all training rows. Each
language gets CENTROIDS centroids by spherical k-means over all its training
rows; about SAMPLE of them, drawn by hash, only say where the rounds start. They
end when no centroid moves by more than MOVED, or after PASSES of them. A text
takes the language of the centroid with the highest cosine, which is the score.

It is rejected where its distance, 1 - cosine, is more than clean texts of its
language and length have: thresholds are a share of a low quantile of all training
rows' cosines by language and class of length (a doubling each). Classes with
few rows take the quantile over all languages, else that of the next
longer class, less what half the length takes away. Texts with fewer than LEAST
bytes of letters and blanks are too short to be told apart and are kept.

Defined cases: null text, or text without a letter, gets `und`, score 0 and is
rejected; null languages teach nothing; if nothing can be learnt, all get `und`;
ties go to the language first in order; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.common import as_bytes, small

DIM_BITS = 14
DIMS = 1 << DIM_BITS
CENTROIDS, SAMPLE, ROUNDS, PASSES, MOVED = 3, 1000, 8, 4, 1e-3
#: Vectors are summed in whole numbers of 1 / UNIT, so that their order doesn't matter; cosines are counted in so many bins; tasks whose sums are summed together.
UNIT, FINE, FAN_IN = 1 << 20, 4096, 64
#: A threshold is this share of this quantile of the training rows' cosines, if as many rows are there, and MOST at most.
SHARE, QUANTILE, ENOUGH, MOST = 0.65, 0.005, 20, 0.25
LEAST, SIZES = 16, 40
UNKNOWN = "und"
BLANKS = re.compile(rb"  +")
#: Bytes whose n-grams are counted together.
BLOCK = 1 << 20
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


#: ASCII letters in lower case, blanks for other ASCII, and other bytes as they are.
LETTERS = bytes(ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(128)) + bytes(range(128, 256))


def letters(text: bytes) -> bytes:
    return BLANKS.sub(b" ", b" " + text.translate(LETTERS) + b" ")


def term_counts(text: bytes) -> np.ndarray:
    """Counts by cell; a long text's n-grams are counted block by block, each with those that begin in it."""
    out = np.zeros(DIMS, np.int64)
    for lo in range(0, len(text), BLOCK):
        b = np.frombuffer(text[lo : lo + BLOCK + len(MULTIPLIERS)], np.uint8).astype(np.uint32)
        cells, gram = [], b
        for n, m in enumerate(MULTIPLIERS, start=2):
            if len(b) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :]
            cells.append((gram[:BLOCK] * np.uint32(m)) >> np.uint32(32 - DIM_BITS))
        if cells:
            out += np.bincount(np.concatenate(cells), minlength=DIMS)
    return out


def sparse(text: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their weights, of a text of letters()."""
    counts = term_counts(text)
    cells = np.flatnonzero(counts)
    v = np.log1p(counts[cells]) * idf[cells]
    norm = np.sqrt(v @ v)
    return cells, (v / norm if norm else v).astype(np.float32)


def vector(text: bytes, idf: np.ndarray) -> np.ndarray:
    out = np.zeros(DIMS, np.float32)
    cells, v = sparse(text, idf)
    out[cells] = v
    return out


def size_class(n: int) -> int:
    return min(SIZES - 1, n.bit_length())


@dataclass(frozen=True)
class LanguageModel:
    """Of bounded size: DIMS numbers, and for each language CENTROIDS rows of DIMS numbers and SIZES thresholds."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return UNKNOWN, 0.0, True
        kept = letters(text)
        cells, v = sparse(kept, self.idf)
        cosines = v @ self.centroids[cells]
        best = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[best])))
        owner = self.owner[best]
        return self.languages[owner], score, len(kept) >= LEAST and score < float(self.least[owner, size_class(len(kept))])


def cluster(v: np.ndarray) -> np.ndarray:
    """Spherical k-means; the first centres are taken one by one, each the row farthest from those before."""
    centres = [v.mean(axis=0)]
    centres[0] /= np.linalg.norm(centres[0]) or 1
    while len(centres) < min(CENTROIDS, len(v)):
        centres.append(v[int((v @ np.array(centres).T).max(axis=1).argmin())])
    c = np.array(centres)
    for _ in range(ROUNDS):
        owner = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            own = (owner == j).astype(v.dtype)
            if own.any():
                m = own @ v
                c[j] = m / (np.linalg.norm(m) or 1)
    return c


def low_quantile(values: np.ndarray, counts: np.ndarray) -> float:
    """What np.quantile gives for the values, each as often as counted."""
    order = np.argsort(values)
    ends = np.cumsum(counts[order])
    at = QUANTILE * (ends[-1] - 1)
    low, high = (float(values[order[np.searchsorted(ends, k, side="right")]]) for k in (np.floor(at), np.ceil(at)))
    return low + (high - low) * float(at - np.floor(at))


def thresholds(languages: list[str], samples: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """The least cosine of each language and class of length; samples: language, classes and cosines of its rows, and how many rows these stand for (one, if not given)."""
    out = np.zeros((len(languages), SIZES))
    samples = [(*s, np.ones(len(s[1]), np.int64)) if len(s) == 3 else s for s in samples]
    every = tuple(np.concatenate([s[k] for s in samples]) for k in (1, 2, 3))
    for i, name in enumerate(languages):
        own = tuple(np.concatenate([s[k] for s in samples if s[0] == name]) for k in (1, 2, 3))
        for c in range(SIZES - 1, -1, -1):
            for rows in (own, every):
                near = np.abs(rows[0] - c) <= (0 if rows is every else 1)
                if rows[2][near].sum() >= ENOUGH:
                    out[i, c] = min(MOST, SHARE * low_quantile(rows[1][near], rows[2][near]))
                    break
            else:
                out[i, c] = out[i, c + 1] / np.sqrt(2) if c + 1 < SIZES and out[i, c + 1] else 0.0
        longest = np.flatnonzero(out[i])
        if len(longest):  # beyond the rows' lengths cosines only grow
            out[i, longest[-1] :] = out[i, longest[-1]]
    return out


SUMS = "lang string, what int, task int, n binary"


def summed(group: pa.Table) -> pa.Table:
    """One row for all of a language's rows of a kind: their sum."""
    total = sum(np.frombuffer(zlib.decompress(x.as_buffer()), np.int64) for x in group.column("n"))
    first = [group.column(c)[0].as_py() for c in ("lang", "what", "task")]
    return pa.table([pa.array([x], t) for x, t in zip((*first, zlib.compress(total.tobytes(), 1)), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], [c.split()[0] for c in SUMS.split(", ")])


def met(rows: DataFrame, idf: np.ndarray, centres: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """A pass over all rows: where the centroids of each language go, and how many rows have which class of length and cosine."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, {k: np.ascontiguousarray(c.T) for k, c in centres.items()}))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, across = shared.value
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, np.ndarray] = {}
        for b in small(batches):
            for text, lang in zip(as_bytes(b.column("text")), b.column("lang").to_pylist(), strict=True):
                text = letters(text)
                if lang not in across or not text.strip():
                    continue
                if lang not in sums:
                    sums[lang], counts[lang] = np.zeros(across[lang].T.shape, np.int64), np.zeros((SIZES, FINE), np.int64)
                cells, v = sparse(text, idf)
                cosines = v @ across[lang][cells]
                own = int(cosines.argmax())
                sums[lang][own][cells] += np.rint(v * UNIT).astype(np.int64)
                counts[lang][size_class(len(text)), min(FINE - 1, max(0, int(cosines[own] * FINE)))] += 1
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for lang in sums:
            for what, n in enumerate((*sums[lang], counts[lang])):
                row = lang, -1 if n is counts[lang] else what, task, zlib.compress(n.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], [c.split()[0] for c in SUMS.split(", ")])

    parts = rows.mapInArrow(apply, SUMS).groupBy("lang", "what", (F.col("task") / FAN_IN).cast("int").alias("_group")).applyInArrow(summed, SUMS)
    moved, counts = {k: c.copy() for k, c in centres.items()}, {}
    for r in parts.groupBy("lang", "what").applyInArrow(summed, SUMS).collect():
        n = np.frombuffer(zlib.decompress(r["n"]), np.int64)
        if r["what"] < 0:
            counts[r["lang"]] = n.reshape(SIZES, FINE)
        elif n.any():
            moved[r["lang"]][r["what"]] = n / np.linalg.norm(n)
    shared.destroy()
    return moved, counts


def fit(docs: DataFrame, training: Column) -> LanguageModel:
    """docs: doc_id, text, lang and what the condition needs. Only counts, document frequencies and centroids reach the driver."""
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, langs = np.zeros(DIMS, np.int64), 0, {}
        for b in small(batches):
            for text, lang in zip(as_bytes(b.column("text")), b.column("lang").to_pylist(), strict=True):
                total += term_counts(letters(text)) > 0
                n += 1
                langs[lang] = langs.get(lang, 0) + 1
        keys = [*(("cell", str(i), int(x)) for i, x in enumerate(total) if x), ("rows", "", n), *(("lang", k, x) for k, x in langs.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keys, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["kind", "key", "n"])

    counts = rows.mapInArrow(frequencies, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    df, n, langs = np.zeros(DIMS), 0, {}
    for r in counts:
        if r["kind"] == "cell":
            df[int(r["key"])] = r["n"]
        elif r["kind"] == "rows":
            n = r["n"]
        else:
            langs[r["key"]] = r["n"]
    idf = np.log((n + 1) / (df + 1)) + 1
    if not langs:
        return LanguageModel(idf, [], np.zeros((DIMS, 0), np.float32), np.zeros(0, int), np.zeros((0, SIZES)))
    # a draw by hash of the id: the same rows on each run, however the table is dealt
    share = F.create_map(*[F.lit(x) for k, c in langs.items() for x in (k, min(1.0, SAMPLE / c))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), 1 << 30) < F.element_at(share, F.col("lang")) * (1 << 30))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 128):
            texts = [letters(t) for t in as_bytes(b.column("text"))]
            some = [i for i, t in enumerate(texts) if t.strip()]
            b, texts = b.take(pa.array(some, pa.int64())), [texts[i] for i in some]
            v = [vector(t, idf).astype(np.float16).tobytes() for t in texts]
            order = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in v]
            arrays = [b.column("lang"), pa.array([size_class(len(t)) for t in texts], pa.int32()), pa.array(order, pa.int64()), pa.array(v, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "size", "order", "v"])

    def centroids(group: pa.Table) -> pa.Table:
        """Where one language's rounds start; its drawn rows come as one block of numbers, in the order of their hashes."""
        group = group.sort_by([("order", "ascending"), ("size", "ascending")]).combine_chunks()
        block = group.column("v").combine_chunks()
        block = block.chunk(0) if isinstance(block, pa.ChunkedArray) else block
        v = np.frombuffer(block.buffers()[2], np.float16, len(block) * DIMS, 2 * DIMS * block.offset).reshape(-1, DIMS).astype(np.float32)
        return pa.table([pa.array([group.column("lang")[0].as_py()], pa.string()), pa.array([cluster(v).astype(np.float32).tobytes()], pa.binary())], ["lang", "c"])

    sample = drawn.mapInArrow(vectors, "lang string, size int, order long, v binary")
    found = sample.groupBy("lang").applyInArrow(centroids, "lang string, c binary").collect()
    if not found:
        return LanguageModel(idf, [], np.zeros((DIMS, 0), np.float32), np.zeros(0, int), np.zeros((0, SIZES)))
    centres = {r["lang"]: np.frombuffer(r["c"], np.float32).reshape(-1, DIMS) for r in sorted(found, key=lambda r: r["lang"])}
    for k in range(PASSES + 1):
        moved, counts = met(rows, idf, centres)
        if k == PASSES or min(float((moved[x] * centres[x]).sum(axis=1).min()) for x in centres) > 1 - MOVED:
            break  # the counts are those of these centroids
        centres = {x: c.astype(np.float32) for x, c in moved.items()}
    cosines = []
    for name, n in counts.items():
        classes, at = np.nonzero(n)
        cosines.append((name, classes, (at + 0.5) / FINE, n[classes, at]))
    languages, parts = [*centres], [*centres.values()]
    return LanguageModel(
        idf,
        languages,
        np.ascontiguousarray(np.concatenate(parts).T),
        np.repeat(np.arange(len(parts)), [len(x) for x in parts]),
        thresholds(languages, cosines),
    )


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs' columns, with lang_pred, score and rejected added (replaced, where there are such)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    names = {f.name for f in added}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [shared.value.predict(x) for x in as_bytes(b.column("text"))]
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            extra = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, *added]))


def keep_identified(docs: DataFrame, training: Column) -> DataFrame:
    """The rows of docs whose language is not rejected; columns as given, whatever their names."""
    aside = {c: f"_given_{c}" for c in ("lang_pred", "score", "rejected") if c in docs.columns}
    found = predict(docs.withColumnsRenamed(aside), fit(docs, training)).where("not rejected")
    return found.drop("lang_pred", "score", "rejected").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)
