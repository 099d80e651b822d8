"""Small helpers shared by the operators: stored tables, whole-text tokens, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.storage import discard, shared_dir, stored  # noqa: F401

M64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def held_out(modulus: int, remainder: int = 2, column: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves the given remainder; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % modulus == remainder


def release() -> None:
    """Gives free memory back to the system: Python workers live on from stage to stage, and their memory adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


#: How to empty what operators remember from task to task in this worker, by operator.
REMEMBERED: dict[str, Callable[[], None]] = {}


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices: Python objects and results are made for so many texts at a time.

    A worker that comes to another operator's task gives up what the operators before have remembered.
    """
    for name in [n for n in REMEMBERED if n != owner]:
        REMEMBERED.pop(name)()
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
    release()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column of an Arrow batch."""
    return column.cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs without the characters x20 and x09-x0D: what bytes.split() does."""
    return text.split() if text else []


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound of entries."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as far as they were needed."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            steps = np.full(n, self.BASE, np.uint64), np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """base ** n, ..., base ** 0, modulo 2 ** 64."""
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base & M64)
    return np.array(out[::-1], dtype=np.uint64)


def window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries."""
    if len(w) < k:
        return np.empty(0, np.uint64)
    n, out = len(w) - k + 1, np.zeros(len(w) - k + 1, np.uint64)
    for i, p in enumerate(powers(k)):
        out += w[i : i + n] * p
    return mix(out)


#: Ids of which a set may be broadcast (8 bytes each, some 100 MB as a hash table); beyond it, a shuffle join does the same.
BROADCAST_IDS = 2_000_000


#: Rows that a table may have to be broadcast whole; rows of a key from which it is dealt to SALTS tasks.
BROADCAST_ROWS, HOT, SALTS = 500_000, 20_000, 64


def attached(rows: DataFrame, table: DataFrame, key: str, spread: str, most: int | None = None) -> DataFrame:
    """rows joined with a table that has one row for each key, at most `most` (counted where that isn't known).

    The table is broadcast if it has at most BROADCAST_ROWS rows. Else both are
    shuffled, and the rows of a hot key are dealt to SALTS tasks by a hash of the
    column `spread`; the table's row of that key goes to each of them.
    """
    if (table.limit(BROADCAST_ROWS + 1).count() if most is None else most) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select(key, F.lit(True).alias("_hot"))
    hot = F.broadcast(stored(hot, "hot"))  # at most a row for HOT rows
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), SALTS).cast("int")).otherwise(0)
    each = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    left = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    right = table.join(hot, key, "left").withColumn("_salt", each).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def only_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs whose doc_id is among ids (how: left_semi) or is not (left_anti).

    The set of ids is broadcast only after its size was checked.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)
