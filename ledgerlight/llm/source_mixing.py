"""Mixing sources to target weights by entropy balancing.

Among all document rates r with the right number of words per source, take the
one closest to 1 in relative entropy. Its dual is convex, with one multiplier
per source: r = min(cap, exp(lambda * x)), x being the document's length over
the mean length of its source. Newton steps, kept inside a bracket, find the
multipliers; each step is one aggregate over the histogram (source, length).
The rates are rounded into whole copies by diffusing the rounding error, from
long documents to short ones, within hashed blocks of a source. Rounding never
goes above the cap: what a full document can't take goes on to the next one.

The table of sources goes beside the rows as a broadcast if it has at most
BROADCAST_SOURCES rows, else by a shuffle join.

Defined cases: null text counts as empty (size 0); a null source is a source of
its own, last in order; rows equal in (doc_id, source, size) get equal copies;
a source without words has target 0; an empty table gives an empty result;
further columns are ignored by the plan and kept by the mix, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.common import as_bytes, discard, small, stored, words
from ledgerlight.operators.ranking import global_row_number

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix over the words of the input; most copies of a document.
SHARE, CAP = 1.5, 2.0
#: Rows of a block in which the rounding error is diffused (expected number).
BLOCK = 2048
#: A source is settled at this relative distance from its target. Steps halve the bracket at least, so they end; more than STEPS are an error.
TOLERANCE, STEPS = 1e-7, 400
BROADCAST_SOURCES = 100_000


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        sizes = pa.array([len(words(x)) for x in as_bytes(b.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), sizes], ["doc_id", "source", "size"])


def few_rows(table: DataFrame) -> bool:
    return table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def beside(rows: DataFrame, by_source: DataFrame, few: bool, *columns: str) -> DataFrame:
    """rows with columns of the table that has one row for each source."""
    own = by_source.select(F.col("source").alias("_of"), *columns)
    return rows.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def with_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, mean_size, least_size, target: one row for each source."""
    by_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"),
    )
    ranked = global_row_number(by_source, [F.col("source").asc_nulls_last()], "place")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, len(weights)) + 1).cast("int"))
    table = stored(ranked.withColumn("weight", cycle), "sources")
    most = F.col("source_size") * F.lit(float(cap))
    level, held = 0.0, -1
    while True:  # each round the water level rises, until no further source is full
        full = F.col("weight") * F.lit(level) > most if held >= 0 else F.lit(False)
        got = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, most).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weights"),
            F.count_if(full).alias("n"),
        ).first()
        if not got["all"] or not got["weights"] or got["n"] == held:
            break
        held, level = got["n"], (share * got["all"] - got["fixed"]) / got["weights"]
    mean = F.col("source_size") / F.greatest(F.col("n"), F.lit(1))
    return table.select("source", "source_size", "least_size", mean.alias("mean_size"), F.least(F.col("weight") * F.lit(level), most).alias("target"))


def rate_of(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.when(size <= 0, F.lit(1.0)).otherwise(F.exp(F.least(lam * size / mean, F.lit(math.log(cap)))))


def multipliers(sizes: DataFrame, targets: DataFrame, cap: float, few: bool) -> DataFrame:
    """source, lam: the dual solution of each source that is not full."""
    histogram = stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    least = F.col("least_size") / F.col("mean_size")
    ratio = F.log(F.col("target") / F.col("source_size"))
    state = targets.where((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * F.lit(cap * (1 - 1e-12)))).withColumns({
        "lam": ratio,
        "lo": F.least(ratio / least, F.lit(0.0)),
        "hi": F.lit(math.log(cap) * (1 + 1e-9)) / least,
        "off": F.lit(1.0),
    })
    state = stored(state, "dual")
    for _ in range(STEPS):
        at = beside(histogram, state, few, "lam", "mean_size")
        mass = F.col("n") * F.col("size")
        r = rate_of(F.col("lam"), F.col("size"), F.col("mean_size"), cap)
        below = F.col("lam") * F.col("size") / F.col("mean_size") < math.log(cap)
        sums = at.groupBy("source").agg(
            F.sum(mass * r).alias("words"),
            F.sum(F.when(below, mass * r * F.col("size") / F.col("mean_size")).otherwise(0.0)).alias("slope"),
        )
        new = beside(state.drop("off"), sums, few, "words", "slope")
        over = F.col("words") > F.col("target")
        new = new.withColumns({"lo": F.when(over, F.col("lo")).otherwise(F.col("lam")), "hi": F.when(over, F.col("lam")).otherwise(F.col("hi"))})
        step = F.col("lam") - F.try_divide(F.col("words") - F.col("target"), F.col("slope"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        shut = F.col("hi") - F.col("lo") <= F.lit(1e-14) * (F.abs("lam") + 1)  # no number is left between
        off = F.when(shut, 0.0).otherwise(F.abs(F.col("words") - F.col("target")) / F.col("target"))
        new = new.withColumns({
            "off": off,
            "lam": F.when(off < TOLERANCE / 10, F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2),
        })
        last, state = state, stored(new.drop("words", "slope"), "dual")
        discard(last)
        if (state.agg(F.max("off")).first()[0] or 0.0) < TOLERANCE:
            return state.select("source", "lam")
    raise RuntimeError(f"the dual did not settle in {STEPS} steps")


def rounded(block: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Whole copies, at most cap; what rounding adds or lacks is carried on to the next shorter document."""
    block = block.sort_values(["mass", "tie"], ascending=[False, True], kind="stable")
    carry, copies = 0.0, []
    for rate, mass in zip(block["rate"], block["mass"], strict=True):
        whole = math.floor(rate)
        part = rate - whole
        more = int(whole + 1 <= cap and (carry + part * mass >= mass / 2 if mass else part >= 0.5))
        carry += (part - more) * mass
        copies.append(whole + more)
    return block.assign(copies=copies)[["doc_id", "source", "size", "copies"]]


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, n, source_size, target, copies: one row for each different (doc_id, source, size)."""
    sizes = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    sizes = stored(sizes.mapInArrow(word_counts, "doc_id long, source string, size long"), "sizes")
    targets = stored(with_targets(sizes, weights, share, cap), "targets")
    few = few_rows(targets)
    lam = multipliers(sizes, targets, cap, few)
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    per_source = units.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    solved = targets.alias("t").join(lam.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left").select("t.*", F.coalesce("lam", F.lit(0.0)).alias("lam"))
    both = stored(beside(solved, per_source, False, "blocks"), "solved")
    at = beside(units, both, few, "source_size", "target", "mean_size", "lam", "blocks")
    full = F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12))
    at = at.select(
        "doc_id", "source", "size", "n", "source_size", "target",
        F.when(full, F.lit(float(cap))).otherwise(rate_of(F.col("lam"), F.col("size"), F.col("mean_size"), cap)).alias("rate"),
        (F.col("size") * F.col("n")).cast("double").alias("mass"),
        F.xxhash64("doc_id", "size").alias("tie"),
        F.pmod(F.xxhash64(F.lit(7), "doc_id", "size"), "blocks").alias("block"),
    )
    schema = T.StructType([*at.select("doc_id", "source", "size").schema.fields, T.StructField("copies", T.LongType())])
    copies = at.select("doc_id", "source", "size", "rate", "mass", "tie", "block").groupBy("source", "block").applyInPandas(lambda b: rounded(b, cap), schema)
    key = [F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("doc_id", "source", "size")]
    return at.alias("a").join(copies.alias("c"), key).select("a.doc_id", "a.source", "a.size", "n", "source_size", "target", "copies")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it; columns as given.

    Copies keep their doc_id. Size is counted anew here rather than stored beside the text.
    """
    names = docs.columns
    doc, source, text = (f"_{names.index(c)}" for c in ("doc_id", "source", "text"))
    plan = mix_plan(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("doc"), F.col("source").alias("of"), F.col("size").alias("long"), "copies"
    )
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            n = pa.array([len(words(x)) for x in as_bytes(b.column(text))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*b.schema.names, "words"])

    rows = rows.withColumn(text, F.col(text).cast("string"))
    rows = rows.mapInArrow(sized, T.StructType([*rows.schema.fields, T.StructField("words", T.LongType())]))
    on = [F.col(doc).cast("long").eqNullSafe(F.col("doc")), F.col(source).cast("string").eqNullSafe(F.col("of")), F.col("words") == F.col("long")]
    each = rows.join(plan, on).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(*[F.col(f"_{i}") for i in range(len(names))]).toDF(*names)
