"""Exact ranks over a whole table without a single-task window.

A global row number is a range partitioning, a sort inside each partition and
the number of rows in the partitions before. The sorted rows are written once,
so that all later readers see the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.functions.storage import stored

#: monotonically_increasing_id() keeps the partition above this many bits.
ROW_BITS = 33


def global_row_number(df: DataFrame, order: list[Column], name: str = "rk") -> DataFrame:
    """df with a column 1..n in the given order, which must be total for a defined result."""
    ids = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(ids.withColumns({"_part": F.shiftright("_at", ROW_BITS), "_row": F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)}).drop("_at"), "ranked")
    # one row for each partition: as many as the range partitioning has, whatever the number of rows
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row") + 1).drop("_part", "_row", "_start")


def table_size(df: DataFrame, name: str = "_size") -> DataFrame:
    """One row, one column: the number of rows."""
    return df.agg(F.count(F.lit(1)).alias(name))


#: Values that may be gathered to find one by its rank; the accuracy of the brackets around ranks; rows of a block of ranks.
FIT, ACCURACY, BLOCK = 10_000, 10_000, 10_000


def at_ranks(df: DataFrame, wanted: list[tuple[Column, int]]) -> list:
    """The value of each expression at its rank (from 1; nulls left out), None beyond the last. Nothing is sorted or shuffled.

    Each round brackets the ranks that are left by approximate percentiles of what lies between the last brackets, counts
    exactly below, at and between the new ones, and so narrows all of them in two passes. A rank that falls on a bracket is
    found, whatever number of rows share it; between brackets, at most FIT values are gathered.
    """
    sizes = list(df.agg(*[F.count(e) for e, _ in wanted]).first()) if wanted else []
    out: list = [None] * len(wanted)
    open_ = {i: (None, None, r, n) for i, ((_, r), n) in enumerate(zip(wanted, sizes, strict=True)) if 1 <= r <= n}  # bounds (outside), rank and number between

    def between(i: int) -> Column:
        e, (lo, hi, _, _) = wanted[i][0], open_[i]
        rules = [c for c in (None if lo is None else e > F.lit(lo), None if hi is None else e < F.lit(hi)) if c is not None]
        return F.when(rules[0] & rules[-1], e) if rules else e

    while open_:
        few = [i for i, (*_, n) in open_.items() if n <= FIT]
        if few:
            for i, values in zip(few, df.agg(*[F.sort_array(F.collect_list(between(i))) for i in few]).first(), strict=True):
                out[i] = values[open_[i][2] - 1]
        open_ = {i: x for i, x in open_.items() if i not in few}
        if not open_:
            break
        near = [F.percentile_approx(between(i), [max(0.0, r / n - 2 / ACCURACY), min(1.0, r / n + 2 / ACCURACY)], ACCURACY) for i, (_, _, r, n) in open_.items()]
        brackets = dict(zip(open_, df.agg(*near).first(), strict=True))
        counts = [F.count_if(rule) for i, (a, b) in brackets.items() for rule in (between(i) < F.lit(a), between(i) == F.lit(a), (between(i) > F.lit(a)) & (between(i) < F.lit(b)), between(i) == F.lit(b))]
        found = list(df.agg(*counts).first())
        for k, (i, (a, b)) in enumerate(brackets.items()):
            lo, hi, r, n = open_.pop(i)
            below, first, inner, last = found[4 * k : 4 * k + 4]
            last = last if b > a else 0
            if r <= below:
                open_[i] = lo, a, r, below
            elif r <= below + first:
                out[i] = a
            elif r <= below + first + inner:
                open_[i] = a, b, r - below - first, inner
            elif r <= below + first + inner + last:
                out[i] = b
            else:
                r -= below + first + inner + last
                open_[i] = b, hi, r, n - (below + first + inner + last)
    return out


def several_quartiles(df: DataFrame, columns: dict[str, str], tie: str) -> DataFrame:
    """For each column a label 1..4 under the given name: by rank of the column (nulls first), ties broken by the column `tie`.

    The upper edges lie at 1 + k (n - 1) / 4. They are selected, first by value, then among the ties of that value.
    """
    n, *nulls = df.agg(F.count(F.lit(1)), *[F.count_if(F.col(c).isNull()) for c in columns]).first()
    if not n:
        return df.withColumns({name: F.lit(4) for name in columns.values()})
    edges = [(c, 1 + k * (n - 1) // 4, m) for c, m in zip(columns, nulls, strict=True) for k in (1, 2, 3)]
    values = at_ranks(df, [(F.col(c), r - m) for c, r, m in edges])  # none where the rank is a null's
    of = {c: t for c, t in df.dtypes}
    literal = lambda v, c: F.lit(v).cast(of[c])
    below = list(df.agg(*[F.count_if(F.lit(False) if v is None else F.col(c).isNull() | (F.col(c) < literal(v, c))) for (c, _, _), v in zip(edges, values, strict=True)]).first())
    ties = at_ranks(df, [(F.when(F.col(c).eqNullSafe(literal(v, c)), F.col(tie)), r - b) for (c, r, _), v, b in zip(edges, values, below, strict=True)])
    labels = {}
    for j, (c, name) in enumerate(columns.items()):
        at, label = F.struct(F.col(c).alias("value"), F.col(tie).alias("tie")), F.lit(4)
        for k in (2, 1, 0):
            edge = F.struct(literal(values[3 * j + k], c).alias("value"), literal(ties[3 * j + k], tie).alias("tie"))
            label = F.when(at <= edge, k + 1).otherwise(label)
        labels[name] = label
    return df.withColumns(labels)


def quartiles(df: DataFrame, column: str, tie: str, name: str) -> DataFrame:
    """See several_quartiles."""
    return several_quartiles(df, {column: name}, tie)


def percent_rank_average(ranked: DataFrame, column: str, name: str, rank: str = "_rk") -> DataFrame:
    """(rank averaged over equal values) / n, given global row numbers in the order of the column.

    Ties are found inside blocks of BLOCK ranks. A run of equal values that goes over a border is mended from a table
    of one row a block: where the run began, and where it ends. So a value that half the rows have is no hot key.
    """
    rows = ranked.withColumn("_block", F.floor((F.col(rank) - 1) / BLOCK))
    peers = W.partitionBy("_block", column)
    rows = rows.withColumns({"_lo": F.min(rank).over(peers), "_hi": F.max(rank).over(peers)})
    blocks = rows.groupBy("_block").agg(
        F.min_by(F.struct(column), rank)[column].alias("_first"), F.max_by(F.struct(column), rank)[column].alias("_last"), F.max("_lo").alias("_tail"), F.min("_hi").alias("_head"), F.count(F.lit(1)).alias("_n")
    )
    order = W.orderBy("_block")  # one row a block
    single = F.col("_first").eqNullSafe(F.col("_last"))
    known = lambda side: F.lag(F.lit(True)).over(order) if side < 0 else F.lead(F.lit(True)).over(order)
    came = known(-1).isNotNull() & F.col("_first").eqNullSafe(F.lag("_last").over(order))
    goes = known(1).isNotNull() & F.col("_last").eqNullSafe(F.lead("_first").over(order))
    blocks = blocks.withColumns({"_came": came, "_goes": goes})
    begun = F.last(F.when(~(F.col("_came") & single), F.col("_tail")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    ends = F.first(F.when(~(F.col("_goes") & single), F.col("_head")), ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    blocks = blocks.select("_block", "_first", "_last", F.when(F.col("_came"), begun).alias("_begun"), F.when(F.col("_goes"), ends).alias("_ends"))
    out = rows.join(blocks, "_block").crossJoin(F.broadcast(table_size(ranked)))
    lo = F.when(F.col(column).eqNullSafe(F.col("_first")), F.coalesce("_begun", "_lo")).otherwise(F.col("_lo"))
    hi = F.when(F.col(column).eqNullSafe(F.col("_last")), F.coalesce("_ends", "_hi")).otherwise(F.col("_hi"))
    return out.withColumn(name, (lo + hi) / F.lit(2.0) / F.col("_size")).select(*ranked.columns, name)


def approximate_quantiles(df: DataFrame, column: str, shares: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """One row of values whose ranks are off by at most rows / accuracy, in one pass: the cheap choice where that is enough."""
    return df.agg(*[F.percentile_approx(column, share, accuracy).alias(name) for name, share in shares.items()])


def exact_quantiles(df: DataFrame, column: str, shares: dict[str, float], rank: str = "_rk") -> DataFrame:
    """One row of linearly interpolated quantiles of the rows with a value: of the two ranks beside each.

    Global row numbers are used where df has them, in one pass; else both ranks are selected without a sort.
    """
    if rank not in df.columns:
        n = df.agg(F.count(column)).first()[0]
        lows = [int(share * (n - 1)) for share in shares.values()] if n else []
        values = at_ranks(df, [(F.col(column), r) for low in lows for r in (low + 1, min(low + 2, n))])
        kind = dict(df.dtypes)[column]
        pairs = zip(shares.items(), lows or [0] * len(shares), values[::2] or [None] * len(shares), values[1::2] or [None] * len(shares), strict=True)
        literal = lambda v: F.lit(v).cast(kind)
        one = df.sparkSession.range(1)
        return one.select(*[(literal(a) + (literal(b) - literal(a)) * F.lit(share * (n - 1) - low)).alias(name) for (name, share), low, a, b in pairs])
    sized = df.crossJoin(F.broadcast(table_size(df)))
    picks, out = [], []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_size") - 1)
        low = F.floor(at)
        picks += [
            F.max(F.when(F.col(rank) == low + 1, F.col(column))).alias(f"_a_{name}"),
            F.max(F.when(F.col(rank) == F.least(low + 2, F.col("_size")), F.col(column))).alias(f"_b_{name}"),
            F.max(at - low).alias(f"_f_{name}"),
        ]
        out.append((F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * F.col(f"_f_{name}")).alias(name))
    return sized.agg(*picks).select(*out)


def temporal_split(df: DataFrame, time: str, tie: str, share: float = 0.8) -> DataFrame:
    """Adds `split`: train for the oldest share of rows (at least one, and not all), else test."""
    ranked = global_row_number(df, [F.col(time).asc(), F.col(tie).asc()], "_rk")
    n = F.col("_size")
    cut = F.greatest(F.lit(1), F.least(F.floor(n * F.lit(share)), n - 1))
    sized = ranked.crossJoin(F.broadcast(table_size(ranked)))
    return sized.withColumn("split", F.when(F.col("_rk") <= cut, "train").otherwise("test")).drop("_rk", "_size")


def hash_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def ranked_within_label(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """_at: 0, 1, .. inside each label, in an order drawn by hash, and _n: the label's rows."""
    ranked = global_row_number(df, [F.col(label).asc(), hash_order(key, seed).asc(), F.col(key).asc()], "_rk")
    firsts = ranked.groupBy(label).agg(F.min("_rk").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumnRenamed(label, "_label")
    out = ranked.join(F.broadcast(firsts), F.col(label) == F.col("_label"))  # one row for each label
    return out.withColumn("_at", F.col("_rk") - F.col("_first")).drop("_rk", "_first", "_label")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    out = ranked_within_label(df, label, key, seed)
    return out.withColumn("split", F.when(F.col("_at") < F.round(F.col("_n") * F.lit(share)), "train").otherwise("test")).drop("_at", "_n")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Adds `fold`, 0..folds-1, whose labels are as even as can be."""
    return ranked_within_label(df, label, key, seed).withColumn("fold", F.pmod("_at", F.lit(folds)).cast("int")).drop("_at", "_n")
