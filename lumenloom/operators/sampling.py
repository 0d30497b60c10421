"""Deterministic samples and splits: every random choice is a hash order, the same in any engine.

Ranks are taken within strata. A stratum that holds a third of the rows would make a window a single
task, so ranks come from ``stratum_rank``: rows are bucketed by their hash, buckets are counted, and a
row's rank is the rows of earlier buckets plus its rank inside its own small bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import text as T
from lumenloom.operators.skew import broadcast_small

#: Hash buckets of a stratum (two hex digits of the hash order).
RANK_BUCKETS = 256


def stratum_rank(df: DataFrame, strata: list[str], key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``_rank`` (1..) in hash order within each stratum and ``_n``, the stratum's rows. Null
    strata are strata like any other; rows without a key rank among the first."""
    keyed = df.withColumn("_h", F.coalesce(T.hash_order(F.col(key), seed), F.lit("00"))).withColumn("_b", F.substring("_h", 1, 2))
    same = [F.coalesce(F.col(s).cast("string"), F.lit("\0")).alias(f"_s{i}") for i, s in enumerate(strata)]
    names = [f"_s{i}" for i in range(len(strata))]
    keyed = keyed.select("*", *same)
    counts = keyed.groupBy(*names, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*names)
    offsets = counts.select(*names, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("_n"))
    inside = Window.partitionBy(*names, "_b").orderBy("_h", key)
    ranked = keyed.withColumn("_i", F.row_number().over(inside)).join(offsets, [*names, "_b"])
    return ranked.withColumn("_rank", F.col("_i") + F.col("_before")).drop(*names, "_b", "_h", "_i", "_before")


def capped(df: DataFrame, by: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """At most int(rows * share) rows of each value of ``by``."""
    total = df.count()
    return stratum_rank(df, [by], key, seed).where(F.col("_rank") <= int(total * share)).select(df.columns)


def capped_each(df: DataFrame, by: str, key: str, most: int, seed: int = 42) -> DataFrame:
    return stratum_rank(df, [by], key, seed).where(F.col("_rank") <= most).select(df.columns)


def split_sizes(n: Column, val: float, test: float) -> tuple[Column, Column]:
    """Rows of a stratum of n for (test, val): rounded shares, at least one; a third at most where little is there."""
    t, v = F.greatest(F.lit(1), F.bround(n * test)), F.greatest(F.lit(1), F.bround(n * val))
    third = F.greatest(F.lit(1), F.floor(n / 3))
    tight = t + v >= n
    return F.when(tight, F.least(t, third)).otherwise(t), F.when(tight, F.least(v, third)).otherwise(v)


def stratified_split(df: DataFrame, strata: list[str], key: str, val: float = 0.025, test: float = 0.025, seed: int = 42) -> DataFrame:
    """``df`` with ``part`` (test, val, train): every stratum keeps its share; a stratum of one goes to test."""
    ranked = stratum_rank(df, strata, key, seed)
    t, v = split_sizes(F.col("_n"), val, test)
    part = F.when(F.col("_rank") <= t, "test").when(F.col("_rank") <= t + v, "val").otherwise("train")
    return ranked.withColumn("part", part).drop("_rank", "_n")


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer): per stratum max(1, round(share * n)), one pass of plus or
    minus one over the strata by size, then cut or filled up in hash order over all."""
    ranked = stratum_rank(df, strata, key, seed)
    sizes = ranked.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size"))
    everything = Window.partitionBy()
    base = sizes.withColumn("_a", F.greatest(F.lit(1), F.bround(F.col("_size") / F.sum("_size").over(everything) * n)).cast("bigint"))
    base = base.withColumn("_over", F.sum("_a").over(everything) - n)
    can = F.when(F.col("_over") > 0, F.col("_a") > 1).otherwise(F.col("_a") < F.col("_size"))
    by_size = Window.orderBy(F.desc("_size"), *strata)  # as many rows as strata
    base = base.withColumn("_turn", F.sum(F.when(can, 1).otherwise(0)).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    step = F.when(can & (F.col("_turn") <= F.abs("_over")), F.signum("_over")).otherwise(0)
    quota = base.select(*strata, (F.col("_a") - step).alias("_quota"))
    same = [ranked[s].eqNullSafe(quota[s]) for s in strata]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    marked = ranked.join(broadcast_small(quota, "quotas of strata"), condition).drop(*[quota[s] for s in strata])
    # chosen rows first, all in hash order: the first n
    order = marked.withColumn("_late", F.when(F.col("_rank") <= F.col("_quota"), 0).otherwise(1))
    return order.orderBy("_late", T.hash_order(F.col(key), seed + 1), key).limit(n).select(df.columns)


def weighted_allocation(df: DataFrame, cell: list[str], target: int, floor: int, cells: int) -> DataFrame:
    """``cell..., size, alloc``: a floor for each cell and a proportional part of what the floors of all
    ``cells`` (present or not) leave; everything if the rows are no more than the target."""
    sizes = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("size"))
    total = df.count()
    if total <= target:
        return sizes.withColumn("alloc", F.col("size"))
    rest = target - min(floor * cells, target)
    alloc = F.least((F.least(F.lit(floor), F.col("size")) + F.lit(rest) * F.col("size") / F.lit(max(total, 1))).cast("bigint"), F.col("size"))
    return sizes.withColumn("alloc", alloc)


def nested_subsets(df: DataFrame, key: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """The first max(sizes) rows in hash order with a flag column for each named subset: smaller ones lie in larger ones."""
    most = max(sizes.values())
    first = df.withColumn("_h", T.hash_order(F.col(key), seed)).orderBy("_h", key).limit(most)
    ranked = first.withColumn("_r", F.row_number().over(Window.orderBy("_h", key)))
    for name, n in sizes.items():
        ranked = ranked.withColumn(name, F.col("_r") <= n)
    return ranked.drop("_h", "_r")


def weighted_pick(key: Column, choices: list[tuple[object, float]], seed: int = 42) -> Column:
    """A value drawn by cumulative weights from a row's hashed uniform number."""
    u, total, below, bounds = T.hash_uniform(key, seed), sum(w for _, w in choices), 0.0, []
    for value, weight in choices:
        below += weight / total
        bounds.append((value, below))
    out = F.lit(bounds[-1][0])
    for value, bound in reversed(bounds[:-1]):
        out = F.when(u < bound, F.lit(value)).otherwise(out)
    return out


def batches(df: DataFrame, order: list[Column], size: int, drop_last: bool = False) -> DataFrame:
    """``df`` with ``batch``, contiguous in the order. Positions come from a range sort (zipWithIndex), so no
    task holds the whole table."""
    placed = positions(df, order)
    out = placed.withColumn("batch", F.floor(F.col("_pos") / size)).drop("_pos")
    if drop_last:
        out = out.where(F.col("batch") < df.count() // size)
    return out


def aligned(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The rows of two tables side by side by their places in their orders; tables of different numbers of
    rows are an error, as then no row's partner can be told."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows can't be aligned with {m}")
    a, b = positions(left, [F.col(c) for c in left_order]), positions(right, [F.col(c) for c in right_order])
    return a.join(b, "_pos").drop("_pos")


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``_pos`` (0..) in a total order, from per-partition counts of a range partitioning."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    from lumenloom.session import materialize

    ranged = materialize(ranged, "positions")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return ranged.join(F.broadcast(offsets), "_p").withColumn("_pos", F.col("_m") - F.col("_first") + F.col("_before")).drop("_p", "_m", "_first", "_before")
