"""Joins in which a few keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that may meet in one task, and the most keys that are told to every task instead.
HOT_ROWS, HOT_KEYS = 200_000, 100_000


#: Rows of a table that goes to every task as one value (labels, a schedule, quotas of strata).
SMALL_ROWS = 100_000


def small(rows: Column, what: str) -> Column:
    """An array that a whole table was put into, checked: more than SMALL_ROWS elements are an error when it is read."""
    said = F.concat(F.lit(f"{what}: "), F.size(rows).cast("string"), F.lit(f" rows, at most {SMALL_ROWS} go to every task"))
    return F.when(F.size(rows) <= SMALL_ROWS, rows).otherwise(F.raise_error(said))


def broadcast_small(table: DataFrame, what: str) -> DataFrame:
    """The table, marked for broadcast after a look at whether it is small."""
    if table.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        raise ValueError(f"{what}: more than {SMALL_ROWS} rows, too many for every task")
    return F.broadcast(table)


def join_skewed(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has at most one row a key; ``how`` is inner or left.

    The rows of a key that holds more than HOT_ROWS of them are not shuffled: the few rows of ``table``
    for such keys are broadcast to where they lie. The threshold rises with the number of rows, so there
    are at most HOT_KEYS such keys. Null keys match nothing; they stay out of the shuffle, too.
    """
    total = rows.count()
    if total <= HOT_ROWS:
        return rows.join(table, on, how)
    limit = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n")
    if hot.isEmpty():
        return rows.join(table, on, how)
    known = F.broadcast(hot)
    null = F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))
    cold = rows.where(~null).join(known, on, "left_anti").join(table, on, how)
    warm = rows.where(~null).join(known, on, "left_semi").join(F.broadcast(table.join(known, on, "left_semi")), on, how)
    out = cold.unionByName(warm)
    if how == "left":
        extra = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns if c not in on]
        out = out.unionByName(rows.where(null).select("*", *extra))
    return out
