"""Draws by hash threshold: where a budget ends is found from histograms, and only that end is looked at closely.

A row's draw is 60 bits of an md5 digest, the same in any engine; its place is the upper 36 of them. A histogram over the upper 12 of them tells in which
bucket a budget ends. While that bucket holds more rows than one task ranks, a second and a third
histogram over the next 12 bits narrow it, so the rows ranked are a 4,096th, a 16-millionth or less of
their category, whatever the category's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a histogram, and the places that one of the first histogram covers.
BUCKETS, FIRST_WIDTH = 1 << 12, 1 << 24
#: Rows that are ranked together without another histogram.
EDGE_ROWS = 50_000


def draw(key: Column, seed: int) -> Column:
    """60 bits of the digest of a row's key; a null key has a draw like any other."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def place(drawn: Column) -> Column:
    return F.shiftright(drawn, 24)


def bucket(drawn: Column) -> Column:
    """The bucket of the first histogram."""
    return F.shiftright(drawn, 48).cast("int")


def end_of(buckets: np.ndarray, amounts: np.ndarray, rows: np.ndarray, goal: int, width: int) -> tuple[int, int, int, int]:
    """(first place, places, amount still wanted there, rows) of the bucket in which the goal is reached."""
    below = np.cumsum(amounts)
    at = int(np.searchsorted(below, goal))
    return int(buckets[at]) * width, width, int(goal - (below[at - 1] if at else 0)), int(rows[at])


def narrowed(rows: DataFrame, by: list[str], edges: pd.DataFrame) -> pd.DataFrame:
    """``edges`` (plan, the columns of ``by``, low, width, rest, n) with every edge of more than EDGE_ROWS
    rows narrowed as far as the hash goes. ``rows``: the columns of ``by``, place, amount.

    Edges are as many as plans times categories; a histogram has BUCKETS rows for each.
    """
    edges = edges.reset_index(drop=True)
    for width in (1 << 12, 1):
        wide = edges[(edges["n"] > EDGE_ROWS) & (edges["width"] > width)]
        if not len(wide):
            break
        table = rows.sparkSession.createDataFrame(wide.assign(edge=wide.index)[["edge", *by, "low", "width"]])
        inside = rows.join(F.broadcast(table), by).where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.col("width")))
        found = inside.groupBy("edge", F.expr(f"place div {width}").alias("bucket")).agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("rows")).toPandas()
        for edge, part in found.sort_values("bucket").groupby("edge"):
            edges.loc[edge, ["low", "width", "rest", "n"]] = end_of(part["bucket"].to_numpy(), part["amount"].to_numpy(), part["rows"].to_numpy(), int(edges.loc[edge, "rest"]), width)
    return edges
