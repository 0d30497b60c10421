"""Problem 3: a sample whose category shares match targets, from mergeable per-category reservoirs.

Every row gets a priority, a hash of its id. The reservoir of a category holds the rows of lowest
priority; its summary is a histogram of the rows by priority, so reservoirs of parts of the data merge
by adding histograms, and one pass over the rows makes all of them. Categories are the combinations of
the codes of all axes of a plan, so that one row counts for each of its codes. After the pass the final
counts are known: quotas are fitted to the targets (iterative proportional fitting, limited by what is
there and by the minimum of small codes), and each reservoir is trimmed uniformly to its quota by a
priority threshold. A quota may be a whole category, so no reservoir can be cut off before the counts
are known: they are written as one table of narrow rows (id, category, priority) in the pass over the
rows, and trimmed there. Only the end of a quota is ranked (``thresholds``); nothing is sorted or
gathered by category, so a category with a third of all rows costs as much as any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.llm.thresholds import FIRST_WIDTH, bucket, draw, end_of, narrowed, place
from lumenloom.session import materialize

#: Rounds of the proportional fitting.
ROUNDS = 200


def code(column: Column) -> Column:
    """A code as plans write it: trimmed, in upper case; null and blank are ''."""
    return F.upper(F.regexp_replace(F.coalesce(column, F.lit("")), r"^\s+|\s+$", ""))


class Plans:
    """The plan rows on the driver, put in order; a plan has a few codes on a few axes."""

    def __init__(self, plan: DataFrame):
        rows = [r.asDict() for r in plan.select("plan_id", "sample_permille", "axis", "code", "target_permille", "min_rows").distinct().collect()]
        self.rows = sorted((r for r in rows if None not in (r["plan_id"], r["axis"], r["code"])), key=lambda r: (r["plan_id"], r["axis"], r["code"]))
        self.ids = sorted({r["plan_id"] for r in self.rows})
        self.axes = sorted({r["axis"] for r in self.rows})
        self.codes = {axis: sorted({self.plain(r["code"]) for r in self.rows if r["axis"] == axis}) for axis in self.axes}

    @staticmethod
    def plain(value: str) -> str:
        return value.strip().upper()

    def of(self, plan_id: str) -> list[dict]:
        return [r for r in self.rows if r["plan_id"] == plan_id]


def reservoirs(rows: DataFrame, id_col: str, plans: Plans) -> DataFrame:
    """The rows' ids with their category (a code on each axis, '' for one that no plan names) and priority, written once."""
    cells = [F.when(code(F.col(axis)).isin(plans.codes[axis]), code(F.col(axis))).otherwise("").alias(f"c{i}") for i, axis in enumerate(plans.axes)]
    priority = draw(F.col(id_col), 42)
    return materialize(rows.select(F.col(id_col).alias("id"), *cells, priority.alias("priority")), "reservoirs")


def summary(reservoir: DataFrame, plans: Plans) -> DataFrame:
    """Rows by category and priority bucket. At most (product of the code counts) * BUCKETS rows."""
    return reservoir.groupBy(*[f"c{i}" for i in range(len(plans.axes))], bucket(F.col("priority")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fit(have: np.ndarray, total: int, margins: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Quotas per category, at most ``have``, whose margins come as near the targets as the rows allow.

    margins: for each code, the mask of its categories, the wanted rows, the least rows.
    """
    quota = have * (total / max(have.sum(), 1))
    for _ in range(ROUNDS):
        for mask, wanted, _ in margins:
            goal = min(wanted, have[mask].sum())
            for _ in range(6):  # what a full category can't take, its open neighbours do
                now = quota[mask].sum()
                if now <= 0 or abs(now - goal) < 0.5:
                    break
                quota[mask] = np.minimum(quota[mask] * (goal / now), have[mask])
    out = np.floor(quota + 1e-9)
    # round the rest up by largest remainder, then give small codes their minimum
    rest = int(min(total, have.sum()) - out.sum())
    for i in np.lexsort((np.arange(len(have)), out - quota))[: max(0, rest)]:
        if out[i] < have[i]:
            out[i] += 1
    for mask, _, least in margins:
        short = int(min(least, have[mask].sum()) - out[mask].sum())
        for i in np.flatnonzero(mask):
            if short <= 0:
                break
            add = min(short, int(have[i] - out[i]))
            out[i] += add
            short -= add
    return out.astype(np.int64)


def quotas(counts, plans: Plans) -> tuple[list[tuple], list[tuple]]:
    """From the final counts by category: (plan, category, quota) and the report of the plans' rows."""
    axes = [f"c{i}" for i in range(len(plans.axes))]
    cells = counts[axes].to_numpy(str) if len(counts) else np.empty((0, len(axes)), str)
    have = counts["n"].to_numpy(np.int64) if len(counts) else np.empty(0, np.int64)
    rows = int(have.sum())
    quota_rows, report = [], []
    for plan_id in plans.ids:
        mine = plans.of(plan_id)
        total = int(mine[0]["sample_permille"] or 0) * rows // 1000
        margins = []
        for r in mine:
            mask = cells[:, plans.axes.index(r["axis"])] == plans.plain(r["code"])
            target, least = int(r["target_permille"] or 0), int(r["min_rows"] or 0)
            margins.append((mask, max(target * total / 1000, least), least))
        quota = fit(have.astype(float), total, margins) if rows else have
        for i in np.flatnonzero(quota):
            quota_rows.append((plan_id, *cells[i].tolist(), int(quota[i]), int(have[i])))
        for r, (mask, _, _) in zip(mine, margins, strict=True):
            there = int(have[mask].sum())
            target = int(r["target_permille"] or 0)
            report.append((plan_id, r["axis"], r["code"], target, int(r["min_rows"] or 0), total, there, int(quota[mask].sum()), there * 1000 < target * total))
    return quota_rows, report


REPORT = "plan_id string, axis string, code string, target_permille int, min_rows int, sample_rows bigint, rows_there bigint, rows_sampled bigint, exhausted boolean"


def quota_report(rows: DataFrame, id_col: str, plan: DataFrame) -> DataFrame:
    """One row per plan row: what is there, what the sample takes, and whether the target is out of reach
    (``exhausted``: rows * 1000 < target_permille * sample size).

    Null or unknown codes belong to no target but count as rows; repeated rows count as often as they
    stand; null codes in the plan are left out; an empty table gives a report of zeros.
    """
    plans = Plans(plan)
    counts = summary(reservoirs(rows, id_col, plans), plans).groupBy(*[f"c{i}" for i in range(len(plans.axes))]).agg(F.sum("n").alias("n")).toPandas()
    return rows.sparkSession.createDataFrame(quotas(counts, plans)[1], REPORT)


def quota_sample(rows: DataFrame, id_col: str, plan: DataFrame) -> DataFrame:
    """``(plan_id, id)``: the sample of each plan, a uniform draw within each category.

    Ties of priority are broken by id; a repeated id is drawn as often as it stands. Rows with a null id
    have a priority like any other.
    """
    plans = Plans(plan)
    axes = [f"c{i}" for i in range(len(plans.axes))]
    reservoir = reservoirs(rows, id_col, plans)
    histogram = summary(reservoir, plans).toPandas()
    counts = histogram.groupby(axes, as_index=False)["n"].sum() if len(histogram) else histogram[[*axes, "n"]]
    quota_rows, _ = quotas(counts, plans)
    by_cell = {key: part.sort_values("bucket") for key, part in histogram.groupby(axes)} if len(histogram) else {}
    ends = []
    for plan_id, *cell, quota, _ in quota_rows:
        part = by_cell[tuple(cell)]
        n = part["n"].to_numpy()
        ends.append((plan_id, *cell, *end_of(part["bucket"].to_numpy(), n, n, quota, FIRST_WIDTH)))
    if not ends:
        return reservoir.select(F.lit("").alias("plan_id"), "id").where("false")
    placed = reservoir.withColumn("place", place(F.col("priority")))
    # as many rows as plans * categories: bounded by the plan, not by the data
    edges = narrowed(placed.withColumn("amount", F.lit(1)), axes, pd.DataFrame(ends, columns=["plan_id", *axes, "low", "width", "rest", "n"]))
    joined = placed.join(F.broadcast(rows.sparkSession.createDataFrame(edges.drop(columns="n"))), axes).where("place < low + width")
    inside = joined.where("place < low").select("plan_id", "id")
    window = Window.partitionBy("plan_id", *axes).orderBy("priority", "id")
    edge = joined.where("place >= low").withColumn("_rank", F.row_number().over(window)).where("_rank <= rest").select("plan_id", "id")
    return inside.unionByName(edge)
