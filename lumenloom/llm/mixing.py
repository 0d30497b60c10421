"""Problem 5: a mix of sources by target shares of its size, by hash-threshold histograms.

Every record gets a hash of its id. One pass sums characters by source and hash bucket. A budget is a
threshold on the hash: records below it are in. The bucket that holds a source's threshold is refined
until it is small (``thresholds``) and ranked; all other records are decided by their bucket alone, without a sort. Thresholds
nest: a larger budget keeps what a smaller one took. A source that is too small is repeated: whole
rounds of it, at most the plan's ``max_repeats`` in all, the last round by a threshold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions.text import bare
from lumenloom.llm.thresholds import FIRST_WIDTH, bucket, draw, end_of, narrowed, place

REPORT = (
    "mix_id string, source string, target_permille int, max_repeats int, budget bigint, wanted bigint, have bigint, "
    "taken bigint, actual_permille double, out_of_reach boolean"
)


def sized(rows: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Records with their size in code points and hash bucket; null texts have no size and are left out."""
    hashed = draw(F.col(id_col), 7)
    return rows.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), bare(F.col(source_col)).alias("name"), F.char_length(text_col).cast("bigint").alias("size"), hashed.alias("hash")
    ).withColumn("bucket", bucket(F.col("hash")))


def histograms(records: DataFrame, plan: DataFrame):
    """(histogram of the planned sources, total size of all sources) on the driver: at most sources * BUCKETS rows."""
    named = plan.select(bare(F.col("source")).alias("name")).where("name is not null").distinct()
    hot = records.groupBy("name", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    planned = F.broadcast(named.withColumn("planned", F.lit(True)))  # the plan's sources
    folded = hot.join(planned, "name", "left").groupBy(
        F.when(F.col("planned"), F.col("name")).alias("name"), F.when(F.col("planned"), F.col("bucket")).alias("bucket")
    ).agg(F.sum("size").alias("size"), F.sum("n").alias("n")).toPandas()
    total = int(folded["size"].sum()) if len(folded) else 0
    return folded[folded["name"].notna()] if len(folded) else folded, total


def decide(plan_rows: list[dict], histogram, total: int) -> tuple[list[tuple], list[tuple]]:
    """(thresholds, report) of every plan row."""
    by_name = {k: p.sort_values("bucket") for k, p in histogram.groupby("name")} if len(histogram) else {}
    thresholds, report = [], []
    for r in sorted(plan_rows, key=lambda r: (r["mix_id"], r["source"])):
        target, repeats = int(r["target_permille"] or 0), int(r["max_repeats"] or 0)
        budget = int(r["budget_permille"] or 0) * total // 1000
        wanted = target * budget // 1000
        part = by_name.get(r["name"])
        have = int(part["size"].sum()) if part is not None else 0
        out = have * repeats * 1000 < target * budget
        goal = min(wanted, have * repeats)
        rounds, rest = divmod(goal, have) if have else (0, 0)
        if have:
            end = end_of(part["bucket"].to_numpy(), part["size"].to_numpy(), part["n"].to_numpy(), rest, FIRST_WIDTH) if rest else (0, 0, 0, 0)
            thresholds.append((r["mix_id"], r["name"], int(rounds), *end))
        report.append((r["mix_id"], r["source"], target, repeats, budget, wanted, have, goal, 1000.0 * goal / budget if budget else 0.0, out))
    return thresholds, report


def _plan_rows(plan: DataFrame) -> list[dict]:
    rows = plan.where("mix_id is not null and source is not null").select("*", bare(F.col("source")).alias("name")).distinct().collect()
    return [r.asDict() for r in rows]


def mix_report(rows: DataFrame, id_col: str, text_col: str, source_col: str, plan: DataFrame) -> DataFrame:
    """One row per plan row: budget, wanted and available characters, the share reached (up to one record
    a source), and whether the source can't reach its share (have * max_repeats * 1000 < target_permille * budget).

    Sources match if bare-equal; null sources and sources outside the plan count only in the total; null
    texts count nowhere, empty ones as zero characters; an empty table gives zeros, and no source is out of reach.
    """
    histogram, total = histograms(sized(rows, id_col, text_col, source_col), plan)
    return rows.sparkSession.createDataFrame(decide(_plan_rows(plan), histogram, total)[1], REPORT)


def mix_sample(rows: DataFrame, id_col: str, text_col: str, source_col: str, plan: DataFrame) -> DataFrame:
    """``(mix_id, id, copies)``: the records of each mix and how often each is repeated (1 to max_repeats).

    At the end of a budget records are taken in the order of hash, id and size while they fit into its rest.
    """
    records = sized(rows, id_col, text_col, source_col)
    histogram, total = histograms(records, plan)
    thresholds, _ = decide(_plan_rows(plan), histogram, total)
    records = records.withColumn("place", place(F.col("hash")))
    if not thresholds:
        return records.select(F.lit("").alias("mix_id"), "id", F.lit(0).cast("bigint").alias("copies")).where("false")
    edges = narrowed(records.withColumn("amount", F.col("size")), ["name"], pd.DataFrame(thresholds, columns=["mix_id", "name", "rounds", "low", "width", "rest", "n"]))
    joined = records.join(F.broadcast(rows.sparkSession.createDataFrame(edges.drop(columns="n"))), "name")  # a row per plan row
    at_edge = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.col("width"))
    whole = joined.where(~at_edge).select("mix_id", "id", (F.col("rounds") + F.when(F.col("place") < F.col("low"), 1).otherwise(0)).alias("copies"))
    window = Window.partitionBy("mix_id", "name").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.where(at_edge).withColumn("_run", F.sum("size").over(window))
    edge = edge.select("mix_id", "id", (F.col("rounds") + F.when(F.col("_run") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    return whole.unionByName(edge).where("copies > 0")


def reached(mix: DataFrame, rows: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(mix_id, source, records, size, permille)``: what the records of a mix add up to, repeats counted."""
    sizes = rows.select(F.col(id_col).alias("id"), bare(F.col(source_col)).alias("source"), F.char_length(text_col).cast("bigint").alias("n"))
    sums = mix.join(sizes, "id").groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("n") * F.col("copies")).alias("size"))
    return sums.withColumn("permille", F.col("size") * 1000.0 / F.sum("size").over(Window.partitionBy("mix_id")))  # one row a source
