"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenloom.functions.text import strip


def event_time(df: DataFrame, column: str) -> DataFrame:
    """A zoneless time as event time: watermarks need an instant."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str, by: list[str], window: Column, late: str) -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` are dropped, closed windows are emitted."""
    rows = event_time(events, time).withWatermark(time, late)
    return rows.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def dedup_stream(df: DataFrame, text: str, time: str, late: str) -> DataFrame:
    """The first row of each trimmed, lower-cased text within the lateness."""
    rows = event_time(df, time).withWatermark(time, late).withColumn("_key", F.lower(strip(F.col(text))))
    return rows.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def failure_streaks(events: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """``(key, longest, late)``: the longest run of failures of each key so far, updated as batches arrive.

    The state of a key is two counters, the last place in the order and the rows that came too late: a row
    that stands before that place can't be put into a run that is already counted, so it is left out and
    counted in ``late``. Rows without a place are late, too.
    """
    kind = events.schema[key].dataType.simpleString()

    def fold(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, longest, last, late = state.get if state.exists else (0, 0, None, 0)
        rows = pd.concat(list(parts))
        fresh, last = _in_order(rows, last)
        late += len(rows) - len(fresh)
        for bad in fresh["f"]:
            run = run + 1 if bad else 0
            longest = max(longest, run)
        state.update((run, longest, last, late))
        yield pd.DataFrame({"key": [name[0]], "longest": [longest], "late": [late]})

    rows = events.select(F.col(key).alias("k"), _place(events, order).alias("p"), F.coalesce(failed, F.lit(False)).alias("f"))
    return rows.groupBy("k").applyInPandasWithState(fold, f"key {kind}, longest int, late int", "run int, longest int, last double, late int", "update", GroupStateTimeout.NoTimeout)


def _place(df: DataFrame, order: str) -> Column:
    """A place in an order of numbers or times as a number."""
    kind = df.schema[order].dataType.typeName()
    column = F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(order)
    return column.cast("double")


def _in_order(rows: pd.DataFrame, last: float | None) -> tuple[pd.DataFrame, float | None]:
    """The rows that don't stand before ``last``, in order, and the last place now."""
    fresh = rows[rows["p"].notna() & (rows["p"] >= (float("-inf") if last is None else last))].sort_values("p", kind="stable")
    return fresh, float(fresh["p"].iloc[-1]) if len(fresh) else last


def threshold_skips(steps: DataFrame, key: str, order: str, distance: str, threshold: float) -> DataFrame:
    """``(key, order, skip)``: accumulate distances until the threshold, then compute and start again. The
    first step of a key is always computed. A step that comes after later ones were decided has no place
    in the sum: its ``skip`` is null."""
    kinds = events_types(steps, [key, order])

    def fold(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).reset_index(drop=True)
        fresh, last = _in_order(rows, last)
        skips = pd.Series([None] * len(rows), dtype=object)
        for i, d in fresh["d"].items():
            first = total is None
            total = 0.0 if first else total + (0.0 if pd.isna(d) else d)
            skip = not first and total < threshold
            total = total if skip else 0.0
            skips[i] = skip
        state.update((total, last))
        yield pd.DataFrame({"key": name[0], "o": rows["o"].to_numpy(), "skip": skips.astype("boolean")})

    rows = steps.select(F.col(key).alias("k"), F.col(order).alias("o"), _place(steps, order).alias("p"), F.col(distance).cast("double").alias("d"))
    return rows.groupBy("k").applyInPandasWithState(fold, f"key {kinds[0]}, o {kinds[1]}, skip boolean", "total double, last double", "append", GroupStateTimeout.NoTimeout)


def events_types(df: DataFrame, columns: list[str]) -> list[str]:
    return [df.schema[c].dataType.simpleString() for c in columns]


def append_metrics(df: DataFrame, path: str, checkpoint: str):
    """Append a metric stream to a table, exactly once; all that is there, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available and return what it put out, for bounded runs. Every micro-batch is
    written as files under the checkpoint's folder, in place of an earlier attempt at the same one, so the
    output never passes through the driver."""
    path = f"{checkpoint}-out/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    write(spark.createDataFrame([], df.schema), -1)  # a stream without rows has a result, too
    return spark.read.schema(df.schema).option("basePath", path).parquet(f"{path}/batch=*").select(df.columns)


def upsert(path_of: str, key: str):
    """A ``foreachBatch`` function that keeps one row per key, the longest text, in versions under a folder."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.select(key, "text")
        if number:
            now = now.unionByName(spark.read.parquet(f"{path_of}/v{number - 1}"))
        now.groupBy(key).agg(F.max_by("text", F.length("text")).alias("text")).write.mode("overwrite").parquet(f"{path_of}/v{number}")

    return write
