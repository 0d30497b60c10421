import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenloom.streaming import streams

TINY = "/root/testdata/sf0.001"


def stream(spark, tmp_path, rows, shape, parts=3):
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, shape).repartition(parts).write.parquet(folder)
    return spark.readStream.schema(shape).parquet(folder)


def test_threshold_skips_over_batches(spark, tmp_path):
    rows = [("u", i, d) for i, d in enumerate([9.0, 1.0, 1.0, 1.5, 1.0])]
    df = streams.threshold_skips(stream(spark, tmp_path, rows, "k string, i int, d double", 1), "k", "i", "d", 3.0)
    got = streams.run_available(df, "skips", "append", str(tmp_path / "c")).orderBy("o").collect()
    assert [r["skip"] for r in got] == [False, True, True, False, True]


def test_streaks(spark, tmp_path):
    rows = [("u", i, f) for i, f in enumerate([True, True, False, True, None, True])] + [("v", 0, False)]
    df = streams.failure_streaks(stream(spark, tmp_path, rows, "k string, i int, f boolean", 1), "k", "i", F.col("f"))
    got = streams.run_available(df, "streaks", "update", str(tmp_path / "c")).groupBy("key").agg(F.max("longest").alias("n")).collect()
    assert {r["key"]: r["n"] for r in got} == {"u": 2, "v": 0}


def test_metrics_are_appended_once(spark, tmp_path):
    source = stream(spark, tmp_path, [(1, 0.5), (2, 0.4)], "step int, kid double")
    for _ in range(2):
        streams.append_metrics(source, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_upsert_keeps_the_longest(spark, tmp_path):
    write = streams.upsert(str(tmp_path / "v"), "k")
    write(spark.createDataFrame([("a", "x"), ("b", "yy")], "k string, text string"), 0)
    write(spark.createDataFrame([("a", "xxx"), ("b", "y")], "k string, text string"), 1)
    assert {r["k"]: r["text"] for r in spark.read.parquet(str(tmp_path / "v/v1")).collect()} == {"a": "xxx", "b": "yy"}


def test_late_rows_are_dropped_from_closed_windows(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(day + dt.timedelta(hours=h), "a", 1.0) for h in (0, 1, 30, 60)]
    df = streams.windowed_counts(stream(spark, tmp_path, rows, "ts timestamp_ntz, kind string, value double", 1), "ts", ["kind"], F.window("ts", "1 day"), "1 hour")
    got = streams.run_available(df, "windows", "append", str(tmp_path / "c")).orderBy("start").collect()
    assert [r["n"] for r in got] == [2, 1]


def later(spark, tmp_path, batches, shape):
    """A stream of the batches, one micro-batch each."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(folder))
        for part in folder.glob("part-*"):
            if not part.name.startswith("part-0000x"):
                part.rename(folder / f"part-0000x{i}.parquet")
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))


def test_rows_that_come_late_are_not_folded_as_newest(spark, tmp_path):
    shape = "k string, i int, f boolean, d double"
    batches = [[("u", 1, True, 1.0), ("u", 5, True, 1.0)], [("u", 3, False, 9.0), ("u", 5, True, 1.0), ("u", None, True, 1.0)], [("u", 6, True, 1.0)]]
    source = later(spark, tmp_path, batches, shape)
    found = streams.run_available(streams.failure_streaks(source, "k", "i", F.col("f")), "late", "update", str(tmp_path / "c"))
    assert max((r["longest"], r["late"]) for r in found.collect()) == (4, 2)
    skips = streams.run_available(streams.threshold_skips(source, "k", "i", "d", 2.5), "skips", "append", str(tmp_path / "d")).collect()
    assert sorted((str(r["o"]), r["skip"]) for r in skips if r["o"] in (1, 6)) == [("1", False), ("6", False)]
    assert [r["skip"] for r in skips if r["o"] in (3, None)] == [None, None]


def test_a_stream_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("k string, i int").parquet(str(tmp_path / "in"))
    assert streams.run_available(source, "none", "append", str(tmp_path / "c")).count() == 0


@pytest.mark.parametrize(("name", "table"), [("metrics_stream", "eval_results"), ("streamed_tumbling", "events"), ("streamed_dedup", "events")])
def test_a_stream_of_a_table_in_parts(spark, tmp_path, name, table):
    spark.read.parquet(f"{TINY}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    query = entry.queries()[name]
    expected = sorted(map(str, query(spark, TINY).collect()))
    assert expected and sorted(map(str, query(spark, str(tmp_path)).collect())) == expected
