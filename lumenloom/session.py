"""Session helpers: a local session for tests and benches, and the shared working folder.

Iterative operators cut lineage by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read it, so a lost executor costs a re-read, not a failure.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-process session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumenloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def working_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the session's ``spark.checkpoint.dir``. Only a local master without that setting gets a
    temporary folder; on a cluster a missing setting is an error, as no machine-local folder is shared.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lumenloom-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends at replicated storage."""
    spark = df.sparkSession
    path = f"{working_dir(spark)}/{label}-{uuid.uuid4().hex}"
    write_table(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenloom_path = path
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


#: Tables that ``materialize`` has written and nobody has deleted, by application.
_written: dict[str, set[str]] = {}


def sweep(spark: SparkSession) -> int:
    """Delete every intermediate table of the session that is still there, and say how many there were.

    For the end of a job: lazy results that read such tables must have been written or collected.
    """
    paths = _written.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df``, in place of what is there; the write's shuffle files are deleted when it is done."""
    with _shuffles_deleted(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` once nothing lazy reads it any more."""
    path = getattr(df, "_lumenloom_path", None)
    if path:
        spark = df.sparkSession
        _delete(spark, path)
        _written.get(spark.sparkContext.applicationId, set()).discard(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
