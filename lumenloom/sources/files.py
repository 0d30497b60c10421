"""Readers and writers of the corpus's file forms, all with explicit schemas."""

from __future__ import annotations

import fnmatch
import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloom import schema
from lumenloom.functions.text import strip


def read_jsonl(spark: SparkSession, path: str, fields: T.StructType = schema.RAW) -> DataFrame:
    """One record a line; blank lines and lines that aren't JSON objects are left out."""
    shape = T.StructType([*fields, T.StructField("_bad", T.StringType())])
    record = F.from_json("value", shape, {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).where(strip(F.col("value")) != "").select(record.alias("_r")).where("_r._bad is null").select([F.col(f"_r.{f.name}") for f in fields])


def write_jsonl(df: DataFrame, path: str, if_exists: str = "error") -> None:
    """One record a line, UTF-8 unescaped, nulls kept. ``if_exists``: error, ignore (skip what is there) or overwrite."""
    df.write.mode(if_exists).option("ignoreNullFields", "false").json(path)


def read_json_array(spark: SparkSession, path: str, fields: T.StructType = schema.CURATED) -> DataFrame:
    return spark.read.schema(fields).option("multiLine", True).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """JSON arrays, one file for each partition of ``df``, written where the rows are; ``read_json_array`` reads the folder."""
    record = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                out.append(mark + value)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])

    record.mapInArrow(lines, "value string").write.mode("error").text(path)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file of the driver's, on any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()


def files_below(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The files directly in a folder whose names end so, in lexical order, without the markers of a write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = [f.getPath() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(str(f.toString()) for f in found if f.getName().endswith(suffix) and f.getName()[0] not in "._")


def read_parquet_first(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of the paths that can be read."""
    failed = []
    for path in paths:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001 - any unreadable candidate gives way to the next
            failed.append(f"{path}: {type(e).__name__}")
    raise FileNotFoundError("; ".join(failed))


def read_parquet_shards(spark: SparkSession, paths: list[str], columns: list[str]) -> tuple[DataFrame, list[str]]:
    """The union of the shards that can be read, by name, missing columns null; and the paths whose footer can't
    be read. Of a shard with a bad page the rows before it are taken, and the job goes on."""
    out, bad = None, []
    for path in paths:
        try:
            shard = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
        except Exception:  # noqa: BLE001 - a bad shard must not stop the others
            bad.append(path)
            continue
        shard = shard.select(*[F.col(c) if c in shard.columns else F.lit(None).cast("string").alias(c) for c in columns])
        out = shard if out is None else out.unionByName(shard)
    if out is None:
        out = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    return out, bad


def budgeted(df: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """The first ``budget`` rows in input order, before any filter."""
    return df.orderBy(*order).limit(budget)


def read_directory(spark: SparkSession, folder: str, fields: T.StructType = schema.RAW, suffix: str = "*.jsonl") -> DataFrame:
    """All files of a folder with ``file``, for the lexical order of sources."""
    rows = spark.read.schema(fields).option("pathGlobFilter", suffix).json(folder)
    return rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_zip_json(spark: SparkSession, path: str) -> DataFrame:
    """``(file, prompt)`` of zipped JSON files, each a list or {"data_list": [...]} of strings or objects
    with ``prompt`` or ``combined_prompt``. Members that aren't JSON are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prompts = [], []
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(archive.namelist()):
                        if not name.endswith(".json"):
                            continue
                        try:
                            data = json.loads(archive.read(name))
                        except ValueError:
                            continue
                        data = data.get("data_list", []) if isinstance(data, dict) else data
                        for x in data:
                            text = x if isinstance(x, str) else (x.get("prompt") or x.get("combined_prompt") or "") if isinstance(x, dict) else ""
                            if text:
                                names.append(name)
                                prompts.append(text)
            yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "prompt": pa.array(prompts, pa.string())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "file string, prompt string")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text lines, trimmed, blanks dropped; an error if none is left."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("text")).where("text <> ''")
    if rows.isEmpty():
        raise ValueError(f"no prompt in {path}")
    return rows


def prompts_of(spark: SparkSession, given: list[str] | None, path: str | None, default: list[str]) -> DataFrame:
    """Given prompts, else a JSON file's list of strings or of objects with ``text`` or ``prompt``, else the default."""
    if given:
        return spark.createDataFrame([(p,) for p in given], "text string")
    if path:
        raw = spark.read.text(path, wholetext=True)
        each = F.explode(F.from_json("value", "array<string>"))
        cell = raw.select(each.alias("x"))
        inner = F.from_json("x", "text string, prompt string")
        return cell.select(F.coalesce(schema.first_filled(inner["text"], inner["prompt"]), F.lit("")).alias("t"), "x").select(F.when(F.col("t") != "", F.col("t")).otherwise(F.col("x")).alias("text"))
    return spark.createDataFrame([(p,) for p in default], "text string")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.LEDGER).csv(path, sep="\t", header=True)


#: How a null is written in the coverage file; an empty code stays an empty string.
NO_CODE = "\\N"


def write_coverage(pivot: DataFrame, path: str) -> None:
    pivot.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue=NO_CODE, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)  # one row a subject


def parse_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(path, md5)``: lines of one or two columns in either order; comments and blank lines dropped."""
    line = strip(F.col(column))
    part = F.split(line, r"\s+")
    a, b = F.get(part, 0), F.get(part, 1)
    digest = "^[0-9a-fA-F]{32}$"
    kept = lines.where((line != "") & ~F.startswith(line, F.lit("#")))
    return kept.select(F.when(a.rlike(digest) & b.isNotNull(), b).otherwise(a).alias("path"), F.when(a.rlike(digest) & b.isNotNull(), F.lower(a)).when(b.rlike(digest), F.lower(b)).alias("md5"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, found)``: the files below a folder that match, with the md5 of their content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    return rows.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("^\\Q" + root + "\\E/"), F.lit("")).alias("path"), F.md5("content").alias("found"))


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """``(path, status)``: missing, corrupted (a listed checksum differs) or ok; listed twice counts once."""
    joined = manifest.distinct().join(found.distinct().withColumn("_there", F.lit(True)), "path", "left")
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("md5").isNotNull() & ~F.col("found").eqNullSafe(F.col("md5")), "corrupted").otherwise("ok")
    return joined.select("path", status.alias("status")).distinct()


def read_images(spark: SparkSession, folder: str, decode: Callable[[bytes], list[float]], width: int) -> DataFrame:
    """``(name, pixels)`` of the non-empty PNG files of a folder; what ``decode`` can't read gives zeros."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).where("length > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                try:
                    out.append([float(x) for x in decode(content)])
                except Exception:  # noqa: BLE001 - a corrupt image is a black one
                    out.append([0.0] * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["name", "pixels"])

    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, "name string, pixels array<double>")


def write_version(df: DataFrame, folder: str, version: str) -> str:
    """Write a new version beside the old ones; readers follow the newest name, nothing is overwritten."""
    path = f"{folder.rstrip('/')}/{version}"
    df.write.mode("error").parquet(path)
    return path


def replace_version(df: DataFrame, folder: str, version: str, derived: list[str]) -> str:
    """A new version, and away with what was derived from the old one (folders that must be made anew)."""
    path = write_version(df, folder, version)
    spark = df.sparkSession
    for stale in derived:
        target = spark._jvm.org.apache.hadoop.fs.Path(stale)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return path


def write_manifest(found: DataFrame, patterns: list[str], path: str) -> None:
    """Lines ``md5  path`` of the listed files that match one of the globs, in the order of their paths."""
    wanted = F.lit(False)
    for pattern in patterns:
        wanted = wanted | F.col("path").rlike(fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$"))
    lines = found.where(wanted).repartitionByRange(1, "path").sortWithinPartitions("path")  # a manifest is one file
    lines.select(F.concat_ws("  ", "found", "path").alias("value")).write.mode("error").text(path)


class Sources:
    """A registry of named readers, each with others to fall back on (another configuration, another split);
    a source that fails doesn't stop the others."""

    def __init__(self) -> None:
        self.readers: dict[str, tuple[Callable[[SparkSession], DataFrame], ...]] = {}

    def add(self, name: str, *readers: Callable[[SparkSession], DataFrame]) -> None:
        self.readers[name] = readers

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """What the first of a source's readers gives that gives anything."""
        error: Exception = LookupError(name)
        for reader in self.readers.get(name, ()):
            try:
                found = reader(spark)
                if not found.isEmpty():
                    return found
                error = LookupError(f"{name}: nothing there")
            except Exception as e:  # noqa: BLE001 - any failure gives way to the next
                error = e
        raise error

    def harvest(self, spark: SparkSession, wanted: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
        """The union of the sources (text, source, lang), and the error of each that failed."""
        out, failed = spark.createDataFrame([], schema.RAW), {}
        for name in wanted or sorted(self.readers):
            try:
                out = out.unionByName(schema.normalise(self.read(spark, name)).withColumn("source", F.lit(name)).select("text", "source", "lang"))
            except Exception as e:  # noqa: BLE001
                failed[name] = f"{type(e).__name__}: {e}"[:200]
        return out, failed


def write_vectors(df: DataFrame, path: str, about: dict[str, str], by: list[str] | None = None) -> None:
    """A vector bundle: the rows as Parquet, in a folder for each value of ``by`` if given, and beside them
    rows of facts (width, model, source)."""
    df.write.mode("error").partitionBy(*by or []).parquet(f"{path.rstrip('/')}/vectors")
    facts = [(str(k), str(v)) for k, v in sorted(about.items())]
    df.sparkSession.createDataFrame(facts, "key string, value string").coalesce(1).write.mode("error").json(f"{path.rstrip('/')}/about")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    about = spark.read.schema("key string, value string").json(f"{path.rstrip('/')}/about")
    return spark.read.parquet(f"{path.rstrip('/')}/vectors"), {r["key"]: r["value"] for r in about.collect()}


def write_moments(mean: list[float], cov: DataFrame, rows: int, path: str) -> None:
    """Summary statistics as one row: mean, covariance (i, j, cov) as nested arrays, number of rows."""
    lines = cov.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "cov"))), lambda s: s["cov"]).alias("line"))
    one = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]).alias("sigma"))
    one.select(F.array(*[F.lit(float(x)) for x in mean]).alias("mu"), "sigma", F.lit(rows).cast("bigint").alias("num_samples")).write.mode("error").parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    """Results of a step, appended to the table of all steps."""
    results.write.mode("append").parquet(path)


def latest(names: DataFrame, column: str = "name") -> DataFrame:
    """The name with the largest numeric suffix."""
    from lumenloom.operators.runlog import keep_last

    return keep_last(names, column, 1)
