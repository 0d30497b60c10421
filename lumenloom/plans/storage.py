"""Queries on sources and sinks: each writes a table in some file form into the shared folder and reads it back."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloom.functions import text as X
from lumenloom.operators import vectors
from lumenloom.plans.corpus import coverage_pivot
from lumenloom.plans.numbers import WIDTH, _stream
from lumenloom.plans.registry import _SQL, query
from lumenloom.session import read_table, working_dir
from lumenloom.sources import files
from lumenloom.sources.http_lines import JsonLines
from lumenloom.streaming import streams

_RECORD = T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("text", "source", "lang"))])


def _place(spark: SparkSession, name: str) -> str:
    """A new folder for files."""
    return f"{working_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lang_samples").select("sample_id", "lang", F.col("sample_text").alias("text"))


@query("SELECT row_id, text, source, lang FROM metadata_10")
def jsonl_round_trip(spark, folder):
    """JSON lines written and read; a second write that ignores what is there changes nothing."""
    rows, path = read_table(spark, folder, "metadata_10").select(_RECORD.names), _place(spark, "jsonl")
    files.write_jsonl(rows, path)
    files.write_jsonl(rows.limit(0), path, "ignore")
    return files.read_jsonl(spark, path, _RECORD)


@query("SELECT text, subject, style, camera, source, lang FROM metadata_10")
def json_array_round_trip(spark, folder):
    path = _place(spark, "array")
    files.write_json_array(read_table(spark, folder, "metadata_10").select("text", "subject", "style", "camera", "source", "lang"), path)
    return files.read_json_array(spark, path)


@query("SELECT item_id, text FROM benchmark_stage")
def parquet_fallback(spark, folder):
    """The first path of a list that can be read."""
    return files.read_parquet_first(spark, [f"{folder}/benchmark_of_another_name.parquet", f"{folder}/benchmark_stage.parquet"]).select("item_id", "text")


@query("SELECT raw_id, text, source, CASE WHEN lang = 'zh' THEN NULL ELSE lang END AS lang FROM raw_harvest")
def parquet_shards(spark, folder):
    """Shards by name, one without the language, one that is no Parquet."""
    path, rows = _place(spark, "shards"), read_table(spark, folder, "raw_harvest").select("raw_id", "text", "source", "lang")
    rows.where("lang = 'zh'").drop("lang").write.parquet(f"{path}/a")
    rows.where("lang is distinct from 'zh'").write.parquet(f"{path}/b")
    files.write_bytes(spark, f"{path}/c/part.parquet", b"not Parquet")
    found, bad = files.read_parquet_shards(spark, [f"{path}/{n}" for n in "abc"], rows.columns)
    assert bad == [f"{path}/c"]
    return found


@query("SELECT raw_id FROM (SELECT raw_id, text FROM raw_harvest ORDER BY raw_id, harvested_at, text LIMIT 1000) WHERE length(text) >= 40")
def budget_before_filter(spark, folder):
    """A row budget of the input, then the filter: the budget is the feature."""
    first = files.budgeted(read_table(spark, folder, "raw_harvest").select("raw_id", "text", "harvested_at"), [F.col("raw_id"), F.col("harvested_at"), F.col("text")], 1000)
    return first.where(F.char_length("text") >= 40).select("raw_id")


@query("SELECT sample_text AS text FROM lang_samples")
def url_lines(spark, folder):
    """JSON lines behind URLs, one task a URL."""
    path = _place(spark, "urls")
    files.write_jsonl(_samples(spark, folder).repartition(3, "lang"), path)
    spark.dataSource.register(JsonLines)
    return spark.read.format("jsonl_urls").option("urls", ",".join(files.files_below(spark, path, ".json"))).load().select("text")


@query("SELECT lang || '.json' AS file, sample_text AS prompt FROM lang_samples")
def zip_prompts(spark, folder):
    """A zip of JSON lists, one a language (a fixed table of some hundred texts)."""
    lists: dict[str, list] = {}
    for r in _samples(spark, folder).orderBy("sample_id").collect():
        lists.setdefault(r["lang"], []).append({"prompt": r["text"]} if r["sample_id"] % 2 else {"combined_prompt": r["text"]})
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        for lang, prompts in lists.items():
            archive.writestr(f"{lang}.json", json.dumps({"data_list": prompts} if lang < "es" else prompts))
        archive.writestr("broken.json", "{")
    path = _place(spark, "zip") + "/prompts.zip"
    files.write_bytes(spark, path, content.getvalue())
    return files.read_zip_json(spark, path)


@query("SELECT text, 'bench' AS source, coalesce(language, 'en') AS lang FROM benchmark_stage UNION ALL SELECT sample_text, 'samples', lang FROM lang_samples")
def registry_harvest(spark, folder):
    """A registry of sources: one falls back to its second reader, one fails and doesn't stop the others."""
    sources = files.Sources()
    sources.add("bench", lambda s: s.read.parquet(f"{folder}/bench_v2.parquet"), lambda s: read_table(s, folder, "benchmark_stage"))
    sources.add("samples", lambda s: _samples(s, folder))
    sources.add("gone", lambda s: s.read.parquet(f"{folder}/gone.parquet"))
    rows, failed = sources.harvest(spark)
    assert list(failed) == ["gone"]
    return rows


@query("SELECT 'source-' || lang || '.jsonl' AS file, count(*) AS n, sum(length(sample_text))::BIGINT AS size FROM lang_samples GROUP BY 1")
def directory_scan(spark, folder):
    """All JSON lines of a folder, with the file each comes from."""
    path, rows = _place(spark, "folder"), _samples(spark, folder).collect()  # a fixed table of some hundred texts
    for lang in {r["lang"] for r in rows}:
        lines = [json.dumps({"text": r["text"], "source": "samples", "lang": lang}, ensure_ascii=False) for r in rows if r["lang"] == lang]
        files.write_bytes(spark, f"{path}/source-{lang}.jsonl", ("\n".join(lines) + "\n").encode())
    return files.read_directory(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("size"))


@query("SELECT trim(sample_text) AS text FROM lang_samples")
def prompt_lines(spark, folder):
    """Plain text lines, trimmed, blank ones dropped."""
    path = _place(spark, "lines")
    rows = _samples(spark, folder).select(F.explode(F.array(F.concat(F.lit("  "), "text"), F.lit(" "))).alias("value"))
    rows.write.text(path)
    return files.read_prompts(spark, path)


@query("SELECT sample_text AS text FROM lang_samples")
def prompt_list(spark, folder):
    """A JSON list of objects with a prompt or a text."""
    path, rows = _place(spark, "list"), _samples(spark, folder)
    odd = F.pmod("sample_id", F.lit(2)) == 1
    files.write_json_array(rows.select(F.when(odd, F.col("text")).alias("text"), F.when(~odd, F.col("text")).alias("prompt")).coalesce(1), path)
    return files.prompts_of(spark, None, files.files_below(spark, path)[0], [])


@query("SELECT run_id AS commit, kid_mean, kid_std AS peak_vram_gb, CASE WHEN kid_mean IS NULL THEN 'crash' ELSE 'keep' END AS status, 'step ' || step AS description FROM eval_results")
def ledger_rows(spark, folder):
    """A tab-separated ledger with a header."""
    path, rows = _place(spark, "ledger"), read_table(spark, folder, "eval_results")
    status = F.when(F.col("kid_mean").isNull(), "crash").otherwise("keep")
    rows.select(F.col("run_id").alias("commit"), "kid_mean", F.col("kid_std").alias("peak_vram_gb"), status.alias("status"), F.concat(F.lit("step "), "step").alias("description")).write.csv(path, sep="\t", header=True)
    return files.read_ledger(spark, path)


def coverage_file(spark, folder):
    """The coverage table as CSV, one file."""
    path, rows = _place(spark, "coverage"), coverage_pivot(spark, folder)
    files.write_coverage(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True, nullValue=files.NO_CODE)


query(_SQL["coverage_pivot"])(coverage_file)


@query("SELECT DISTINCT path, lower(md5) AS md5 FROM manifest_files")
def manifest_lines(spark, folder):
    """A manifest's lines with the checksum before or behind the path, or none, and comments."""
    path, rows = _place(spark, "manifest"), read_table(spark, folder, "manifest_files").distinct()
    line = F.when(F.length("path") % 2 == 0, F.concat_ws("  ", "md5", "path")).otherwise(F.concat_ws(" ", "path", "md5"))
    rows.select(F.explode(F.array(F.lit("# files"), line, F.lit(""))).alias("value")).write.text(path)
    return files.read_manifest(spark, path)


@query("SELECT code || '.json' AS path, md5(label) AS md5 FROM taxonomy WHERE axis <> 'camera'")
def manifest_written(spark, folder):
    """The essential files of a folder with their checksums, written as a manifest and read again."""
    path = _place(spark, "essential")
    for r in read_table(spark, folder, "taxonomy").collect():  # a fixed table of some tens of rows
        files.write_bytes(spark, f"{path}/{r['code']}.{'txt' if r['axis'] == 'camera' else 'json'}", r["label"].encode())
    files.write_manifest(files.listing(spark, path), ["S*.json", "T*.json"], f"{path}-manifest")
    return files.read_manifest(spark, f"{path}-manifest")


@query("SELECT code || '.png' AS name, CASE WHEN axis = 'style' THEN [0.0::DOUBLE, 0.0] ELSE [ascii(code)::DOUBLE, ord::DOUBLE] END AS pixels FROM taxonomy WHERE axis <> 'camera'")
def image_folder(spark, folder):
    """PNG files of a folder: empty ones are passed over, one that can't be decoded is black."""
    path = _place(spark, "images")
    for r in read_table(spark, folder, "taxonomy").collect():  # a fixed table of some tens of rows
        content = {"camera": b"", "style": b"x", "subject": bytes([ord(r["code"][0]), r["ord"]])}[r["axis"]]
        files.write_bytes(spark, f"{path}/{r['code']}.png", content)
    return files.read_images(spark, path, lambda b: [b[0], b[1]], 2)


@query("SELECT vec_id, label::INT AS label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, '64' AS width FROM embeddings")
def vector_bundle(spark, folder):
    """Vectors in a folder for each label, with their facts beside them."""
    path = _place(spark, "vectors")
    files.write_vectors(read_table(spark, folder, "embeddings"), path, {"width": str(WIDTH), "model": "none"}, ["label"])
    rows, about = files.read_vectors(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", F.col("label").cast("int").alias("label"), F.round(total, 5).alias("total"), F.lit(about["width"]).alias("width"))


@query("""
WITH l AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings)
SELECT i::INT AS i, round(avg(x), 6) + 0.0 AS mu, round(var_samp(x), 6) + 0.0 AS variance, count(*) AS num_samples FROM l GROUP BY i""")
def moments_file(spark, folder):
    """Mean, covariance and number of samples in one row, read again."""
    path, rows = _place(spark, "moments"), read_table(spark, folder, "embeddings")
    mean = vectors.centroids(rows, "embedding", []).collect()[0]["centroid"]  # one vector
    files.write_moments(mean, vectors.covariance(rows, "embedding", WIDTH), rows.count(), path)
    each = spark.read.parquet(path).select(F.posexplode("mu").alias("i", "m"), "sigma", "num_samples")
    variance = F.element_at(F.element_at("sigma", F.col("i") + 1), F.col("i") + 1)
    return each.select("i", (F.round("m", 6) + 0.0).alias("mu"), (F.round(variance, 6) + 0.0).alias("variance"), "num_samples")


@query("SELECT run_id, step, kid_mean, kid_mean IS NULL AS failed FROM eval_results")
def results_log(spark, folder):
    """Results appended to one table, batch by batch."""
    path, rows = _place(spark, "results"), read_table(spark, folder, "eval_results").select("run_id", "step", "kid_mean")
    for failed in (False, True):
        mine = F.col("kid_mean").isNull() == failed
        files.append_results(rows.where(mine).withColumn("failed", F.lit(failed)), path)
    return spark.read.parquet(path)


@query("SELECT row_id, upper(trim(subject)) AS subject, false AS stale FROM metadata_10")
def newest_version(spark, folder):
    """A new version beside the old one; what was derived from the old one goes. Readers take the newest."""
    path, rows = _place(spark, "versions"), read_table(spark, folder, "metadata_10").select("row_id", "subject")
    files.write_version(rows, path, "v-1")
    rows.groupBy("subject").count().write.parquet(f"{path}-index")
    files.replace_version(rows.withColumn("subject", F.upper(F.trim("subject"))), path, "v-2", [f"{path}-index"])
    names = spark.createDataFrame([(p.rpartition("/")[2],) for p in files.files_below(spark, path)], "name string")
    newest = files.latest(names).collect()[0]["name"]
    index = path.rpartition("/")[2] + "-index"
    stale = any(p.rpartition("/")[2] == index for p in files.files_below(spark, working_dir(spark)))
    return spark.read.parquet(f"{path}/{newest}").withColumn("stale", F.lit(stale))


@query("SELECT run_id, step, kid_mean, kid_std FROM eval_results")
def metrics_stream(spark, folder):
    """A stream of metrics appended to a table, started twice: each row once."""
    path = _place(spark, "metrics")
    for _ in range(2):
        streams.append_metrics(_stream(spark, folder, "eval_results").select("run_id", "step", "kid_mean", "kid_std"), path, f"{path}-offsets").awaitTermination()
    return spark.read.parquet(path)


@query("SELECT row_id, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS chat FROM metadata_10")
def chat_prompts(spark, folder):
    return read_table(spark, folder, "metadata_10").select("row_id", X.chat(F.col("text")).alias("chat"))


@query(r"""
WITH w AS (SELECT row_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: length(w)::INT) AS ids FROM metadata_10 WHERE text IS NOT NULL)
SELECT row_id, list_transform(range(1, 25), lambda i: coalesce(ids[i], 0)) AS ids FROM w""")
def fitted_ids(spark, folder):
    """Arrays of ids (here the words' lengths) cut or padded to 24."""
    rows = read_table(spark, folder, "metadata_10").where("text is not null")
    words = F.filter(F.split("text", r"[\s]+"), lambda w: w != "")
    return rows.select("row_id", X.fit_length(F.transform(words, lambda w: F.char_length(w)), 24).alias("ids"))


@query("SELECT row_id, text, source FROM metadata_10 WHERE text IS NOT NULL AND source IS NOT NULL")
def upserted_versions(spark, folder):
    """One row a key, kept over two batches in versions under a folder."""
    path = _place(spark, "upsert")
    rows = read_table(spark, folder, "metadata_10").where("text is not null and source is not null").select("row_id", "text", "source")
    write = streams.upsert(path, "row_id")
    write(rows.withColumn("text", F.lit("")), 0)
    write(rows, 1)
    return spark.read.parquet(f"{path}/v1").join(rows.select("row_id", "source"), "row_id").select("row_id", "text", "source")
