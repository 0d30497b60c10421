import json
import zipfile

import pytest

from lumenloom import schema
from lumenloom.sources import files
from lumenloom.sources.http_lines import JsonLines


def test_jsonl_round_trip(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "été", "source": "a", "lang": "fr"}\n\n{"text": "x"}\nnot json\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r["text"] for r in rows.collect()) == ["x", "été"]
    files.write_jsonl(rows, str(tmp_path / "out"))
    assert "été" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    files.write_jsonl(rows.limit(0), str(tmp_path / "out"), "ignore")
    assert files.read_jsonl(spark, str(tmp_path / "out")).count() == 2


def test_json_array(spark, tmp_path):
    path = tmp_path / "a"
    df = spark.createDataFrame([("t", "S1", "T1", "C1", "s", "en"), ("u", None, "T1", "C1", "s", "en")], schema.CURATED)
    files.write_json_array(df.coalesce(1), str(path))
    (part,) = path.glob("part-*")
    assert [r["text"] for r in json.loads(part.read_text())] == ["t", "u"]
    files.write_json_array(df.limit(0), str(tmp_path / "none"))
    assert files.read_json_array(spark, str(tmp_path / "none")).count() == 0
    assert files.read_json_array(spark, str(path)).where("subject is null").count() == 1


def test_parquet_fallbacks(spark, tmp_path):
    spark.createDataFrame([("a", "s")], "text string, source string").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([("b", 3)], "text string, extra int").write.parquet(str(tmp_path / "two"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"not parquet")
    assert files.read_parquet_first(spark, [str(tmp_path / "none"), str(tmp_path / "one")]).count() == 1
    df, bad = files.read_parquet_shards(spark, [str(tmp_path / n) for n in ("one", "bad", "two")], ["text", "source"])
    assert df.count() == 2 and bad == [str(tmp_path / "bad")]
    with pytest.raises(FileNotFoundError):
        files.read_parquet_first(spark, [str(tmp_path / "none")])


def test_zip_of_json(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.json", json.dumps({"data_list": [{"prompt": "p"}, {"combined_prompt": "c"}, {}]}))
        z.writestr("b.json", json.dumps(["s", ""]))
        z.writestr("c.json", "broken")
        z.writestr("d.txt", "no")
    assert sorted(r["prompt"] for r in files.read_zip_json(spark, str(tmp_path / "a.zip")).collect()) == ["c", "p", "s"]


def test_prompts(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" one \n\n two\n")
    assert [r["text"] for r in files.read_prompts(spark, str(tmp_path / "p.txt")).collect()] == ["one", "two"]
    (tmp_path / "e.txt").write_text("\n \n")
    with pytest.raises(ValueError):
        files.read_prompts(spark, str(tmp_path / "e.txt"))
    (tmp_path / "p.json").write_text(json.dumps([{"text": "a"}, {"prompt": "b"}]))
    assert sorted(r["text"] for r in files.prompts_of(spark, None, str(tmp_path / "p.json"), []).collect()) == ["a", "b"]
    (tmp_path / "q.json").write_text(json.dumps(["a", "b"]))
    assert sorted(r["text"] for r in files.prompts_of(spark, None, str(tmp_path / "q.json"), []).collect()) == ["a", "b"]
    assert files.prompts_of(spark, ["x"], None, ["d"]).collect()[0]["text"] == "x"
    assert files.prompts_of(spark, None, None, ["d"]).collect()[0]["text"] == "d"


def test_ledger_and_manifest(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("commit\tkid_mean\tpeak_vram_gb\tstatus\tdescription\nabc\t0.5\t66.7\tkeep\tfirst, try\n")
    (row,) = files.read_ledger(spark, str(tmp_path / "l.tsv")).collect()
    assert row["kid_mean"] == 0.5 and row["description"] == "first, try"
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a").write_bytes(b"aa")
    (folder / "b").write_bytes(b"bb")
    (folder / "c").write_bytes(b"cc")
    import hashlib

    good = hashlib.md5(b"aa").hexdigest()
    (tmp_path / "m.txt").write_text(f"# files\n{good} a\nb {'0' * 32}\n\nc\nd {good}\n")
    manifest = files.read_manifest(spark, str(tmp_path / "m.txt"))
    got = {r["path"]: r["status"] for r in files.verify_manifest(manifest, files.listing(spark, str(folder))).collect()}
    assert got == {"a": "ok", "b": "corrupted", "c": "ok", "d": "missing"}


def test_directory_images_versions(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"{n}.jsonl").write_text(json.dumps({"text": n}) + "\n")
    assert sorted(r["file"] for r in files.read_directory(spark, str(tmp_path)).collect()) == ["a.jsonl", "b.jsonl"]
    (tmp_path / "00001.png").write_bytes(b"\x01\x02")
    (tmp_path / "00002.png").write_bytes(b"")
    (tmp_path / "00003.png").write_bytes(b"x")
    got = {r["name"]: r["pixels"] for r in files.read_images(spark, str(tmp_path), lambda b: [b[0], b[1]], 2).collect()}
    assert got == {"00001.png": [1.0, 2.0], "00003.png": [0.0, 0.0]}
    df = spark.range(3)
    assert files.write_version(df, str(tmp_path / "v"), "1").endswith("/1")
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_version(df, str(tmp_path / "v"), "1")


def test_registry_isolates_failures(spark):
    sources = files.Sources()
    sources.add("good", lambda s: s.createDataFrame([("t", "de")], "text string, language string"))
    sources.add("bad", lambda s: s.read.parquet("/nowhere"))
    df, failed = sources.harvest(spark)
    assert [tuple(r) for r in df.collect()] == [("t", "good", "de")] and list(failed) == ["bad"]
    sources.add("second", lambda s: s.read.parquet("/nowhere"), lambda s: s.createDataFrame([], "text string"), lambda s: s.createDataFrame([("u",)], "text string"))
    assert [r["text"] for r in sources.read(spark, "second").collect()] == ["u"]
    with pytest.raises(LookupError):
        sources.read(spark, "unknown")


def test_url_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "p"}\n\nbroken\n{"text": "t"}\n')
    spark.dataSource.register(JsonLines)
    df = spark.read.format("jsonl_urls").option("urls", f"file://{tmp_path}/a.jsonl").load()
    assert sorted(r["text"] for r in df.collect()) == ["p", "t"]


def test_vector_bundle_and_moments(spark, tmp_path):
    from lumenloom.operators import vectors

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [0.0, 1.0])], "row_id bigint, v array<double>")
    files.write_vectors(df, str(tmp_path / "b"), {"embed_dim": "2", "source": "made up"})
    back, about = files.read_vectors(spark, str(tmp_path / "b"))
    assert back.count() == 3 and about == {"embed_dim": "2", "source": "made up"}
    files.write_moments([4 / 3, 8 / 3], vectors.covariance(df, "v", 2), 3, str(tmp_path / "m"))
    (row,) = spark.read.parquet(str(tmp_path / "m")).collect()
    assert row["num_samples"] == 3 and len(row["sigma"]) == 2 and abs(row["sigma"][0][1] - row["sigma"][1][0]) < 1e-12
    for step in (1, 2):
        files.append_results(spark.createDataFrame([(step, 0.1)], "step int, kid_mean double"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    names = spark.createDataFrame([("checkpoint-9",), ("checkpoint-10",), ("best",)], "name string")
    assert [r["name"] for r in files.latest(names).collect()] == ["checkpoint-10"]


def test_a_bad_page_ends_only_its_shard(spark, tmp_path):
    spark.createDataFrame([(str(i),) for i in range(50)], "text string").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(str(i), "x" * 99) for i in range(5000)], "text string, source string").coalesce(1).write.parquet(str(tmp_path / "b"))
    (part,) = (tmp_path / "b").glob("*.parquet")
    data = bytearray(part.read_bytes())
    data[4:200] = bytes(196)
    part.write_bytes(data)
    (tmp_path / "b" / f".{part.name}.crc").unlink(missing_ok=True)
    rows, bad = files.read_parquet_shards(spark, [str(tmp_path / "a"), str(tmp_path / "b")], ["text"])
    assert rows.count() >= 50 and not bad


def test_manifest_is_written_and_versions_drop_what_was_derived(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    for name in ("b.bin", "a.json", "skip.txt"):
        files.write_bytes(spark, str(folder / name), name.encode())
    files.write_manifest(files.listing(spark, str(folder)), ["*.json", "*.bin"], str(tmp_path / "m"))
    found = files.read_manifest(spark, str(tmp_path / "m"))
    assert [r["path"] for r in found.collect()] == ["a.json", "b.bin"]
    assert {r["status"] for r in files.verify_manifest(found, files.listing(spark, str(folder))).collect()} == {"ok"}
    (tmp_path / "index").mkdir()
    files.replace_version(spark.range(2), str(tmp_path / "v"), "1", [str(tmp_path / "index")])
    assert not (tmp_path / "index").exists() and (tmp_path / "v" / "1").exists()
