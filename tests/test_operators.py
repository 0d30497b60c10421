import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenloom.operators import dedup, edits, runlog, sampling, skew, vectors
from lumenloom.operators.components import connected_components
from lumenloom.session import working_dir


def test_exact_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "dog"), (2, "cat"), (1, "Cat "), (4, None), (5, None)], "row_id int, text string")
    assert sorted(r["row_id"] for r in dedup.exact_dedup(df).collect()) == [1, 3, 4]
    assert dedup.exact_dedup(df.limit(0)).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3), (7, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect()}
    assert got == {v: find(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_word_pairs_are_lossless(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.sample("abcdefghijklmnop", rng.randrange(3, 9)))) for i in range(120)] + [(500, None), (501, " ")]
    sets = {i: set(t.split()) for i, t in rows if t and t.strip()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 10 >= 7 * len(sets[a] | sets[b])}
    got = {(r["id_a"], r["id_b"]) for r in dedup.word_pairs(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert got == want


def test_banded_recall(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.sample(words, 30) for _ in range(60)]
    rows = [(2 * i, " ".join(b)) for i, b in enumerate(base)] + [(2 * i + 1, " ".join(b[:29] + ["new"])) for i, b in enumerate(base)]
    got = dedup.banded_groups(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").groupBy("component").agg(F.count("*").alias("n"))
    assert got.where("n = 2").count() >= 57


def test_near_dups_at_the_threshold_are_lossless(spark, tmp_path):
    from lumenloom.plans import registry

    # 14 of 20 items shared: likeness 0.7, which bands find in 44 of 100 cases
    rows = [(2 * i + k, " ".join([f"s{i}x{j}" for j in range(14)] + [f"o{i}x{j}" for j in range(3 * k, 3 * k + 3)])) for i in range(100) for k in (0, 1)]
    spark.createDataFrame(rows, "raw_id bigint, text string").write.parquet(f"{tmp_path}/raw_harvest.parquet")
    got = registry.queries()["banded_near_dups"](spark, str(tmp_path)).groupBy("component").agg(F.count("*").alias("n"))
    assert got.where("n = 2").count() == 100 and got.count() == 100


def test_survivor_is_the_longest(spark):
    df = spark.createDataFrame([(1, "x"), (2, "longer"), (3, "middle"), (4, "alone"), (5, None)], "row_id bigint, text string")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id bigint, component bigint")
    assert sorted(r["row_id"] for r in dedup.survivors(df, groups, "row_id", "text").collect()) == [2, 4, 5]


def test_greedy_lets_a_dead_row_finish_its_round(spark):
    # similarities (0,1) and (0,2) are high, (1,2) is not: row 0 goes to row 1, and still takes row 2 along
    v = [[1.0, 0.0, 0.0], [0.95, 0.31, 0.0], [0.95, -0.31, 0.0]]
    rows = [(0, i, s, x) for i, (s, x) in enumerate(zip([0.2, 0.5, 0.1], v, strict=True))]
    got = dedup.greedy_within(spark.createDataFrame(rows, "cluster int, id bigint, score double, vector array<double>"), 0.9)
    assert [r["id"] for r in got.collect()] == [1]


@pytest.mark.parametrize(("n", "parts"), [(1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (40, (1, 1, 38)), (60, (2, 2, 56)), (100, (2, 2, 96)), (140, (4, 4, 132)), (1000, (25, 25, 950))])
def test_split_sizes(spark, n, parts):
    df = spark.range(n).select(F.col("id").alias("row_id"), F.lit("S1").alias("subject"), F.lit(None).cast("string").alias("style"))
    got = {r["part"]: r["count"] for r in sampling.stratified_split(df, ["subject", "style"], "row_id").groupBy("part").count().collect()}
    assert tuple(got.get(p, 0) for p in ("test", "val", "train")) == parts


def test_stratified_sample_allocation(spark):
    rows = [(i, s) for s, n in (("a", 50), ("b", 30), ("c", 15), ("d", 4), ("e", 1)) for i in range(1000 * ord(s), 1000 * ord(s) + n)]
    df = spark.createDataFrame(rows, "row_id bigint, s string")
    got = {r["s"]: r["count"] for r in sampling.stratified_sample(df, ["s"], "row_id", 10).groupBy("s").count().collect()}
    assert got == {"a": 4, "b": 2, "c": 2, "d": 1, "e": 1}
    assert sampling.stratified_sample(df, ["s"], "row_id", 500).count() == 100
    many = [(i, s) for s, n in (("a", 500), ("b", 300), ("c", 150), ("d", 40), ("e", 1), ("f", 1), ("g", 1), ("h", 1)) for i in range(1000 * ord(s), 1000 * ord(s) + n)]
    assert sampling.stratified_sample(spark.createDataFrame(many, "row_id bigint, s string"), ["s"], "row_id", 10).count() == 10


def test_stratum_rank_is_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("s"))
    ranks = sampling.stratum_rank(df, ["s"], "row_id").toPandas()
    for _, part in ranks.groupby("s"):
        assert sorted(part["_rank"]) == list(range(1, len(part) + 1)) and set(part["_n"]) == {len(part)}


def test_weighted_allocation(spark):
    df = spark.createDataFrame([(i, "S1" if i < 90 else "S2", "T1") for i in range(100)], "row_id int, subject string, style string")
    got = {r["subject"]: r["alloc"] for r in sampling.weighted_allocation(df, ["subject", "style"], 50, 5, 4).collect()}
    assert got == {"S1": 5 + 27, "S2": 5 + 3}
    assert {r["alloc"] for r in sampling.weighted_allocation(df, ["subject", "style"], 100, 5, 4).collect()} == {90, 10}


def test_weighted_pick(spark):
    df = spark.range(20000).select(sampling.weighted_pick(F.col("id"), [("a", 0.7), ("b", 0.2), ("c", 0.1)]).alias("v"))
    got = {r["v"]: r["count"] / 20000 for r in df.groupBy("v").count().collect()}
    assert abs(got["a"] - 0.7) < 0.02 and abs(got["b"] - 0.2) < 0.02 and abs(got["c"] - 0.1) < 0.02


def test_nested_subsets_and_batches(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    got = sampling.nested_subsets(df, "row_id", {"small": 10, "large": 50}).toPandas()
    assert len(got) == 50 and got["small"].sum() == 10 and got["large"].all()
    batched = sampling.batches(df, [F.col("row_id")], 64, drop_last=True).toPandas()
    assert len(batched) == 15 * 64 and (batched["row_id"] // 64 == batched["batch"]).all()


def test_running_best_and_streaks(spark):
    ledger = spark.createDataFrame([("r", i, k) for i, k in enumerate([0.06892, 0.075387, 0.066527, 0.06815, None])], "run string, step int, kid double")
    got = runlog.running_best(ledger, "run", ["step"], "kid").orderBy("step").collect()
    assert [r["verdict"] for r in got] == ["keep", "discard", "keep", "discard", "discard"]
    flags = spark.createDataFrame([("r", i, bool(f)) for i, f in enumerate([1, 1, 0, 1, 1, 1])], "run string, step int, bad boolean")
    assert runlog.early_stop(flags, "run", ["step"], F.col("bad"), 3).collect()[0]["stop"] == 5
    assert runlog.early_stop(flags, "run", ["step"], F.col("bad"), 4).collect()[0]["stop"] is None


def test_schedule_values(spark):
    row = spark.range(1).select(
        runlog.schedule(5).alias("s"), runlog.shift(F.lit(1024)).alias("m"), runlog.shift(F.lit(4096)).alias("top"), runlog.time_shift(F.lit(0.0), 1.0, F.lit(0.3)).alias("t"), runlog.time_shift(F.lit(1.0), 1.0, F.lit(0.0)).alias("z"),
        runlog.fold_threshold(F.array(*[F.lit(x) for x in (9.0, 1.0, 1.0, 1.5, 1.0)]), 3.0).alias("f"),
    ).collect()[0]
    assert [round(x, 6) for x in row["s"]] == [1.0, 0.923077, 0.818182, 0.6, 0.0, 0.0] or [round(x, 6) for x in row["s"]] == [1.0, 0.9, 0.75, 0.5, 0.0, 0.0]
    assert round(row["m"], 6) == 0.63 and round(row["top"], 6) == 1.15 and round(row["t"], 6) == 0.3 and row["z"] == 0
    assert row["f"] == [False, True, True, False, True]


def test_nearest_row_takes_the_first_of_equals(spark):
    left = spark.createDataFrame([(1, 0.5), (2, 0.9)], "k int, at double")
    right = spark.createDataFrame([(0, 0.4), (1, 0.6), (2, 1.0)], "i int, sigma double")
    assert {r["k"]: r["i"] for r in runlog.nearest_row(left, right, "at", "sigma", "i").collect()} == {1: 0, 2: 2}


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)], "id bigint, v array<double>, side int")
    cov = vectors.covariance(df.repartition(3), "v", 4).toPandas()
    m = np.zeros((4, 4))
    m[cov["i"], cov["j"]] = cov["cov"]
    assert np.allclose(m, np.cov(x.T))
    a, b = x[::2], x[1::2]
    k = lambda p, q: (p @ q.T / 4 + 1) ** 3
    own = lambda p: (k(p, p).sum() - np.trace(k(p, p))) / (len(p) * (len(p) - 1))
    (got,) = vectors.poly_mmd(df, "v", F.col("side") == 0, F.lit(0), 4).collect()
    assert np.isclose(got["mmd"], own(a) + own(b) - 2 * k(a, b).mean())
    (f,) = vectors.frechet_distance(df, "v", F.col("side") == 0, 4).collect()
    assert f["frechet"] >= 0 and np.isclose(vectors.frechet(a.mean(0), np.cov(a.T), a.mean(0), np.cov(a.T)), 0, atol=1e-9)


def test_mmr_against_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, "c", v.tolist()) for i, v in enumerate(x)], "id bigint, cell string, v array<double>")
    got = [r["id"] for r in vectors.mmr(df, "id", "cell", "v", 6).orderBy("rank").collect()]
    centre = x.mean(0) / (np.linalg.norm(x.mean(0)) + 1e-8)
    chosen = [int((x @ centre).argmax())]
    while len(chosen) < 6:
        score = {i: 0.5 * x[i] @ centre - 0.5 * max(x[i] @ x[j] for j in chosen) for i in range(30) if i not in chosen}
        chosen.append(max(score, key=score.get))
    assert got == chosen


def test_array_helpers(spark):
    row = spark.range(1).select(
        vectors.masked(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(True), F.lit(False), F.lit(True))).alias("m"),
        vectors.pad_to(F.array(F.lit(1), F.lit(2)), 4).alias("p"), vectors.patches(F.sequence(F.lit(0), F.lit(15)), 4, 4).alias("q"),
        vectors.mean_pool(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0))), 2).alias("a"), vectors.pixels(F.array(F.lit(-2.0), F.lit(0.0), F.lit(1.0))).alias("x"),
        vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), vectors.normalised(F.array(F.lit(3.0), F.lit(4.0))).alias("n"),
    ).collect()[0]
    assert row["m"] == [1, 3] and row["p"] == [1, 2, 2, 2] and row["q"][0] == [0, 1, 4, 5] and row["q"][3] == [10, 11, 14, 15]
    assert row["a"] == [2.0, 4.0] and row["x"] == [0, 128, 255] and round(row["c"], 6) == 0.707107 and row["n"] == [0.6, 0.8]


def test_working_dir_follows_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert working_dir(spark) == (named.rstrip("/") if named else spark.sparkContext.getCheckpointDir())


def test_the_full_outer_join_keeps_every_order(spark):
    from lumenloom.plans import registry

    folder = "/root/testdata/sf0.001"
    got = registry.queries()["star_full_outer_whole"](spark, folder)
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    assert got.where("o_orderkey is not null").count() == orders.count()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [10, 1000])
def test_skewed_join(spark, monkeypatch, how, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rows = spark.createDataFrame([(1 if i < 50 else None if i < 60 else i, i) for i in range(100)], "k int, v int")
    table = spark.createDataFrame([(1, "hot"), (70, "cold"), (None, "null")], "k int, name string")
    found = skew.join_skewed(rows, table, ["k"], how)
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.join(table, "k", how).select(found.columns).collect()))
    assert skew.join_skewed(rows.limit(0), table, ["k"], how).count() == 0


def test_exact_row_is_an_error_without_one_match(spark):
    schedule = spark.createDataFrame([(0, 1.0), (1, 0.5), (1, 0.4), (2, 0.0)], "i int, sigma double")
    rows = spark.createDataFrame([(1, 0), (2, 2)], "id int, key int")
    assert sorted((r["id"], r["sigma"]) for r in runlog.exact_row(rows, schedule, "key", "i").collect()) == [(1, 1.0), (2, 0.0)]
    for key in (99, 1, None):  # none, two, no key
        with pytest.raises(Exception, match="schedule rows for"):
            runlog.exact_row(spark.createDataFrame([(1, key)], "id int, key int"), schedule, "key", "i").collect()
    assert runlog.exact_row(rows.limit(0), schedule, "key", "i").count() == 0


def test_tables_of_other_sizes_are_not_aligned(spark):
    a, b = spark.range(5).toDF("a"), spark.range(10, 15).toDF("b")
    assert sorted(map(tuple, sampling.aligned(a, b, ["a"], ["b"]).collect())) == [(i, 10 + i) for i in range(5)]
    with pytest.raises(ValueError, match="aligned"):
        sampling.aligned(a, b.limit(3), ["a"], ["b"])


def brute_mmd(a, b, width):
    def k(x, y):
        return (x @ y.T / width + 1) ** 3

    def own(x):
        return (k(x, x).sum() - np.trace(k(x, x))) / (len(x) * (len(x) - 1))

    return own(a) + own(b) - 2 * k(a, b).mean()


def test_discrepancy_by_moments_and_by_subsets(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    rows = [(i, v[i].tolist(), i % 2 == 0, 0) for i in range(60)] + [(100, [1.0] * 5, True, 1), (101, None, True, 0)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, side boolean, s int").repartition(4)
    found = {r["subset"]: r["mmd"] for r in vectors.poly_mmd(df, "v", F.col("side"), F.col("s"), 5).collect()}
    assert abs(found[0] - brute_mmd(v[::2], v[1::2], 5)) < 1e-9 and found[1] is None
    whole = vectors.subset_mmd(df.where("s = 0"), "id", "v", F.col("side"), 5, subsets=3, size=50).collect()
    assert len(whole) == 3 and all(abs(r["mmd"] - brute_mmd(v[::2], v[1::2], 5)) < 1e-9 for r in whole)
    assert vectors.poly_mmd(df.limit(0), "v", F.col("side"), F.col("s"), 5).count() == 0


def test_pairs_of_a_large_cluster_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 4))
    rows = [(i, 0 if i < 30 else 1, v[i].tolist()) for i in range(40)] + [(50, None, [1.0] * 4), (51, 0, None)]
    df = spark.createDataFrame(rows, "id bigint, c int, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    expected = {(i, j) for i in range(40) for j in range(i + 1, 40) if (i < 30) == (j < 30) and unit[i] @ unit[j] > 0.2}
    for block in (4096, 7):
        monkeypatch.setattr(vectors, "CLUSTER_BLOCK", block)
        found = [(r["id_a"], r["id_b"]) for r in vectors.cluster_pairs(df, "id", "c", "v", 0.2).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_selection_has_no_cap_and_takes_all_of_a_small_cell(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 3))
    rows = [(i, 0 if i < 57 else 1, v[i].tolist()) for i in range(60)] + [(None, 0, [0.0] * 3), (99, None, [0.0] * 3)]
    got = vectors.mmr(spark.createDataFrame(rows, "id bigint, c int, v array<double>"), "id", "c", "v", 4).collect()
    mine = sorted((r["rank"], r["id"]) for r in got if r["cell"] == 0)
    part = v[:57]
    near = part @ (part.mean(0) / np.linalg.norm(part.mean(0)))
    taken = [int(near.argmax())]
    while len(taken) < 4:
        score = 0.5 * near - 0.5 * (part @ part[taken].T).max(1)
        score[taken] = -np.inf
        taken.append(int(score.argmax()))
    assert mine == [(i + 1, t) for i, t in enumerate(taken)]
    assert sorted(r["id"] for r in got if r["cell"] == 1) == [57, 58, 59]


def test_sweep_deletes_what_is_left(spark):
    from pathlib import Path

    from lumenloom.session import discard, materialize, sweep

    tables = [materialize(spark.range(3), "left") for _ in range(3)]
    discard(tables[0])
    assert sweep(spark) >= 2 and not any(Path(t._lumenloom_path.removeprefix("file:")).exists() for t in tables)
    assert sweep(spark) == 0


def test_patches_come_back(spark):
    df = spark.createDataFrame([(list(range(24)),)], "v array<int>")
    cut = vectors.patches(F.col("v"), 4, 6)
    assert df.select(vectors.unpatched(cut, 4, 6).alias("v")).collect()[0]["v"] == list(range(24))


def test_generation_asks_again(spark):
    from lumenloom.operators import generate

    calls = []

    def answer(request):
        calls.append(request)
        if request == "never" or calls.count(request) < 3:
            raise ValueError
        return request.upper()

    assert [generate.ask(answer, r, 3, 0.0) for r in ("late", "never", None)] == ["LATE", None, None]
    assert calls.count("never") == 3
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, r string")
    assert sorted(map(str, (tuple(r) for r in generate.generated(df, "r", lambda: str.upper, "text").collect()))) == ["(1, 'a', 'A')", "(2, None, None)"]


def test_accounting_of_empty_and_repeated_rows(spark):
    from lumenloom.operators import report

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id int, k string")
    got = {r["stage"]: r["kept"] for r in report.dedup_accounting(df, F.col("k"), "id", F.col("k") != "b").collect()}
    assert got == {"input": 4, "deduplicated": 3, "filtered": 1}
    got = {r["stage"]: r["kept"] for r in report.dedup_accounting(df.limit(0), F.col("k"), "id", F.lit(True)).collect()}
    assert got == {"input": 0, "deduplicated": 0, "filtered": 0}


def test_what_goes_to_every_task_is_small(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_ROWS", 3)
    rows = spark.createDataFrame([(1, 0.2)], "id int, at double")
    schedule = spark.createDataFrame([(i, i / 10) for i in range(4)], "i int, sigma double")
    with pytest.raises(Exception, match="at most 3 go to every task"):
        runlog.nearest_row(rows, schedule, "at", "sigma", "i").collect()
    assert runlog.nearest_row(rows, schedule.limit(3), "at", "sigma", "i").count() == 1
    with pytest.raises(ValueError, match="schedule"):
        runlog.exact_row(rows, schedule, "id", "i")
    many = spark.createDataFrame([(i, str(i)) for i in range(9)], "row_id int, s string")
    with pytest.raises(ValueError, match="quotas"):
        sampling.stratified_sample(many, ["s"], "row_id", 5)


def test_centroids_of_ragged_and_null_vectors(spark):
    rows = [("a", [1.0, None, 3.0]), ("a", [3.0, 4.0]), ("a", None), (None, [7.0]), ("b", [])]
    df = spark.createDataFrame(rows, "k string, v array<float>").repartition(3)
    got = {r["k"]: r["centroid"] for r in vectors.centroids(df, "v", ["k"]).collect()}
    assert got == {"a": [2.0, 4.0, 3.0], None: [7.0]}
    assert vectors.centroids(df, "v", []).collect()[0]["centroid"] == [11 / 3, 4.0, 3.0]
    assert vectors.centroids(df.limit(0), "v", ["k"]).count() == 0


def test_edit_pairs_are_all_pairs_whatever_the_blocks(spark, monkeypatch):
    """A phrase that all texts share gives no candidates; the number of blocks changes nothing."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefghij é中"), int(rng.integers(1, 90)))) for _ in range(60)]
    texts += [t[: len(t) // 2] + "x" * int(rng.integers(0, 4)) + t[len(t) // 2 + int(rng.integers(0, 5)) :] for t in texts for _ in range(2)]
    texts += ["the image shows a caption in the corner " + "".join(rng.choice(list("abcdefghij"), 30)) for _ in range(300)] + ["", "", None, texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "id int, text string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    some = [i for i, t in enumerate(texts) if t and not t.startswith("the image")]
    near = [(i, j) for i in some for j in some if i < j and abs(len(texts[i]) - len(texts[j])) * 10 < max(len(texts[i]), len(texts[j]))]
    expected = {(i, j, d) for i, j in near if (d := distance(texts[i], texts[j])) * 10 < max(len(texts[i]), len(texts[j]))}
    assert len(expected) > 40
    for rows in (2048, 40):
        monkeypatch.setattr(edits, "BLOCK_ROWS", rows)
        assert {tuple(r) for r in edits.pairs_within_a_tenth(df, "id", "text").collect()} == expected
    phrase = [pa.Table.from_pydict({"id": range(300), "text": texts[-304:-4], "side": [0] * 300, "low": [1] * 300, "high": [1] * 300, "i": [0] * 300, "j": [0] * 300})]
    assert sum(len(t) for t in edits._near(phrase[0])) < 100  # of 44,850 pairs
