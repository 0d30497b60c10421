import random

from lumenloom.llm import format_dups, mixing, quota_sample, thresholds
from lumenloom.operators import skew

ROWS = "row_id bigint, subject string, style string, camera string, text string, source string, bucket int, name string"
PLAN = "plan_id string, sample_permille int, axis string, code string, target_permille int, min_rows int"
MIX = "mix_id string, budget_permille int, source string, target_permille int, max_repeats int"


def rows(n=3000):
    rng = random.Random(3)
    return [
        (i, rng.choice(["S1"] * 6 + ["S2 ", " s2", "S3", None, "S99"]), rng.choice(["T1", "T1", "T2", ""]), "C1", "x" * rng.randrange(1, 90), rng.choice(["one", "One ", "o-ne", "two", "two", None]), 7, "n")
        for i in range(n)
    ]


def plan(spark):
    p = [("p", 200, "subject", "S1", 500, 5), ("p", 200, "subject", "S2", 200, 5), ("p", 200, "subject", "S3", 200, 5), ("p", 200, "subject", "S7", 100, 5), ("p", 200, "style", "T1", 500, 5), ("p", 200, "style", "T2", 500, 5)]
    return spark.createDataFrame(p, PLAN)


def test_sample_meets_feasible_quotas(spark):
    data = rows()
    df = spark.createDataFrame(data, ROWS)
    report = {r["code"]: r for r in quota_sample.quota_report(df, "row_id", plan(spark)).collect()}
    assert [c for c, r in sorted(report.items()) if r["exhausted"]] == ["S7"]
    got = [r["id"] for r in quota_sample.quota_sample(df, "row_id", plan(spark)).collect()]
    assert len(got) == len(set(got))
    by = {r[0]: r for r in data}
    for code in ("S1", "S2", "S3"):
        n = sum((by[i][1] or "").strip().upper() == code for i in got)
        assert n == report[code]["rows_sampled"] and abs(n - report[code]["target_permille"] * 600 / 1000) <= 12, code
    assert got and sorted(got) == sorted(r["id"] for r in quota_sample.quota_sample(df.repartition(7), "row_id", plan(spark)).collect())


def test_sample_edges(spark):
    empty = spark.createDataFrame([], ROWS)
    assert quota_sample.quota_sample(empty, "row_id", plan(spark)).count() == 0
    report = quota_sample.quota_report(empty, "row_id", plan(spark)).collect()
    assert len(report) == 6 and not any(r["exhausted"] for r in report)
    few = spark.createDataFrame(rows(3) * 2 + [(None, None, None, None, None, None, 1, None)], ROWS)
    assert quota_sample.quota_report(few, "row_id", plan(spark)).count() == 6
    assert quota_sample.quota_sample(few, "row_id", plan(spark)).count() <= 7


def test_mix_shares_and_repeats(spark):
    data = rows()
    df = spark.createDataFrame(data, ROWS)
    p = spark.createDataFrame([("m", 500, "one", 500, 1), ("m", 500, "two", 400, 1), ("m", 500, "three", 100, 4), ("w", 1000, "two", 800, 3), ("w", 1000, "ONE", 200, 1)], MIX)
    size = {r[0]: len(r[4]) for r in data}
    name = {r[0]: (r[5] or "").lower().replace("-", "").strip() for r in data}
    total = sum(size.values())
    report = {(r["mix_id"], r["source"]): r for r in mixing.mix_report(df, "row_id", "text", "source", p).collect()}
    assert [k for k, r in sorted(report.items()) if r["out_of_reach"]] == [("m", "three")]
    taken = {}
    for r in mixing.mix_sample(df, "row_id", "text", "source", p).collect():
        assert 1 <= r["copies"] <= 3
        k = (r["mix_id"], name[r["id"]])
        taken[k] = taken.get(k, 0) + r["copies"] * size[r["id"]]
    for (mix, source), r in report.items():
        assert r["budget"] == (500 if mix == "m" else 1000) * total // 1000
        if source != "three":
            assert 0 <= r["wanted"] - taken[mix, source.lower()] <= 90


def test_mix_edges(spark):
    p = spark.createDataFrame([("m", 500, "one", 500, 1), ("m", 500, None, 100, 1), (None, 1, "one", 1, 1)], MIX)
    empty = spark.createDataFrame([], ROWS)
    assert [r["out_of_reach"] for r in mixing.mix_report(empty, "row_id", "text", "source", p).collect()] == [False]
    assert mixing.mix_sample(empty, "row_id", "text", "source", p).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None, "one", 1, ""), (2, None, None, None, "", "one", 1, ""), (2, None, None, None, "long" * 50_000, "ONE", 1, "")], ROWS)
    # the long record exceeds the source's share; the empty one costs nothing, the null one has no size
    assert [tuple(r) for r in mixing.mix_sample(odd, "row_id", "text", "source", p).collect()] == [("m", 2, 1)]


def test_format_copies(spark):
    base = "A Red, car near a wooden house"
    form = "subject: red car; light: dawn; mood: calm"
    data = [
        (1, base, "one"), (2, "a red car   near a WOODEN house!", "One "), (3, base, "two"), (4, base, None), (5, None, "one"), (6, "", "one"),
        (7, form, "one"), (8, '{"mood": "Calm", "subject": "red-car", "light": "dawn"}', "o-ne"), (9, "mood: calm | light: dawn | subject: Red Car", "one"),
        (10, "subject red car light dawn mood calm", "one"), (11, "a b c", "one"), (12, "a b c", "one"), (1, base, "one"), (None, base, "one"),
    ]
    df = spark.createDataFrame([(i, t, s, 1, "x", 3) for i, t, s in data], "row_id bigint, text string, source string, h1 int, copies string, first_id int")
    got = {(r["first_id"], r["id"], r["copies"]) for r in format_dups.format_copies(df, "row_id", "text", "source").collect()}
    assert got == {(1, 1, 2), (1, 2, 2), (7, 7, 3), (7, 8, 3), (7, 9, 3)}
    assert format_dups.format_copies(df.limit(0), "row_id", "text", "source").count() == 0


def test_large_class_stays_where_its_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    data = [(i, "A red car near a house", "one") for i in range(120)] + [(500, "two blue boats by the lake", "one"), (501, "Two blue boats, by the lake", "one")]
    got = format_dups.format_copies(spark.createDataFrame(data, "row_id bigint, text string, source string"), "row_id", "text", "source")
    assert {tuple(r) for r in got.collect()} == {(0, i, 120) for i in range(120)} | {(500, 500, 2), (500, 501, 2)}
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_each_text_is_canonicalised_once_a_task(monkeypatch):
    texts, seen = format_dups.Texts(5), []
    monkeypatch.setattr(format_dups, "named_fields", lambda t: seen.append(t))
    for text in ["a b c d e", "a b c d f", "a b c d e", "few", "few"]:
        texts.body(text)
    assert seen == ["a b c d e", "a b c d f"]


def test_edges_are_narrowed_until_they_are_small(spark, monkeypatch):
    data = spark.createDataFrame(rows(3000), ROWS)
    mixes = spark.createDataFrame([("m", 500, "one", 500, 1), ("m", 500, "two", 400, 1), ("w", 1000, "two", 800, 3)], MIX)
    results = []
    for edge_rows in (50_000, 0):
        monkeypatch.setattr(thresholds, "EDGE_ROWS", edge_rows)
        sample = quota_sample.quota_sample(data, "row_id", plan(spark)).collect()
        mix = mixing.mix_sample(data, "row_id", "text", "source", mixes).collect()
        results.append((len(sample), sorted((r["mix_id"], r["id"], r["copies"]) for r in mix)))
    assert results[0] == results[1]


def test_narrowing_finds_the_place_of_any_goal(spark, monkeypatch):
    monkeypatch.setattr(thresholds, "EDGE_ROWS", 3)
    import pandas as pd

    rng = random.Random(8)
    hot = [("a", rng.randrange(1 << 24), rng.randrange(1, 9)) for _ in range(400)]  # one bucket of the first histogram
    table = spark.createDataFrame(hot, "name string, place bigint, amount bigint")
    total = sum(h[2] for h in hot)
    for goal in (1, total // 2, total):
        edges = pd.DataFrame([("m", "a", 0, 1 << 24, goal, len(hot))], columns=["mix_id", "name", "low", "width", "rest", "n"])
        (found,) = thresholds.narrowed(table, ["name"], edges).to_dict("records")
        below = sum(h[2] for h in hot if h[1] < found["low"])
        inside = sum(h[2] for h in hot if found["low"] <= h[1] < found["low"] + found["width"])
        assert found["n"] <= 3 and below + found["rest"] == goal and below < goal <= below + inside
