import pytest

from lumenloom.llm import language
from lumenloom.session import read_table

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    samples = read_table(spark, TINY, "lang_samples").select("lang", "sample_text", "sample_id").collect()
    train = [(r[0], r[1]) for r in samples if r[2] % 4]
    held = [(r[0], r[1]) for r in samples if r[2] % 4 == 0]
    return language.train(spark.createDataFrame(train, "lang string, text string"), None), held


def test_held_out_accuracy(parts):
    model, held = parts
    judged = language.Judged([t for _, t in held], language.Words(model))
    right = sum(judged.present[i].sum() == 1 and model.languages[judged.present[i].argmax()] == lang for i, (lang, _) in enumerate(held))
    assert right >= 0.97 * len(held)


def test_code_lengths_are_those_of_the_trees():
    model = language.Model({"aa": ["abab abab"], "bb": ["zzz"]})
    known, other = model.code_lengths(["abab"])[0]
    assert known < other


def test_mixed_and_quoted(parts):
    model, held = parts
    by = {}
    for lang, text in held:
        by.setdefault(lang, text)
    mixed = by["en"] + " " + by["de"]
    quoted = by["en"] + " A sign reads “Guten Tag”."
    judged = language.Judged([mixed, quoted, by["zh"] + by["ru"]], language.Words(model))
    names = [{model.languages[k] for k in row.nonzero()[0]} for row in judged.present]
    assert names == [{"en", "de"}, {"en"}, {"zh", "ru"}]
    found = cut([mixed], model)
    assert [f[4] for f in found] == ["en", "de"] and sum(f[3] for f in found) == len(mixed)
    assert all(0.5 <= f[5] <= 1 for f in found)


def cut(texts, model):
    columns = language.stretches(texts, language.Words(model))
    return [(t, n, s, m, model.languages[k], c) for t, n, s, m, k, c in zip(*(c.tolist() for c in columns), strict=True)]


def test_stretches_inside_a_sentence_and_together(parts):
    model, held = parts
    by = {}
    for lang, text in held:
        by.setdefault(lang, text.strip(" .!?。"))
    inside = "The old house stands near the river, vor dem alten Haus steht eine grüne Bank und daneben ein Baum, and the boats are waiting for the morning"
    texts = [inside, by["zh"] + ". " + by["en"], "", "123 !!", by["fr"], by["ru"] + " " + by["es"] + ". " + by["ru"]]
    together = cut(texts, model)
    assert [f[4] for f in together if f[0] == 0] == ["en", "de", "en"]
    (german,) = [f for f in together if f[0] == 0 and f[4] == "de"]
    assert "alten Haus steht eine grüne Bank" in inside[german[2] : german[2] + german[3]]
    assert {f[0] for f in together} == {0, 1, 4, 5} and [f[4] for f in together if f[0] == 5] == ["ru", "es", "ru"]
    for i in (0, 1, 4, 5):
        mine = [f for f in together if f[0] == i]
        assert mine[0][2] == 0 and sum(f[3] for f in mine) == len(texts[i]) and [f[1] for f in mine] == list(range(len(mine)))
        assert [(*f[1:5], round(f[5], 9)) for f in mine] == [(*f[1:5], round(f[5], 9)) for f in cut([texts[i]], model)]


def test_cheapest_path_is_the_least_of_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    owner = np.array([0] * 6 + [1] * 3 + [2] * 5)
    bits = rng.uniform(0, 30, (len(owner), 3))
    after = rng.random(len(owner)) < 0.4
    path = language.cheapest_path(bits, owner, after)
    price = np.where(after, language.SENTENCE_MARGIN / 2, language.RUN_MARGIN / 2)
    for text in range(3):
        at = np.flatnonzero(owner == text)

        def cost(states, at=at):
            return sum(bits[i, s] for i, s in zip(at, states, strict=True)) + sum(price[i] for i, a, b in zip(at[1:], states, states[1:], strict=False) if a != b)

        assert abs(cost(path[at].tolist()) - min(map(cost, itertools.product(range(3), repeat=len(at))))) < 1e-9


def test_chinese_inside_a_sentence_of_another_language(parts):
    model, _ = parts
    text = "a small wooden house near the river 一个小女孩站在海边看着美丽的日落和远处的船 and some old boats are waiting there for the morning"
    judged = language.Judged([text], language.Words(model))
    assert {model.languages[k] for k in judged.present[0].nonzero()[0]} == {"en", "zh"}
    assert (judged.words_for[0][judged.present[0]] > 0).all()


def test_cases_and_edges(spark, parts):
    model, held = parts
    by = {}
    for lang, text in held:
        by.setdefault(lang, text)
    forms = spark.createDataFrame([("en", "en"), ("German", "de"), ("de", "de")], "label_form string, lang string")
    data = [(1, by["en"], "en"), (2, by["en"], None), (3, by["en"], "German"), (4, by["de"], "xx"), (5, by["en"] + " " + by["de"], "en"), (6, None, None), (7, "  ", None), (8, "a b", None), (9, "1 2 3 4 5 6", None), (None, by["en"], None), (2, by["en"], None), (10, by["en"] * 300, "en"), (11, "the house " * 300, None)]
    df = spark.createDataFrame([(i, t, x, 1, "w") for i, t, x in data], "row_id bigint, text string, lang string, words int, named string")
    got = sorted((r["id"], r["lang"]) for r in language.label_cases(df, "row_id", "text", "lang", forms, model).distinct().collect())
    assert got == [(2, "en"), (3, "en"), (4, "de"), (5, "de"), (5, "en")]
    assert language.label_cases(df.limit(0), "row_id", "text", "lang", forms, model).count() == 0
    seg = language.language_segments(df, "row_id", "text", model).where("id = 5").orderBy("number").collect()
    assert [s["lang"] for s in seg] == ["en", "de"]
