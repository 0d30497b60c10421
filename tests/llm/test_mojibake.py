import pytest

from lumenloom.llm import mojibake
from lumenloom.session import read_table

TINY = "/root/testdata/sf0.001"
FRENCH = "Après la pluie, une forêt fragile résiste près de l'étang, où l'élève étudie déjà « très cher »."
RUSSIAN = "На переднем плане стоит весёлая дверь, вокруг неё огромная роза."
CHINESE = "画面的前景中，非常明亮的集市倒映在深蓝的猫头鹰附近。"


@pytest.fixture(scope="module")
def samples(spark):
    return [r[0] for r in read_table(spark, TINY, "lang_samples").select("sample_text").orderBy("sample_id").collect()]


@pytest.mark.parametrize(
    ("text", "written", "read"),
    [
        (FRENCH, "utf-8", "latin-1"), (FRENCH, "utf-8", "cp437"), (FRENCH, "utf-8", "cp850"), (FRENCH, "utf-8", "mac-roman"),
        ("It’s — “kept”…", "utf-8", "latin-1"), (RUSSIAN, "cp1251", "latin-1"), (RUSSIAN, "koi8-r", "cp1251"), (CHINESE, "gbk", "latin-1"),
    ],
)
def test_restores(samples, text, written, read):
    garbled = text.encode(written).decode(read)
    suspects = mojibake.Suspects(mojibake.states())
    spans = mojibake.label(garbled, mojibake.Clean(samples), suspects.active(garbled))
    restored = mojibake.restore(garbled, spans)
    assert sum(a == b for a, b in zip(restored, text, strict=False)) >= 0.9 * len(text) or restored == text


@pytest.mark.parametrize(
    "text",
    [
        FRENCH, RUSSIAN, CHINESE, "AMANHÃ NÃO HAVERÁ VISITAÇÃO; À NOITE, SÃO 99 SESSÕES", "Größe, Übung, Äpfel, Öl.", "├── prompts\n│   └── val", "Ωmega 168 µm", "→ ← ↑ ①②③",
        "👩‍🎨 🇺🇳 🏞️✨", "Þröng gata, ð og æ.", "ﬁne ﬂow", "smörgåsbord", "©™® €5, £4, ¥900, 50¢", "한 글자 مرحبا नमस्ते ビュー", "étude", "the price – “about” 12½°",
    ],
)
def test_leaves_correct_unicode(samples, text):
    suspects = mojibake.Suspects(mojibake.states())
    assert mojibake.label(text, mojibake.Clean(samples), suspects.active(text)) == []


@pytest.mark.parametrize(
    ("text", "restored"),
    [
        ("Angle 430░, error ▒64, scale ╫881.", "Angle 430°, error ±64, scale ×881."), ("A 675 ╡m grain at 579╝ stops.", "A 675 µm grain at 579¼ stops."),
        ("ItÆs the lilac one that weÆll fix; theyÆre upscaled.", "It’s the lilac one that we’ll fix; they’re upscaled."), ("⌐ 234 nobody", "© 234 nobody"),
        ("4k ìKeep the greenhouse,î the note says.", "4k “Keep the greenhouse,” the note says."), ("Un petit 茅l猫ve et l'茅cole", "Un petit élève et l'école"),
    ],
)
def test_restores_marks_that_became_letters_or_boxes(samples, text, restored):
    suspects = mojibake.Suspects(mojibake.states())
    assert mojibake.restore(text, mojibake.label(text, mojibake.Clean(samples), suspects.active(text))) == restored


def garble(text, state):
    for _ in range(state.times):
        raw = text.encode(state.written)
        lenient = mojibake._LENIENT.get(state.read)
        text = "".join(bytes([b]).decode(state.read, "ignore") or lenient[b] for b in raw) if lenient else raw.decode(state.read)
    return text


def test_held_out_texts_of_every_pair_are_restored(spark):
    rows = read_table(spark, TINY, "lang_samples").select("sample_id", "sample_text").orderBy("sample_id").collect()
    clean, suspects = mojibake.Clean([t for i, t in rows if i % 4]), mojibake.Suspects(mojibake.states())
    held = [t for i, t in rows if i % 4 == 0]
    assert not any(mojibake.label(t, clean, suspects.active(t)) for t in held)
    tried = found = restored = 0
    for state in mojibake.states():
        for text in held:
            try:
                wrong = garble(text, state)
            except UnicodeError:
                continue
            if wrong != text:
                spans = mojibake.label(wrong, clean, suspects.active(wrong))
                tried, found, restored = tried + 1, found + bool(spans), restored + (mojibake.restore(wrong, spans) == text)
    assert tried > 900 and found >= 0.94 * tried and restored >= 0.9 * tried


def test_only_the_span_is_changed(samples):
    text = "The café is fine. Un Ã©lÃ¨ve Ã©tudie. " + RUSSIAN
    suspects = mojibake.Suspects(mojibake.states())
    spans = mojibake.label(text, mojibake.Clean(samples), suspects.active(text))
    assert mojibake.restore(text, spans) == "The café is fine. Un élève étudie. " + RUSSIAN


def test_table_and_edges(spark, samples):
    rows = [(1, "Un Ã©lÃ¨ve"), (2, None), (3, ""), (4, "plain"), (5, "lost � here"), (1, "Un Ã©lÃ¨ve"), (6, "x" * 300_000 + " Ã©lÃ¨ve"), (None, "Ã©lÃ¨ve")]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id bigint, text string, restored string, lost int")
    got = mojibake.repair(df, "doc_id", "text", samples).collect()
    assert sorted((r["id"] or 0, r["lost"]) for r in got) == [(0, 0), (1, 0), (1, 0), (5, 1), (6, 0)]
    assert {r["restored"] for r in got if r["id"] == 1} == {"Un élève"}
    assert mojibake.repair(df.limit(0), "doc_id", "text", samples).count() == 0
