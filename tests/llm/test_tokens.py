import random

import numpy as np
import pytest

from lumenloom.llm import packing, tokens

SHAPE = "doc_id bigint, text string, id int, tokens int, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "en") for i, t in rows], SHAPE)


def odd_text(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["word ", "  ", "\n\n", "é", "山水", "'s", "123", "!!", "\t", "x" * 9, "🎨"]) for _ in range(n))


def test_encode_matches_the_library(spark, monkeypatch):
    enc = tokens.tokenizer("byte_bpe_50k")
    rows = [(1, None), (2, ""), (3, "  "), (4, "<|endoftext|>"), (5, "hello world"), (5, "hello world"), (6, odd_text(60_000, 1)), (7, "a" * 70_000), (8, " " * 70_000), (9, odd_text(50_000, 2))]
    got = tokens.encode(frame(spark, rows), "doc_id", "text").collect()
    assert sorted((r["id"], tuple(r["ids"])) for r in got) == sorted((i, tuple(enc.encode_ordinary(t or ""))) for i, t in rows)
    counts = tokens.encode(frame(spark, rows), "doc_id", "text", counts_only=True).collect()
    assert sorted((r["id"], r["tokens"]) for r in counts) == sorted((i, len(enc.encode_ordinary(t or ""))) for i, t in rows)
    assert tokens.encode(frame(spark, []), "doc_id", "text").count() == 0


def test_round_trip(spark):
    text = odd_text(3000, 3)
    (row,) = tokens.encode(frame(spark, [(1, text)]), "doc_id", "text").collect()
    assert tokens.decode(row["ids"]) == text


@pytest.mark.parametrize("seed", range(6))
def test_chunks_resynchronise(seed):
    text = odd_text(8000, seed)
    enc, size = tokens.tokenizer("byte_bpe_50k"), tokens.CHUNK
    pieces = []
    n = -(-len(text) // size)
    for k in range(n):
        lead = tokens.OVERLAP if k else 0
        piece = text[k * size - lead : k * size + size + 2 * tokens.OVERLAP - (0 if lead else 0)]
        pieces.append(tokens.encode_chunk(piece, lead, size, k == n - 1, enc))
    assert all(p is not None for p in pieces)
    assert [x for p in pieces for x in p] == enc.encode_ordinary(text)


def cube_of(rows, slice_of):
    enc, out = tokens.tokenizer("byte_bpe_50k"), {}
    for i, text in rows:
        n, total = out.get(slice_of(i), (0, 0))
        out[slice_of(i)] = (n + 1, total + len(enc.encode_ordinary(text or "")))
    return sorted((str(k), *v) for k, v in out.items())


def test_ledger_deltas(spark):
    from pyspark.sql import functions as F

    part = F.when(F.col("doc_id") < 3, "low").when(F.col("doc_id") < 90, "high")
    slices = {"source": F.col("lang"), "lang": part, "subject": F.lit("s")}
    ledger = tokens.TokenLedger(spark)
    first = [(1, "a b c"), (2, "d e"), (3, "a b c"), (4, None), (99, "a b c")]
    later = [(1, "a b c"), (2, "d e f g"), (5, "new text"), (4, ""), (5, "new text")] + [(6, "hot text")] * 300
    for rows, fresh in ((first, 3), (later, 3), (later, 0), ([], 0), (first, 0)):
        cube = ledger.update(frame(spark, rows).repartition(3), "text", slices)
        found = sorted((str(r["lang"]), r["documents"], r["tokens"]) for r in cube.collect())
        assert found == cube_of(rows, lambda i: "low" if i < 3 else "high" if i < 90 else None)
        assert ledger.encoded == fresh  # each distinct content once, and never again


def test_ledger_outlives_its_object_and_a_broken_run(spark):
    from pyspark.sql import functions as F

    slices = {s: F.lit("x") for s in tokens.SLICE}
    ledger = tokens.TokenLedger(spark)
    ledger.update(frame(spark, [(1, "one two"), (2, "three")]), "text", slices)
    tokens.write_table(spark.createDataFrame([], tokens._COUNTS), ledger._path("counts", 2))  # a run that got no further
    again = tokens.TokenLedger(spark, ledger.home)
    assert again.run == 1
    (row,) = again.update(frame(spark, [(2, "three"), (3, "four five")]), "text", slices).collect()
    assert (row["documents"], again.encoded) == (2, 1)
    other = tokens.TokenLedger(spark, ledger.home, "byte_bpe_multi_50k")  # another vocabulary has no counts yet
    other.update(frame(spark, [(2, "three")]), "text", slices)
    assert other.encoded == 1


def test_ledger_knows_its_vocabulary(spark):
    a, b = tokens.TokenLedger(spark, name="byte_bpe_50k"), tokens.TokenLedger(spark, name="byte_bpe_multi_50k")
    assert a.mark.startswith("byte_bpe_50k:") and a.mark.split(":")[1] != b.mark.split(":")[1]


def test_decoding_rows(spark):
    rows = [(1, odd_text(500, 4)), (2, ""), (3, None), (4, "<|endoftext|>")]
    back = tokens.decode_rows(tokens.encode(frame(spark, rows), "doc_id", "text")).collect()
    assert {r["id"]: r["text"] for r in back} == {i: t or "" for i, t in rows}


def test_unsynchronised_text_is_encoded_whole(spark, monkeypatch):
    monkeypatch.setattr(tokens, "encode_chunk", lambda *a: None)
    text = odd_text(40_000, 9)
    rows = tokens.encode(frame(spark, [(1, text), (1, text), (2, "short")]), "doc_id", "text").where("id = 1").collect()
    assert [r["ids"] for r in rows] == [tokens.tokenizer("byte_bpe_50k").encode_ordinary(text)] * 2


def test_best_fit_keeps_every_constraint():
    rng = np.random.default_rng(0)
    sizes = np.concatenate([rng.integers(0, 100, 3000), [100, 100, 0, 0]])
    for most, attention in ((512, None), (3, None), (512, 6000.0)):
        bins = packing.best_fit(sizes, 100, most, attention)
        count = np.bincount(bins)
        assert np.bincount(bins, sizes).max() <= 100 and count.max() <= most
        if attention:
            cost = np.bincount(bins, sizes.astype(float) ** 2)
            assert (cost[count > 1] <= attention).all()
    bins = packing.best_fit(sizes, 100)
    assert bins.max() + 1 <= 1.02 * np.ceil(sizes.sum() / 100) + 1


def test_pack_splits_only_what_must_be(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_DOCUMENTS", 40)
    rng = random.Random(1)
    data = [(i, rng.choice([0, 3, 10, 50, 99, 100, 101, 250, 400, None])) for i in range(100)] + [(7, 20), (7, 20)]
    got = packing.pack(spark.createDataFrame(data, "id bigint, tokens bigint"), 100).collect()
    assert sum(r["tokens"] for r in got) == sum(n or 0 for _, n in data)
    pieces = {}
    for r in got:
        assert r["tokens"] <= 100
        pieces.setdefault(r["id"], []).append(r["pieces"])
    assert {i for i, n in data if (n or 0) > 100} == {i for i, p in pieces.items() if max(p) > 1}
    assert {i for i, _ in data} == set(pieces)
    assert packing.pack(spark.createDataFrame([], "id bigint, tokens bigint"), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame(data, "id bigint, tokens bigint"), 0)


def test_containers_follow_the_constraints_and_not_the_partitions(spark):
    rng = random.Random(2)
    docs = frame(spark, [(i, "word " * rng.randrange(1, 60)) for i in range(300)] + [(7, "word word")] * 40)
    plain = spark.createDataFrame([("w", "byte_bpe_50k", 64)], "pack_id string, tokenizer string, capacity int")
    found = {}
    for name, specs in {
        "default": plain,
        "cost": plain.selectExpr("*", "300 AS attention_permille"),
        "documents": plain.selectExpr("*", "3 AS most_documents"),
    }.items():
        packed = [sorted(map(tuple, packing.pack_documents(docs.repartition(n), "doc_id", "text", specs).collect())) for n in (1, 5)]
        assert packed[0] == packed[1]
        found[name] = packed[0]
    cost, count = {}, {}
    for name, rows in found.items():
        for _, container, _, _, _, n in rows:
            cost[name, container] = cost.get((name, container), 0) + n * n
            count[name, container] = count.get((name, container), 0) + 1
    assert all(c <= 0.3 * 64**2 for (name, k), c in cost.items() if name == "cost" and count[name, k] > 1)
    assert all(n <= 3 for (name, _), n in count.items() if name == "documents")
    assert len({frozenset((c, i, p) for _, c, i, p, _, _ in rows) for rows in found.values()}) == 3


def test_pack_documents(spark):
    specs = spark.createDataFrame([("w", "byte_bpe_50k", 16)], "pack_id string, tokenizer string, capacity int")
    packed = packing.pack_documents(frame(spark, [(1, "word " * 40), (2, None), (3, ""), (4, "one two")]), "doc_id", "text", specs)
    assert {r["id"] for r in packed.where("pieces > 1").collect()} == {1}
    (fill,) = packing.fill_report(packed, specs).collect()
    assert 0 < fill["fill"] <= 1
