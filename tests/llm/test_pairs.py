import pytest

from lumenloom.functions.itemsets import items, most_differences, required_overlap
from lumenloom.llm.cross_split import Block, Order, banded_distance, cross_split_pairs
from lumenloom.llm.near_dup import light_boundary, near_duplicate_groups, partner_overlaps

SHAPE = "row_id bigint, text string, split string, id string, tag int"


def alike(a, b, permille=700):
    x, y = set(items(a)), set(items(b))
    return len(x) >= 5 and len(y) >= 5 and len(x & y) * 1000 >= permille * len(x | y)


def groups_of(rows):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if alike(a[1], b[1]):
                x, y = find(a[0]), find(b[0])
                parent[max(x, y)] = min(x, y)
    out = {}
    for r in rows:
        out.setdefault(find(r[0]), set()).add(r[0])
    return {frozenset(g) for g in out.values() if len(g) > 1}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], SHAPE)


def test_items():
    assert items("A Red-Car 1970, été") == ["a", "red", "car", "1970", "été"]
    assert items("山水画abc人") == ["山水", "水画", "abc", "人"]


def test_bounds():
    for a in range(5, 60):
        for b in range(a, 60):
            c = required_overlap(a, b, 700)
            assert (c * 1000 >= 700 * (a + b - c)) and (c - 1) * 1000 < 700 * (a + b - c + 1)
            assert most_differences(a, b, 700) == a + b - 2 * c
    assert partner_overlaps(5, 700) == [4, 5] or partner_overlaps(5, 700) == [5]
    assert light_boundary(700, 1e9, 16) > light_boundary(700, 1, 16)


def test_groups_match_brute_force(spark, prompts):
    found = near_duplicate_groups(frame(spark, prompts), "row_id", "text").collect()
    out = {}
    for g, i, _ in found:
        out.setdefault(g, set()).add(i)
    assert {frozenset(g) for g in out.values()} == groups_of(prompts)
    assert all(g == min(m) for g, m in out.items())


def test_long_lists_go_through_the_grid(spark, prompts, monkeypatch):
    from lumenloom.operators import simjoin

    monkeypatch.setattr(simjoin, "LIST_LIMIT", 12)
    monkeypatch.setattr(simjoin, "BLOCK", 5)
    found = near_duplicate_groups(frame(spark, prompts), "row_id", "text").collect()
    out = {}
    for g, i, _ in found:
        out.setdefault(g, set()).add(i)
    assert {frozenset(g) for g in out.values()} == groups_of(prompts)


@pytest.mark.parametrize("held", [10, 1_000_000])
def test_waves_and_hot_buckets(spark, prompts, monkeypatch, held):
    from lumenloom.operators import simjoin

    for name, value in {"LIST_LIMIT": 12, "ONE_WAVE_BYTES": 1, "WAVE_BYTES": 900, "BUCKET_MEMBERS": 500, "HELD_MEMBERS": held}.items():
        monkeypatch.setattr(simjoin, name, value)
    found = near_duplicate_groups(frame(spark, prompts).repartition(3), "row_id", "text").collect()
    out = {}
    for g, i, _ in found:
        out.setdefault(g, set()).add(i)
    assert {frozenset(g) for g in out.values()} == groups_of(prompts)


def test_one_copy_holds_a_third_of_all_rows(spark, prompts, monkeypatch):
    from lumenloom.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    hot = [(10_000 + i, prompts[0][1], "train") for i in range(len(prompts) // 2)]
    found = {i: g for g, i, _ in near_duplicate_groups(frame(spark, prompts + hot).repartition(6), "row_id", "text").collect()}
    assert len({found[i] for i, _, _ in hot}) == 1 and found[hot[0][0]] == found[prompts[0][0]]


def test_several_blocks_of_evaluation_records(spark, prompts, monkeypatch):
    from lumenloom.llm import cross_split

    monkeypatch.setattr(cross_split, "BLOCK_RECORDS", 30)
    monkeypatch.setattr(cross_split, "WAVE_BLOCKS", 2)
    found = {(a, b) for a, b, _ in cross_split_pairs(frame(spark, prompts), "row_id", "text", "split").collect()}
    evals, trains = [r for r in prompts if r[2] in ("val", "test")], [r for r in prompts if r[2] == "train"]
    assert found == {(e[0], t[0]) for e in evals for t in trains if alike(e[1], t[1])}


def test_links_count_distinct_texts(spark):
    a = "amber anvil barn basalt beacon brass canyon cedar chalk cliff"
    rows = [(1, a, "train"), (2, a, "train"), (3, a + " cobalt", "train"), (4, a + " copper", "val")]
    got = {i: n for _, i, n in near_duplicate_groups(frame(spark, rows), "row_id", "text").collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2}


def test_group_edge_cases(spark):
    assert near_duplicate_groups(frame(spark, []), "row_id", "text").count() == 0
    long = " ".join(f"word{i}" for i in range(9000))
    rows = [(1, None, None), (2, "", None), (3, "a b c d", "train"), (4, "a b c d", "train"), (None, "a b c d e", "x"), (5, long, "train"), (6, long + " more", "val"), (6, long + " more", "val")]
    got = near_duplicate_groups(frame(spark, rows), "row_id", "text").collect()
    assert {(g, i) for g, i, _ in got} == {(5, 5), (5, 6)}


def test_cross_split_matches_brute_force(spark, prompts):
    found = {(a, b) for a, b, _ in cross_split_pairs(frame(spark, prompts), "row_id", "text", "split").collect()}
    evals = [r for r in prompts if r[2] in ("val", "test")]
    trains = [r for r in prompts if r[2] == "train"]
    assert found == {(e[0], t[0]) for e in evals for t in trains if alike(e[1], t[1])}


@pytest.mark.parametrize("permille", [300, 500, 900])
def test_cross_split_at_other_thresholds(spark, prompts, permille):
    some = prompts[:220]
    found = {(a, b) for a, b, _ in cross_split_pairs(frame(spark, some), "row_id", "text", "split", permille).collect()}
    evals, trains = [r for r in some if r[2] in ("val", "test")], [r for r in some if r[2] == "train"]
    assert found == {(e[0], t[0]) for e in evals for t in trains if alike(e[1], t[1], permille)}


def test_cross_split_likeness_and_edges(spark):
    a = "amber anvil barn basalt beacon brass canyon cedar chalk cliff"
    rows = [(1, a, "val"), (2, a, "train"), (3, a + " cobalt", "train"), (4, None, "val"), (5, "", "train"), (6, a, None), (None, a, "train")]
    got = {(e, t): round(j, 6) for e, t, j in cross_split_pairs(frame(spark, rows), "row_id", "text", "split").collect()}
    assert got == {(1, 2): 1.0, (1, 3): round(10 / 11, 6)}
    assert cross_split_pairs(frame(spark, []), "row_id", "text", "split").count() == 0


def test_banded_distance():
    import numpy as np

    from lumenloom.functions.itemsets import ItemSets

    def sets(*xs):
        return ItemSets(np.array([v for x in xs for v in x], np.uint64), np.array([len(x) for x in xs]))

    x, y = sets([1, 2, 3, 4], [1, 2, 3], [5, 6]), sets([1, 3, 4, 9], [1, 2, 3], [7, 8])
    assert banded_distance(x, y, np.array([4, 2, 2])).tolist()[:2] == [2, 0]
    assert banded_distance(x, y, np.array([4, 2, 2]))[2] > 2


def test_block_covers_every_segmentation():
    import numpy as np

    from lumenloom.functions.itemsets import ItemSets

    one = ItemSets(np.arange(10, 50, dtype=np.uint64), np.array([40]))
    block = Block(np.array([1]), one, Order(np.arange(10, 50, dtype=np.uint64), np.full(40, 9), 100), 700)
    assert len(block.tag) and block.place.max() < 40


def test_templates_that_hold_a_third_of_all_rows(spark, monkeypatch):
    from lumenloom.operators import simjoin

    frame_words = " ".join(f"frame{i}" for i in range(19))
    slots = [f"slot{i}" for i in range(4)]
    # each slot word is a frequent item (over 64 rows) of under 6 % of the rows; no two template texts share one
    rows = [(i, f"{frame_words} {s}", "train") for i, s in enumerate(slots)]
    rows += [(100 + i, f"{frame_words} {' '.join(f'own{i}x{k}' for k in range(20))}", "train") for i in range(1000)]
    rows += [(10_000 + i, f"{slots[i % 4] if i < 400 else 'none'} {' '.join(f'other{i}x{k}' for k in range(9))}", "train") for i in range(2000)]
    for limit in (simjoin.LIST_LIMIT, 300, 30):  # lists of one item, then of two and three
        monkeypatch.setattr(simjoin, "LIST_LIMIT", limit)
        found = near_duplicate_groups(frame(spark, rows), "row_id", "text").collect()
        assert {(g, i, n) for g, i, n in found} == {(0, i, 3) for i in range(4)}


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize(("permille", "limit", "blockwise", "held", "one_word"), [(700, 20_000, 256, 1_000_000, 19), (700, 20_000, 4, 1_000_000, 19), (700, 12, 4, 10, 0), (700, 12, 256, 300, 19), (300, 40, 4, 1_000_000, 19), (900, 12, 6, 100, 19)])
def test_comparer_finds_every_pair(prompts, monkeypatch, across, permille, limit, blockwise, held, one_word):
    import numpy as np
    import pyarrow as pa

    from lumenloom.functions.itemsets import item_sets, new_memory
    from lumenloom.operators import simjoin

    for name, value in {"BLOCKWISE": blockwise, "HELD_MEMBERS": held, "ONE_WORD": one_word, "BLOCK": 5, "COLUMNS": 40, "PAIR_STEP": 50}.items():
        monkeypatch.setattr(simjoin, name, value)
    texts = list({frozenset(items(t)): t for _, t, _ in prompts[:400] if t and len(set(items(t))) >= 5}.values())
    sets = item_sets(texts, new_memory())
    hashes, side = sets.identity(), np.arange(len(texts)) % 3 // 2 if across else np.zeros(len(texts), int)
    names, counts = np.unique(sets.flat, return_counts=True)
    lists = simjoin.PrefixLists(names[counts > 3], counts[counts > 3], len(texts), permille, limit)
    batch = pa.RecordBatch.from_arrays([pa.array(hashes), sets.blobs(), pa.array(side)], names=["key", "blob", "side"])
    compare = simjoin._across if across else simjoin._comparer
    met = list(compare(permille, limit)(simjoin._keyed(lists, 0, 1, 3, across)([batch])))
    long = [(k, b) for m in met for k, b in zip(m["key"].to_pylist(), m["blob"].to_pylist(), strict=True) if k is not None]
    assert limit > 100 or long or permille == 900
    if long:
        cells = pa.RecordBatch.from_arrays([pa.array([k for k, _ in long]), pa.array([b for _, b in long], pa.binary()), pa.array([3] * len(long))], names=["key", "blob", "blocks"])
        parts = sorted(((c["bucket"][0].as_py(), c) for c in simjoin._grid(across)([cells])), key=lambda c: c[0])
        met += list(compare(permille, None)(c for _, c in parts))
    found = {(a, b) for m in met for a, b, k in zip(m["a"].to_pylist(), m["b"].to_pylist(), m["key"].to_pylist(), strict=True) if k is None}
    wanted = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and alike(texts[i], texts[j], permille) and (not across or side[i] < side[j])}
    if across:
        sides = dict(zip(hashes.tolist(), side.tolist(), strict=True))
        assert all(sides[a] < sides[b] for a, b in found)
        assert {(int(hashes[i]), int(hashes[j])) for i, j in wanted} <= found
    else:
        assert {(min(int(hashes[i]), int(hashes[j])), max(int(hashes[i]), int(hashes[j]))) for i, j in wanted} <= found
    assert wanted


def test_short_lists_leave_out_sizes_that_do_not_fit():
    import numpy as np

    from lumenloom.operators import simjoin

    compare = simjoin._comparer(700, None)
    n = np.array([10] * 50 + [100] * 50, np.uint16)
    place = compare.place(np.full(100, 77, np.uint64), n)
    rows, begin, end = compare.windows(place, n, np.array([14] * 50 + [142] * 40 + [90] * 10, np.uint16))
    assert len(rows) == 90 and (end[:50] == 50).all() and (begin == rows + 1).all() and (end[50:] == 100).all()


@pytest.mark.parametrize(("permille", "limit"), [(700, 20_000), (700, 12), (300, 40), (900, 12)])
def test_many_evaluation_records_need_no_scan_a_block(spark, prompts, monkeypatch, permille, limit):
    from lumenloom.llm import cross_split
    from lumenloom.operators import simjoin

    def scan(*_):
        raise AssertionError("the training records are scanned for a broadcast")

    monkeypatch.setattr(cross_split, "BLOCK_RECORDS", 10)
    monkeypatch.setattr(cross_split, "_against", scan)
    monkeypatch.setattr(simjoin, "LIST_LIMIT", limit)
    some = prompts[:300] + [(50_000 + i, t, "train" if s in ("val", "test") else "val") for i, t, s in prompts[:20]]
    found = [(a, b) for a, b, _ in cross_split_pairs(frame(spark, some).repartition(3), "row_id", "text", "split", permille).collect()]
    evals, trains = [r for r in some if r[2] in ("val", "test")], [r for r in some if r[2] == "train"]
    assert len(found) == len(set(found)) and set(found) == {(e[0], t[0]) for e in evals for t in trains if alike(e[1], t[1], permille)}
