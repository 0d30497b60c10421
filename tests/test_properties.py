"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenloom.functions.itemsets import ItemSets, item_sets, items, most_differences, new_memory, required_overlap
from lumenloom.operators.components import forest

sizes = st.integers(1, 400)


@given(sizes, sizes, st.integers(100, 1000))
def test_overlap_bound_is_tight(a, b, permille):
    c = required_overlap(a, b, permille)
    assert c * 1000 >= permille * (a + b - c)
    assert (c - 1) * 1000 < permille * (a + b - c + 1)
    assert most_differences(a, b, permille) == a + b - 2 * c


@given(st.lists(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30, unique=True), min_size=2, max_size=6))
def test_sketches_never_exceed_the_sets(lists):
    sets = ItemSets(np.array([v for x in lists for v in sorted(x)], np.uint64), np.array([len(x) for x in lists]))
    for sketch in (sets.sketch(), sets.sketch(3)):
        for i, x in enumerate(lists):
            for j, y in enumerate(lists):
                assert int(np.bitwise_count(sketch[i] ^ sketch[j]).sum()) <= len(set(x) ^ set(y))


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_item_sets_hold_the_distinct_items(texts):
    sets = item_sets(texts, new_memory())
    assert sets.sizes.tolist() == [len(set(items(t))) if t else 0 for t in texts]
    for i in range(len(texts)):
        own = sets.flat[sets.starts[i] : sets.starts[i] + sets.sizes[i]]
        assert (np.diff(own.astype(object)) > 0).all()
    back = ItemSets.of_blobs(sets.blobs())
    assert back.sizes.tolist() == sets.sizes.tolist() and (back.flat == sets.flat).all()


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
@settings(max_examples=60)
def test_forest_is_the_closure(links):
    vertex, root = forest(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    label = dict(zip(vertex.tolist(), root.tolist(), strict=True))
    assert all(label[a] == label[b] for a, b in links)
    assert all(label[label[v]] == label[v] <= v for v in label)
