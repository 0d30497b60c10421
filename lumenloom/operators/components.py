"""Connected components over a link table, by alternating star contraction.

Every round first contracts links inside each partition with a union-find (a spanning forest is
enough to keep connectivity, so a hot vertex shrinks before it is shuffled), then re-links each
vertex's neighbours to the smallest one. Rounds are written to the shared working folder; the
number of rounds is logarithmic in the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.session import discard, materialize

_LINKS = pa.schema([("hi", pa.int64()), ("lo", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex of their component, for the links a[i]-b[i]."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:  # pointer jumping
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return names, names[label]
        label = new


#: Links that one worker contracts at a time; bounds its memory, not the input.
CHUNK_LINKS = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        v, root = forest(np.concatenate([h for h, _ in held]), np.concatenate([x for _, x in held]))
        keep = v != root
        yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(root[keep])], schema=_LINKS)

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        rows += batch.num_rows
        if rows >= CHUNK_LINKS:
            yield from flush()
            held, rows = [], 0
    if rows:
        yield from flush()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)`` for every vertex of ``links``; component = smallest vertex reached.

    Nulls in either end and self-links are ignored, repeated links count once; no links give no rows.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).cast("bigint").alias("hi"), F.least(a, b).cast("bigint").alias("lo")
    )
    shape = "hi bigint, lo bigint"
    stars = materialize(pairs.mapInArrow(_contract, shape), "stars")
    for _ in range(max_rounds):
        # small star: a vertex and its smaller neighbours meet at the smallest of them
        best = stars.groupBy("hi").agg(F.min("lo").alias("root"), F.count(F.lit(1)).alias("n"))
        if best.where("n > 1").isEmpty():
            heads = stars.select(F.col("lo").alias("hi")).distinct()
            if stars.join(heads, "hi", "left_semi").isEmpty():
                break
        pulled = stars.join(best.select("hi", "root"), "hi").where("lo <> root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        # large star: what hangs below a vertex moves to that vertex's own root
        own = best.select(F.col("hi").alias("lo"), F.col("root").alias("up"))
        moved = best.select("hi", F.col("root").alias("lo")).join(own, "lo", "left").select("hi", F.coalesce("up", "lo").alias("lo"))
        following = materialize(pulled.unionByName(moved).distinct().mapInArrow(_contract, shape), "stars")
        discard(stars)
        stars = following
    else:
        raise RuntimeError("components did not settle")
    members = stars.select(F.col("hi").alias("vertex"), F.col("lo").alias("component"))
    heads = stars.select(F.col("lo").alias("vertex"), F.col("lo").alias("component")).distinct()
    return members.unionByName(heads)
