"""Pairs of texts within a share of their length in edits, without a join and without a broadcast.

Texts lie in classes of length, classes in blocks of bounded size; every two blocks that may hold a pair are a
task of their own. There the pairs are sifted by parity sketches of their runs of two and three characters, which can
only over-accept, and the few that are left are measured exactly. All pairs of fitting lengths are looked at:
the work grows with their number, at some nanoseconds each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.itemsets import scramble

#: Rows and characters of a block, on average.
BLOCK_ROWS, BLOCK_CHARACTERS = 2048, 4_000_000
#: Ratio of the lengths of a class: more than 10 / 9, so a pair lies in one class or in two neighbouring ones.
RATIO = 1.12
#: Rows compared with a whole block in one vectorised step; the largest sketch in bits.
STEP, MOST_BITS = 64, 4096
#: Pairs held against the finer sketch at once.
PAIRS = 4096
_PAIRS = "id_a bigint, id_b bigint, ta string, tb string, most int"
_EMPTY = pa.schema([("id_a", pa.int64()), ("id_b", pa.int64()), ("ta", pa.string()), ("tb", pa.string()), ("most", pa.int32())]).empty_table()


def sketches(points: np.ndarray, lengths: np.ndarray, bits: int, q: int) -> np.ndarray:
    """``bits`` parity bits a text of its runs of q characters. An edit removes q runs and brings q others
    at most, so the sketches of texts that are k edits apart differ in at most 2 q k bits."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.flatnonzero(owner[q - 1 :] == owner[: len(owner) - q + 1])
    run = np.zeros(len(inside), np.uint64)
    for i in range(q):
        run = run << np.uint64(21) | points[inside + i]  # a code point has 21 bits
    at = owner[inside] * bits + (scramble(run, 5) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=len(lengths) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(len(lengths), bits // 64)


def _near(table: pa.Table) -> Iterator[pa.Table]:
    """The pairs of a cell that may be near, some rows at a time; all of side 0 are paired with one another."""
    ids, texts = table.column("id").to_numpy(), table.column("text").to_pylist()
    lengths = np.array([len(t) for t in texts])
    side = table.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    low, high, i, j = (table.column(k)[0].as_py() for k in ("low", "high", "i", "j"))
    alone = (low, i) == (high, j)  # one block with itself
    right = left if alone else np.flatnonzero(side == 1)
    bits = min(MOST_BITS, 1 << max(9, math.ceil(math.log2(2 * int(lengths.max())))))
    wide = min(4 * MOST_BITS, 4 * bits)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    words, finer = sketches(points, lengths, bits, 2), sketches(points, lengths, wide, 3)
    columns = np.ascontiguousarray(words[right].T)
    for at in range(0, len(left), STEP):
        some = left[at : at + STEP]
        apart = np.zeros((len(some), len(right)), np.uint16)
        for w, column in enumerate(columns):
            apart += np.bitwise_count(words[some, w, None] ^ column[None])
        longer = np.maximum(lengths[some, None], lengths[None, right])
        most = (longer - 1) // 10  # fewer edits than a tenth
        near = (apart <= 4 * most) & (np.abs(lengths[some, None] - lengths[None, right]) <= most) & (ids[some, None] != ids[None, right])
        if alone:
            near &= some[:, None] < right[None]
        x, y = np.nonzero(near)
        a, b, most = some[x], right[y], most[x, y]
        # the few that are left are held against a finer sketch, some at a time
        keep = [np.bitwise_count(finer[a[i : i + PAIRS]] ^ finer[b[i : i + PAIRS]]).sum(1, dtype=np.int64) <= 6 * most[i : i + PAIRS] for i in range(0, len(a), PAIRS)]
        keep = np.concatenate([np.empty(0, bool), *keep])
        a, b, most = a[keep], b[keep], most[keep]
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        yield pa.table({"id_a": ids[a], "id_b": ids[b], "ta": pa.array([texts[i] for i in a], pa.string()), "tb": pa.array([texts[i] for i in b], pa.string()), "most": most.astype(np.int32)})


def _found(table: pa.Table) -> pa.Table:
    parts = list(_near(table))
    return pa.concat_tables(parts) if parts else _EMPTY


def pairs_within_a_tenth(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_a, id_b, edits)``: every two rows, id_a < id_b, whose texts are fewer edits apart than a tenth of
    the longer one's characters. Rows without id or text, and empty texts, are in no pair."""
    texts = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.floor(F.log(F.char_length(text_col)) / math.log(RATIO)).cast("int").alias("c")).where("id is not null and text <> ''")
    sizes = texts.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("characters")).collect()  # a row a class
    if not sizes:
        return rows.sparkSession.createDataFrame([], "id_a bigint, id_b bigint, edits int")
    blocks = F.create_map(*[F.lit(int(x)) for r in sizes for x in (r["c"], -(-max(r["n"] * BLOCK_CHARACTERS, r["characters"] * BLOCK_ROWS) // (BLOCK_ROWS * BLOCK_CHARACTERS)))])
    count = lambda c: F.coalesce(F.element_at(blocks, c), F.lit(0))
    placed = texts.withColumn("own", F.pmod(F.xxhash64("id", "text"), count(F.col("c"))).cast("int"))

    def cells(low, high, i, j, side):
        return F.struct(low.alias("low"), high.alias("high"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    def of(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast("array<struct<low:int,high:int,i:int,j:int,side:int>>"))

    c, own = F.col("c"), F.col("own")
    inside = of(count(c), lambda k: cells(c, c, F.least(own, k), F.greatest(own, k), own > k))
    above = of(count(c + 1), lambda k: cells(c, c + 1, own, k, F.lit(0)))
    below = of(count(c - 1), lambda k: cells(c - 1, c, k, own, F.lit(1)))
    dealt = placed.select("id", "text", F.explode(F.concat(inside, above, below)).alias("cell")).select("id", "text", "cell.*")
    near = dealt.groupBy("low", "high", "i", "j").applyInArrow(_found, _PAIRS)
    edits = F.expr("levenshtein(ta, tb, most)")  # -1 beyond
    return near.select("id_a", "id_b", edits.alias("edits")).where("edits >= 0")
