"""Problem 2: records of evaluation splits that stand, exactly or almost, in the training split.

An edit-distance segment join. A record is its sequence of distinct items, in one global order that
all records share (infrequent items first, then frequent ones by rising count). In such an order the
longest common subsequence of two records is their set of shared items, so

    likeness >= t  <=>  insert/delete distance <= a + b - 2 c(a, b),

with c(a, b) the fewest items that records of a and b items must share. An evaluation sequence of a
items is cut into k + 1 contiguous segments, k = a - c(a, b) being the most of its items that a
training record of b items may lack (once per class of sizes b): one segment stays whole. It is matched as a subsequence of the
training record, so items inserted there don't break it. Infrequent items are segments of their own;
of the others every segment has two items or more and is looked up by its first two, the last one
takes the rest. At low thresholds, where that needs more items than there are, as many further items
from the beginning are segments of their own as it takes. Matches count at allowed positions only (displaced by no more than the deletions and
insertions left), pass a parity sketch, and are verified by dynamic programming in a band.

The evaluation records are the query set: up to WAVE_BLOCKS blocks of them are indexed and broadcast, and
the training records stream past them where they lie. Scans would multiply with more evaluation records:
those meet the training records in the lists of problem 1 (``HeavyLight``), compared across only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.itemsets import ItemSets, most_differences, required_overlap
from lumenloom.llm.near_dup import HeavyLight
from lumenloom.operators import simjoin
from lumenloom.operators.simjoin import COPY, SET, digest, frequent_items, linked
from lumenloom.session import materialize

EVAL, TRAIN = 1, 2
#: Evaluation records of a block: bounds the broadcast index (about 1 KB a record) whatever the table.
BLOCK_RECORDS = 32_768
#: Blocks whose indexes are broadcast, all together; more evaluation records than that meet the training records in lists.
WAVE_BLOCKS = 2
#: The longest list, as a multiple of ``LIST_LIMIT``.
LONGEST = 5
#: Slots of a block's index, and bits of the bitmap before it, as powers of two.
SLOT_BITS = 21
BITMAP_BITS = 25
_CLASS_STARTS = np.unique(np.concatenate([np.arange(0, 20), (20 * 1.1 ** np.arange(120)).astype(np.int64)]))
#: Training records, and candidate entries, that a worker handles at once.
TRAIN_STEP = 2_000
STEP = 300_000
#: Pairs that the dynamic programme handles at once.
VERIFY_STEP = 512


class Order:
    """The global order of items, and the information of each."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, rows: int):
        self.frequent, self.rows = frequent, max(rows, 1)
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.lexsort((frequent, counts))] = np.arange(len(counts))

    def sequences(self, sets: ItemSets) -> tuple[ItemSets, np.ndarray]:
        """The sets with their items in the global order, and which items are infrequent."""
        rank = np.full(len(sets.flat), -1)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, sets.flat), len(self.frequent) - 1)
            known = self.frequent[at] == sets.flat
            rank[known] = self.rank[at[known]]
        order = np.argsort(rank, kind="stable")
        order = order[np.argsort(sets.owner[order].astype(np.uint16 if len(sets.sizes) <= 65536 else np.int64), kind="stable")]
        return ItemSets(sets.flat[order], sets.sizes), rank[order] < 0


def size_class(size: np.ndarray) -> np.ndarray:
    """Sizes in classes of a constant ratio; a segmentation is made for one class of partner sizes."""
    return np.searchsorted(_CLASS_STARTS, size, "right") - 1


def pair_key(first: np.ndarray, second: np.ndarray, partner: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (first * np.uint64(0xD1342543DE82EF95)) ^ (second * np.uint64(0x9E3779B97F4A7C15)) ^ (partner.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        return x ^ (x >> np.uint64(31))


def single_key(item: np.ndarray, partner: np.ndarray) -> np.ndarray:
    return pair_key(item, np.full_like(item, 0x5BD1E995), partner)


def ramp(n: np.ndarray) -> np.ndarray:
    """0 .. n[i] - 1 for each i, put together."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def slot_and_tag(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a key lies in the index, and 32 further bits to know it by (a wrong match fails the check that follows)."""
    return (key & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int32), (key >> np.uint64(SLOT_BITS)).astype(np.uint32)


class Block:
    """The segment index of a block of evaluation records."""

    def __init__(self, hashes: np.ndarray, sets: ItemSets, order: Order, permille: int):
        sequences, rare = order.sequences(sets)
        self.hashes, self.sequences = hashes, sequences
        self.sketch = [np.ascontiguousarray(x) for x in sets.sketch().T]
        sizes = sets.sizes
        alone = np.bincount(sets.owner, rare, len(sizes)).astype(np.int64)
        least, most = -(-sizes * permille // 1000), sizes * 1000 // permille
        keys, owners, places = [], [], []
        self.any_alone = False
        for partner in range(int(size_class(least).min()), int(size_class(most).max()) + 1):
            low = np.maximum(least, _CLASS_STARTS[partner])
            who = np.flatnonzero((low <= most) & (low < _CLASS_STARTS[partner + 1]))
            # the smallest partner of the class may lack the most
            parts = sizes[who] - required_overlap(sizes[who], low[who], permille) + 1
            # where so many may be lacking that two items a segment don't fit, the first ones have one each
            singles = np.maximum(np.minimum(alone[who], parts), 2 * parts - sizes[who])
            pairs = parts - singles
            self.any_alone |= bool((singles > alone[who]).any())
            for n, begin, key in ((singles, 0, single_key), (pairs, 1, pair_key)):
                owner = np.repeat(who, n)
                place = np.repeat(singles, n) + 2 * ramp(n) if begin else ramp(n)
                at = sequences.starts[owner] + place
                same = np.full(len(at), partner)
                keys.append(key(sequences.flat[at], sequences.flat[at + 1], same) if begin else key(sequences.flat[at], same))
                owners.append(owner)
                places.append(place)
        key = np.concatenate(keys)
        slot, tag = slot_and_tag(key)
        by = np.argsort(slot, kind="stable")
        self.tag, self.owner, self.place = tag[by], np.concatenate(owners)[by].astype(np.int32), np.concatenate(places)[by].astype(np.int32)
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=1 << SLOT_BITS))]).astype(np.int32)
        bit = key >> np.uint64(64 - BITMAP_BITS)
        self.bitmap = np.packbits(np.bincount(bit.astype(np.int64), minlength=1 << BITMAP_BITS) > 0, bitorder="little")

    def may_hold(self, key: np.ndarray) -> np.ndarray:
        bit = key >> np.uint64(64 - BITMAP_BITS)
        return np.flatnonzero((self.bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)


@lru_cache(maxsize=100_000)
def last_begin(size: int, permille: int) -> int:
    """The farthest place in a record of ``size`` items at which a partner's two-item segment can begin: a
    segment begins at twice the partner's deletions at most, and moves by the insertions at most."""
    partner = np.arange(-(-size * permille // 1000), size * 1000 // permille + 1)
    shared = required_overlap(partner, size, permille)
    return int((2 * (partner - shared) + size - shared).max())


def match(block: Block, hashes: np.ndarray, sets: ItemSets, order: Order, permille: int) -> Iterator[tuple[np.ndarray, np.ndarray, ItemSets]]:
    """(evaluation index, training index, training sequences) of distinct candidates, some at a time."""
    sketch = [np.ascontiguousarray(x) for x in sets.sketch().T]
    sequences, rare = order.sequences(sets)
    owner = sequences.owner.astype(np.int32)
    size_of = sets.sizes[owner].astype(np.int32)
    eval_sizes = block.sequences.sizes.astype(np.int32)
    class_of = size_class(sets.sizes)[owner]
    place = (np.arange(len(sequences.flat)) - sequences.starts[owner]).astype(np.int32)
    longest = int(sets.sizes.max(initial=0))
    spare = size_of - -(-size_of * permille // 1000)  # items that the training record has and its partner lacks
    # a pair's first item stands behind the infrequent items
    behind = np.repeat(np.bincount(sequences.owner, rare, len(sets.sizes)).astype(np.int64), sets.sizes)
    last = np.array([last_begin(n, permille) for n in sets.sizes.tolist()])[owner]
    open_ = ~rare & (behind <= spare) & (place <= last)
    sums = np.arange(int(eval_sizes.max(initial=0)) + longest + 1)
    allowed = most_differences(sums, 0, permille).astype(np.int32)  # it depends on the sum of both sizes
    seen: list[np.ndarray] = []
    for gap in range(-1, longest - 1):
        if gap < 0:
            at = np.flatnonzero((rare | block.any_alone) & (place <= spare))
            key = single_key(sequences.flat[at], class_of[at])
        else:
            at = np.flatnonzero(open_ & (gap <= spare) & (place + gap + 1 < size_of))
            if not len(at):
                break
            key = pair_key(sequences.flat[at], sequences.flat[at + gap + 1], class_of[at])
        hit = block.may_hold(key)
        at, key = at[hit], key[hit]
        slot, tag = slot_and_tag(key)
        start = block.offsets[slot]
        n = block.offsets[slot + 1] - start
        total = np.cumsum(n)
        done = 0
        while done < len(at):
            to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + STEP, "right")))
            m = n[done:to]
            entry = np.repeat(start[done:to] - np.cumsum(m, dtype=np.int32) + m, m) + np.arange(m.sum(), dtype=np.int32)
            e = block.owner[entry]
            who = owner[at[done:to]]
            # first the sketches, with the differences that the two sizes allow: few entries are left
            apart = np.bitwise_count(block.sketch[0][e] ^ np.repeat(sketch[0][who], m))
            apart += np.bitwise_count(block.sketch[1][e] ^ np.repeat(sketch[1][who], m))
            near = np.flatnonzero(apart <= allowed[eval_sizes[e] + np.repeat(size_of[at[done:to]], m)])
            each = done + np.searchsorted(np.cumsum(m), near, "right")
            entry, e, own = entry[near], e[near], at[each]
            t, size, other = owner[own], eval_sizes[e], size_of[own]
            shared = (size + other - allowed[size + other]) >> 1
            # displaced to the right by at most the insertions, to the left by at most the deletions
            moved = place[own] - block.place[entry]
            ok = (block.tag[entry] == tag[each]) & (moved <= other - shared) & (-moved <= size - shared) & (block.hashes[e] != hashes[t])
            if ok.any():
                seen.append(np.unique(e[ok].astype(np.int64) << 32 | t[ok]))
            done = to
    found = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int64)
    for i in range(0, len(found), VERIFY_STEP):
        yield found[i : i + VERIFY_STEP] >> 32, found[i : i + VERIFY_STEP] & 0xFFFFFFFF, sequences


def banded_distance(x: ItemSets, y: ItemSets, band: np.ndarray) -> np.ndarray:
    """Insert/delete distance of sequence pairs, by dynamic programming in a band, all pairs at once; a
    distance beyond the pair's ``band`` comes out as some value beyond it.

    A path of cost k from a sequence of n to one of m items leaves the main diagonal by at most
    (k + n - m) / 2 deletions and (k + m - n) / 2 insertions. A pair whose whole row exceeds its bound is
    dropped: as the rarest items come first, unlike pairs end after a few rows.
    """
    far = np.int32(1 << 20)
    out = np.full(len(band), far, np.int32)
    behind = np.maximum((band + x.sizes - y.sizes) >> 1, 0)
    ahead = np.maximum((band + y.sizes - x.sizes) >> 1, 0)
    left, right = int(behind.max(initial=0)), int(ahead.max(initial=0))
    n, m = int(x.sizes.max(initial=0)), int(y.sizes.max(initial=0))
    a = np.zeros((len(band), n + 1), np.uint64)
    b = np.ones((len(band), left + max(n, m) + right + 2), np.uint64)
    a[x.owner, np.arange(len(x.flat)) - x.starts[x.owner]] = x.flat
    b[y.owner, np.arange(len(y.flat)) - y.starts[y.owner] + left] = y.flat
    diagonal = np.arange(-left, right + 1, dtype=np.int32)
    row = np.where(diagonal >= 0, diagonal, far)[None, :].repeat(len(band), 0)  # row[d]: cell (i, i + d)
    pair = np.arange(len(band))  # the pairs still open
    for i in range(n + 1):
        if i:
            j = i + diagonal
            best = np.where(b[:, i - 1 : i + left + right] == a[:, i - 1 : i], row, far)  # both step: same diagonal
            best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)  # drop a[i]: (i-1, j)
            best[:, j < 0] = far
            # insert b[j]: (i, j-1), a prefix minimum along the row
            row = np.minimum.accumulate(best - diagonal, 1) + diagonal
            row[:, j < 0] = far
        done = x.sizes[pair] == i
        if done.any():
            which = pair[done]
            d = y.sizes[which] - i + left
            inside = (d >= 0) & (d <= left + right)
            out[which[inside]] = row[done][inside, d[inside]]
        if i % 4 == 3 or done.any():
            keep = ~done & (row.min(1) <= band[pair])
            if not keep.all():
                pair, row, a, b = pair[keep], row[keep], a[keep], b[keep]
                if not len(pair):
                    break
    return out


def cross_split_pairs(records: DataFrame, id_col: str, text_col: str, split_col: str, permille: int = 700, least_items: int = 5, evaluation: tuple[str, ...] = ("val", "test"), training: str = "train") -> DataFrame:
    """``(eval_id, train_id, likeness)``: every pair of an evaluation and a training record at least
    permille/1000 alike, exact copies included.

    Rows without id, text or one of the named splits, and texts of fewer than ``least_items`` distinct
    items, take no part. Repeated ids count once a pair. Very long texts are taken whole. No rows in,
    no rows out. Other columns are not read, whatever their names.
    """
    tag = F.when(F.col(split_col).isin(*evaluation), EVAL).when(F.col(split_col) == training, TRAIN)
    source = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), tag.alias("tag")).where("id is not null and text is not null and tag is not null")
    digested = digest(source, least_items)
    links = alike_across(digested, permille)
    rows = digested.where(F.col("kind").isin(SET, COPY)).select("key", "id", "tag").distinct()
    left = rows.where(F.col("tag") == EVAL).select(F.col("key").alias("a"), F.col("id").alias("eval_id"))
    right = rows.where(F.col("tag") == TRAIN).select(F.col("key").alias("b"), F.col("id").alias("train_id"))
    copies = left.join(right, F.col("a") == F.col("b")).select("eval_id", "train_id", F.lit(1.0).alias("likeness"))
    near = links.join(left, "a").join(right, "b").select("eval_id", "train_id", "likeness")
    return copies.unionByName(near)


def alike_across(digested: DataFrame, permille: int) -> DataFrame:
    """(a, b, likeness): evaluation set a, training set b, alike and not the same."""
    spark = digested.sparkSession
    frequent, counts, rows = frequent_items(digested)
    order = Order(frequent, counts, rows)
    sets = digested.where(F.col("kind") == SET)
    evaluation = sets.where(F.col("tag") == EVAL).select("key", "blob").dropDuplicates(["key"])
    training = sets.where(F.col("tag") == TRAIN).select("key", "blob")
    evaluations = evaluation.count()
    blocks = -(-evaluations // BLOCK_RECORDS)
    if blocks > WAVE_BLOCKS:
        # a list is compared across only: it may be the longer, the smaller the share of one side
        share = min(evaluations / max(rows, 1), 0.5)
        limit = int(simjoin.LIST_LIMIT * min(LONGEST, 0.5 / (share * (1 - share))))
        links = linked(digested, HeavyLight(frequent, counts, rows, permille, limit), permille, (EVAL, TRAIN), limit)
        return links.selectExpr("a", "b", "shared / (size_a + size_b - shared) as likeness")
    number = F.pmod(F.xxhash64("key"), F.lit(blocks))
    shape = "a bigint, b bigint, likeness double"
    indexes = []
    for block in range(blocks):
        mine = evaluation.where(number == block).toArrow()
        if mine.num_rows:
            indexes.append(Block(mine.column(0).to_numpy(), ItemSets.of_blobs(mine.column(1)), order, permille))
    if not indexes:
        return spark.createDataFrame([], shape)
    shared = spark.sparkContext.broadcast((indexes, order))
    found = materialize(training.mapInArrow(_against(shared, permille), shape), "across")
    shared.destroy()
    return found.distinct()


def _against(shared: Broadcast, permille: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, order = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TRAIN_STEP):
                part = batch.slice(at, TRAIN_STEP)
                hashes, sets = part.column(0).to_numpy(zero_copy_only=False), ItemSets.of_blobs(part.column(1))
                for block in indexes:
                    for e, t, sequences in match(block, hashes, sets, order, permille):
                        x, y = block.sequences.pick(e), sequences.pick(t)
                        bound = most_differences(x.sizes, y.sizes, permille)
                        distance = banded_distance(x, y, bound)
                        keep = distance <= bound
                        common = (x.sizes + y.sizes - distance) / 2
                        likeness = common / (x.sizes + y.sizes - common)
                        yield pa.RecordBatch.from_arrays([pa.array(block.hashes[e][keep]), pa.array(hashes[t][keep]), pa.array(likeness[keep])], names=["a", "b", "likeness"])

    return run


def overlap_report(pairs: DataFrame, records: DataFrame, id_col: str, split_col: str, source_col: str) -> DataFrame:
    """(split, source, overlapping, pairs): per evaluation split and source, the records with an overlap and the pairs."""
    from lumenloom.functions.text import bare

    named = records.select(F.col(id_col).alias("eval_id"), F.col(split_col).alias("split"), bare(F.col(source_col)).alias("source"))
    per_record = pairs.groupBy("eval_id").agg(F.count(F.lit(1)).alias("n"))
    return per_record.join(named, "eval_id").groupBy("split", "source").agg(F.count(F.lit(1)).alias("overlapping"), F.sum("n").alias("pairs"))
