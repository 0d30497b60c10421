"""Set-similarity self-join engine: digest texts once, meet in keyed lists, verify exactly.

``digest`` turns texts into a table of distinct item sets, memberships and item counts, collapsing
exact copies inside each task first. An emitter names the lists that each set enters; ``meet`` brings
the lists together in buckets, a bounded share of all lists at a time, and compares the members of
each list with 192-bit parity sketches that can only over-accept; ``verify`` keeps the pairs whose
exact likeness is high enough. Lists that outgrow a task are cut into a grid of blocks, each pair of
blocks a task of its own, so no list is ever capped or held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import comb
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.itemsets import ITEM_MASK, ItemSets, binary_parts, by_owner, item_sets, most_differences, new_memory, scramble
from lumenloom.session import discard, materialize

#: What a list knows of a member: the list's key, the set's hash, the three words of its sketch, its size,
#: and the largest partner that it can be alike with if the list's items are the first ones they share.
MEMBER = np.dtype([("key", "<u8"), ("h", "<i8"), ("a", "<u8"), ("b", "<u8"), ("c", "<u8"), ("n", "<u2"), ("most", "<u2")])
#: A size that stands for itself and all larger ones.
HUGE = 65535
#: Members a task compares as one list; longer lists are split by a further item, or go through the grid.
LIST_LIMIT = 20_000
#: Members of a bucket of lists, and those a task holds before it looks for lists that are too long.
BUCKET_MEMBERS, HELD_MEMBERS = 60_000, 1_000_000
#: Bytes of list members a set may cause at a time, and those that never need a second wave; the lists are
#: dealt out to as many waves as that takes.
WAVE_BYTES, ONE_WAVE_BYTES = 400, 64 << 20
#: Sets from which the number of lists a set enters is reckoned; the number only lays out the work.
RECKONED_SETS = 2_000
#: Rows and columns of a block, and the members from which a list is compared block by block.
BLOCK, COLUMNS, BLOCKWISE = 32, 4096, 256
#: Differences up to which one word of the sketch tells most pairs apart.
ONE_WORD = 19
#: Pairs compared in one vectorised step.
PAIR_STEP = 400_000
#: Lists that a set may enter for subsets of up to r items; a larger set takes a smaller r.
SUBSET_KEYS = 1000
#: Sets, or counts of items, that a task remembers at a time.
REMEMBERED = 2_000_000

SET, COPY, ITEM = 0, 1, 2
_DIGEST = "kind int, key bigint, id bigint, tag int, blob binary"
_DIGEST_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("tag", pa.int32()), ("blob", pa.binary())])


def digest(texts: DataFrame, least_items: int = 5) -> DataFrame:
    """``texts``: (id bigint, text string, tag int). One written table of three kinds of rows:

    SET (key = set hash, id, tag, blob = items), once a task and distinct set and tag; COPY (key, id,
    tag), the further rows with that set; ITEM (key = item, id = rows holding it, in this task).
    Null texts and texts of fewer than ``least_items`` distinct items give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen, tally = new_memory(), set(), Tally()
        for batch in batches:
            sets = item_sets(batch.column(1).to_pylist(), memory)
            enough = sets.sizes >= least_items
            if not enough.any():
                continue
            sets = sets.take(enough)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[enough]
            tags = batch.column(2).to_numpy(zero_copy_only=False)[enough].astype(np.int32)
            hashes = sets.identity()
            if len(seen) > REMEMBERED:  # from here on a set may come out once more: it counts as a copy there
                seen.clear()
            first = np.zeros(len(ids), bool)
            for i, mark in enumerate(zip(hashes.tolist(), tags.tolist(), strict=True)):
                if mark not in seen:
                    seen.add(mark)
                    first[i] = True
            new = sets.take(first)
            if first.any():
                yield _rows(SET, hashes[first], ids[first], tags[first], new.blobs())
            if not first.all():
                yield _rows(COPY, hashes[~first], ids[~first], tags[~first], None)
            tally.add(sets.flat)
            if tally.held > REMEMBERED:
                yield from tally.rows()
        yield from tally.rows()

    return materialize(texts.select(F.col("id").cast("bigint"), "text", F.col("tag").cast("int")).mapInArrow(run, _DIGEST), "digest")


class Tally:
    """Counts of items, merged now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.fresh = 0

    def add(self, flat: np.ndarray) -> None:
        part = np.unique(flat, return_counts=True)
        self.parts.append(part)
        self.fresh += len(part[0])
        self.held += len(part[0])
        if self.fresh > 500_000:
            self._merge()

    def _merge(self) -> None:
        names, where = np.unique(np.concatenate([n for n, _ in self.parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([c for _, c in self.parts]), len(names)).astype(np.int64)
        self.parts, self.held, self.fresh = [(names, counts)], len(names), 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            names, counts = self.parts[0]
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000].view(np.int64)
                yield _rows(ITEM, part, counts[at : at + 50_000], np.zeros(len(part), np.int32), None)
        self.parts, self.held, self.fresh = [], 0, 0


def _rows(kind: int, key: np.ndarray, ids: np.ndarray, tags: np.ndarray, blobs: pa.Array | None) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(key), pa.array(ids), pa.array(tags), pa.nulls(n, pa.binary()) if blobs is None else blobs], schema=_DIGEST_ARROW)


def frequent_items(digested: DataFrame, share: float = 1 / 20_000, at_least: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
    """Items held by more than max(at_least, share * rows) rows, their counts, and the number of rows.

    As a row with s items counts s times, at most (mean s) / share items qualify (a million of 16 bytes for
    texts of 50 items): the table that goes to the driver and into the tasks is bounded whatever the number
    of rows. The items left have lists of at most that share of the rows.
    """
    rows = digested.where(F.col("kind") < ITEM).count()
    limit = max(at_least, int(share * rows))
    found = digested.where(F.col("kind") == ITEM).groupBy("key").agg(F.sum("id").alias("n")).where(F.col("n") > limit).toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy(np.int64)[order], rows


class Entries(NamedTuple):
    """The lists that a batch of sets enters: list key, index of the set, largest partner it can have there."""

    key: np.ndarray
    owner: np.ndarray
    most: np.ndarray

    @staticmethod
    def together(parts: list[Entries]) -> Entries:
        return Entries(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Entries(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))

    def of_wave(self, wave: int, waves: int) -> Entries:
        keep = wave_of(self.key, waves) == wave
        return Entries(*(x[keep] for x in self))


class Emitter(Protocol):
    """Gives every set's lists, those of one wave at a time; two alike sets share a list of some wave."""

    def __call__(self, sets: ItemSets, wave: int, waves: int) -> Entries: ...


def wave_of(key: np.ndarray, waves: int) -> np.ndarray:
    return (key >> np.uint64(20)) % np.uint64(waves)


class PrefixLists:
    """List keys under which every two alike sets meet: subsets of a prefix, from the rarest item to the commonest.

    In one order of all items (infrequent ones first, then by count) the first shared item of two alike
    sets has at most s - ceil(t s) items of either before it, the second shared one at most one more, and
    so on. A set enters the list of each item that may be its first shared one. If the counts let a list
    expect more than LIST_LIMIT rows, it is split by the item that may be shared next, up to r items a
    key. r depends on a set's size; a set also enters the lists of the r of larger partners. Exact for
    every pair, whatever the counts say: all tasks have the same counts, so both sets split alike.

    The d items of a set before its first shared ones are lost to the overlap. c(s, p) <= s - d holds
    for partners of up to (s - d)(1 + t) / t - s items only: that is the entry's ``most``.
    """

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, rows: int, permille: int, limit: int | None = None):
        self.frequent, self.permille, self.rows, self.limit = frequent, permille, max(rows, 1), limit or LIST_LIMIT
        self.reach = [max(s for s in range(SUBSET_KEYS) if comb(s + r, r) <= SUBSET_KEYS) for r in (2, 3)]
        by_count = np.lexsort((frequent, counts))
        self.rank = np.empty(len(frequent), np.int64)
        self.rank[by_count] = np.arange(len(frequent))
        self.ranked, self.ranked_count = frequent[by_count], counts[by_count].astype(float)

    def spare(self, sizes: np.ndarray) -> np.ndarray:
        """Items that an alike partner may lack."""
        return sizes - -(-sizes * self.permille // 1000)

    def longest(self, sizes: np.ndarray) -> np.ndarray:
        """Items of a key, at most, by the size of the larger set of a pair."""
        spare = self.spare(sizes)
        return 1 + sum((spare <= s).astype(np.int64) for s in self.reach)

    def most(self, sizes: np.ndarray, lost: np.ndarray) -> np.ndarray:
        """The largest partner of a set that has lost some items to the overlap."""
        return (sizes - lost) * (1000 + self.permille) // self.permille - sizes

    def ordered(self, sets: ItemSets) -> tuple[np.ndarray, np.ndarray]:
        """The items of each set in the global order, and their counts (0 for an infrequent one)."""
        if not len(self.frequent):
            return sets.flat, np.zeros(len(sets.flat))
        at = np.minimum(np.searchsorted(self.frequent, sets.flat), len(self.frequent) - 1)
        known = self.frequent[at] == sets.flat
        # owner, whether frequent, and rank or item in one integer: a plain sort does it
        word = np.where(known, np.uint64(ITEM_MASK + 1) | self.rank[at].astype(np.uint64), sets.flat)
        flat = np.empty_like(word)
        count = np.zeros(len(word))
        for low in range(0, len(sets.sizes), 1 << 15):
            part = slice(int(sets.starts[low]), int(sets.starts[low] + sets.sizes[low : low + (1 << 15)].sum()))
            sorted_ = np.sort((sets.owner[part] - low).astype(np.uint64) << np.uint64(49) | word[part])
            value = sorted_ & np.uint64(ITEM_MASK)
            common = (sorted_ & np.uint64(ITEM_MASK + 1)) > 0
            rank = value[common].astype(np.int64)
            value[common] = self.ranked[rank]
            flat[part] = value
            count[part][common] = self.ranked_count[rank]
        return flat, count

    def __call__(self, sets: ItemSets, wave: int = 0, waves: int = 1) -> Entries:
        sizes = sets.sizes
        flat, count = self.ordered(sets)
        spare, ends = self.spare(sizes), sets.starts + sizes
        own, least = self.longest(sizes), self.longest(sizes * 1000 // self.permille)
        least = np.where(sizes - spare < 3, 1, least)  # so small that alike sets may share fewer than three items
        lost = np.arange(len(flat)) - sets.starts[sets.owner]
        last = np.flatnonzero(lost <= spare[sets.owner])
        key = scramble(flat[last], 7)
        mine = wave_of(key, waves) == wave  # a wave has the subsets that begin with its items
        last, key = last[mine], key[mine]
        owner, members, lost = sets.owner[last], count[last], lost[last]
        parts = []
        for items in (1, 2, 3):
            short = members <= self.limit
            enter, split = short | (items >= least[owner]), ~short & (items < own[owner])
            parts.append(Entries(key[enter], owner[enter], self.most(sizes[owner[enter]], lost[enter])))
            owner, key, members, last, lost = owner[split], key[split], members[split], last[split], lost[split]
            # the next shared item lies at most one place further than the one before may
            choices = np.maximum(np.minimum(sets.starts[owner] + spare[owner] + items + 1, ends[owner]) - last - 1, 0)
            which = np.repeat(np.arange(len(owner)), choices)
            step = np.arange(len(which)) - np.repeat(np.cumsum(choices) - choices, choices)
            last = last[which] + 1 + step
            owner, members, lost = owner[which], members[which] * count[last] / self.rows, lost[which] + step
            key = scramble(key[which] ^ scramble(flat[last], 77), 5)
        return Entries.together(parts)


def linked(digested: DataFrame, emit: Emitter, permille: int, sides: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    """(a, b, shared, size_a, size_b): the distinct sets that are alike, as hashes, written once."""
    pairs, tables = meet(digested, emit, permille, sides, limit)
    links = materialize(verify(digested, pairs, permille), "links")
    for table in tables:
        discard(table)
    return links


def meet(digested: DataFrame, emit: Emitter, permille: int, sides: tuple[int, int] | None = None, limit: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b), and the tables it is read from: distinct pairs of set hashes (a < b) that some list brings together and the sketches let pass;
    they still need ``verify``. With ``sides``, two tags, a is a set of the first tag and b one of the second.

    A wave's lists travel in buckets, each a bounded number of members; what a wave finds is written and
    its shuffle deleted before the next one begins. No sets, no pairs.
    """
    side = F.when(F.col("tag") == sides[1], 1).otherwise(0) if sides else F.lit(0)
    sets = digested.where(F.col("kind") == SET).select("key", "blob", side.alias("side"))
    compare, limit = _across if sides else _comparer, limit or LIST_LIMIT
    total = sets.count()
    waves, buckets = _layout(sets, total, emit)
    found, long, tables = [], [], []
    for wave in range(waves):
        lists = sets.mapInArrow(_keyed(emit, wave, waves, buckets, sides is not None), _LIST)
        met = materialize(_gathered(lists, buckets).mapInArrow(compare(permille, limit), _MET), "met")
        tables.append(met)
        found.append(met.where("key is null").select("a", "b"))
        long.append(met.where("key is not null").select("key", "blob"))
    pairs, over = _union(found), _union(long)
    blocks = over.groupBy("key").agg(F.ceil(F.sum(F.length("blob")) / (MEMBER.itemsize * limit // 2)).cast("bigint").alias("blocks"))
    if not over.isEmpty():
        cells = over.join(blocks, "key").mapInArrow(_grid(sides is not None), _LIST)
        rest = materialize(cells.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare(permille, None), _MET), "grid")
        tables.append(rest)
        pairs = pairs.unionByName(rest.select("a", "b"))
    return pairs.distinct(), tables


_LIST, _MET = "bucket bigint, blob binary", "a bigint, b bigint, key bigint, blob binary"


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _layout(sets: DataFrame, total: int, emit: Emitter) -> tuple[int, int]:
    """Waves, and buckets of a wave, by the lists that some sets enter. Only the layout depends on it."""
    some = ItemSets.of_blobs(sets.limit(RECKONED_SETS).toArrow().column("blob"))
    each = len(emit(some, 0, 1).key) / max(len(some.sizes), 1)
    waves = max(1, -(-int(each * total * MEMBER.itemsize) // max(WAVE_BYTES * total, ONE_WAVE_BYTES)))
    return waves, max(1, -(-int(each * total) // (waves * BUCKET_MEMBERS)))


def _gathered(lists: DataFrame, buckets: int) -> DataFrame:
    few = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(max(few, -(-buckets // 8)), "bucket").sortWithinPartitions("bucket")


def _keyed(emit: Emitter, wave: int, waves: int, buckets: int, sided: bool):
    """Maps (key, blob, side) of sets to (bucket, blob): the list members, put together for each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = ItemSets.of_blobs(batch.column(1))
            entries = emit(sets, wave, waves)
            if not len(entries.key):
                continue
            sketch = sets.sketch(3)
            owner = entries.owner
            member = np.empty(len(owner), MEMBER)
            member["key"], member["h"] = entries.key, batch.column(0).to_numpy(zero_copy_only=False)[owner]
            member["a"], member["b"], member["c"] = sketch[owner, 0], sketch[owner, 1], sketch[owner, 2]
            member["n"], member["most"] = np.minimum(sets.sizes[owner], HUGE), np.minimum(entries.most, HUGE)
            if sided:
                side = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
                member["key"] = entries.key & ~np.uint64(1) | side[owner]
            yield _lists(((entries.key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), member)

    return run


def _lists(bucket: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, member = bucket[order], member[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    offsets = np.append(starts, len(bucket)).astype(np.int32) * MEMBER.itemsize
    blob = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(member.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), blob], names=["bucket", "blob"])


def _grid(sided: bool):
    """Each member of a long list goes to the cells (i, j) of its own block i; a cell is a list and a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob, blocks in zip(*(batch.column(c).to_pylist() for c in ("key", "blob", "blocks")), strict=True):
                member = np.frombuffer(blob, MEMBER)
                block = member["h"].view(np.uint64) % np.uint64(blocks)
                for i in range(blocks):
                    mine = member[block == i]
                    side = mine["key"] & np.uint64(1)
                    for j in range(blocks if len(mine) else 0):
                        cell = scramble(np.array([key ^ (min(i, j) * blocks + max(i, j))], np.int64).view(np.uint64), 11)[0]
                        mine["key"] = cell & ~np.uint64(1) | side if sided else cell
                        yield _lists(np.full(len(mine), np.int64(cell.view(np.int64))), mine)

    return run


class _comparer:
    """Maps (bucket, blob), ordered by bucket, to pairs (a, b); lists of more than ``limit`` members come
    out as (key, blob), some members at a time, as soon as they are found to be long."""

    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("blob", pa.binary())])

    def __init__(self, permille: int, limit: int | None):
        self.permille, self.limit = permille, limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.words, self.bits = np.empty(BLOCK * COLUMNS, np.uint64), np.empty((2, BLOCK * COLUMNS), np.uint8)
        now, held, size, room, long = None, [], 0, HELD_MEMBERS, np.empty(0, np.uint64)
        for batch in batches:
            buckets = batch.column(0).to_numpy(zero_copy_only=False)
            ends, data = binary_parts(batch.column(1))
            member, ends = data.view(MEMBER), ends // MEMBER.itemsize
            starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else ()
            for first, behind in zip(starts, [*starts[1:], len(buckets)], strict=True):
                if buckets[first] != now:
                    yield from self.close(held, long)
                    now, held, size, room, long = buckets[first], [], 0, HELD_MEMBERS, np.empty(0, np.uint64)
                held.append(member[ends[first] : ends[behind]])
                size += len(held[-1])
                if self.limit and size > room:
                    yield from self.shed(held, long)
                    names = self.list_of(held[0]["key"])
                    long = np.union1d(long, self.long_ones(names))
                    held = [held[0][~np.isin(names, long)]]
                    size, room = len(held[0]), len(held[0]) + HELD_MEMBERS
        yield from self.close(held, long)

    def list_of(self, key: np.ndarray) -> np.ndarray:
        """The list that a key names."""
        return key

    def long_ones(self, keys: np.ndarray) -> np.ndarray:
        names, n = np.unique(keys, return_counts=True)
        return names[n > self.limit]

    def shed(self, held: list[np.ndarray], long: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Puts what is held together and lets the members of long lists out."""
        member = np.concatenate(held)
        held[:] = [member]
        names = self.list_of(member["key"])
        yield from self.out(member[np.isin(names, np.union1d(long, self.long_ones(names)))])

    def out(self, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lets members go, list by list."""
        if not len(gone):
            return
        gone = gone[np.argsort(gone["key"], kind="stable")]
        names = self.list_of(gone["key"])
        for some in np.split(gone, np.flatnonzero(names[1:] != names[:-1]) + 1):
            for at in range(0, len(some), HELD_MEMBERS):
                part = some[at : at + HELD_MEMBERS]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([self.list_of(part["key"][:1])[0].view(np.int64)]), pa.array([part.tobytes()], pa.binary())], schema=self.shape)

    def close(self, held: list[np.ndarray], long: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        member = np.concatenate(held)
        if len(long):
            told = np.isin(self.list_of(member["key"]), long)
            yield from self.out(member[told])
            member = member[~told]
        # one sort by list and size: a list is known by 48 bits here, two that fall together are compared as one
        order = np.argsort(self.place(member["key"], member["n"]))
        member = member[order]
        place = self.place(member["key"], member["n"])
        name = self.list_of(place >> np.uint64(16))
        starts = np.flatnonzero(np.append(True, name[1:] != name[:-1]))[: len(member)]
        length = np.diff(np.append(starts, len(member)))
        if self.limit and (length > self.limit).any():
            over = np.repeat(length > self.limit, length)
            yield from self.out(member[over])
            member, place, length = member[~over], place[~over], length[length <= self.limit]
            starts = np.cumsum(length) - length
        short = (length > 1) & (length < BLOCKWISE)
        mine = np.repeat(short, length)
        found = [self.pairs_of(member[mine], place[mine])]
        found += [self.blocks_of(member[at : at + n]) for at, n in zip(starts[length >= BLOCKWISE].tolist(), length[length >= BLOCKWISE].tolist(), strict=True)]
        held, size = [], 0
        for x, y in chain.from_iterable(found):
            held.append(self.directed(x, y))
            size += len(x)
            if size > PAIR_STEP:
                yield self.pairs(held)
                held, size = [], 0
        if size:
            yield self.pairs(held)

    def pairs(self, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], schema=self.shape)

    def directed(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(x, y), np.maximum(x, y)

    def place(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Where a member stands in the order of lists and sizes."""
        return (key << np.uint64(16)) | n.astype(np.uint64)

    def windows(self, place: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The members that are the smaller sets of pairs, and where their partners of fitting sizes begin and end."""
        rows = np.flatnonzero(most >= n)
        last = place[rows] | np.uint64(HUGE)
        return rows, rows + 1, np.searchsorted(place, last ^ np.uint64(HUGE) | most[rows].astype(np.uint64), "right")

    def pairs_of(self, member: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of fitting sizes of each of many short lists, some at a time: first by two words of the
        sketch, then by all three and the exact bounds."""
        n, most, a, b, c, h = (np.ascontiguousarray(member[x]) for x in ("n", "most", "a", "b", "c", "h"))
        rows, begin, end = self.windows(place, n, most)
        some = end > begin
        rows, begin, count = rows[some], begin[some], (end - begin)[some]
        # differences that a set of a size allows, as a share of the pair's, rounded up
        share = (-(-n.astype(np.int64) * (1000 - self.permille) // (1000 + self.permille))).astype(np.int32)
        total = np.cumsum(count)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIR_STEP, "right")))
            m, x = count[at:to], rows[at:to]
            right = np.arange(m.sum()) + np.repeat(begin[at:to] - (np.cumsum(m) - m), m)
            apart = np.bitwise_count(np.repeat(a[x], m) ^ a[right])
            apart += np.bitwise_count(np.repeat(b[x], m) ^ b[right])
            near = np.flatnonzero(apart <= np.repeat(share[x], m) + share[right])
            x, y = np.repeat(x, m)[near], right[near]
            sketches = apart[near].astype(np.int64) + np.bitwise_count(c[x] ^ c[y])
            keep = (sketches <= most_differences(n[x].astype(np.int64), n[y], self.permille)) | (np.maximum(n[x], n[y]) == HUGE)
            keep &= (n[y] <= most[x]) & (n[x] <= most[y]) & (h[x] != h[y])
            yield h[x[keep]], h[y[keep]]
            at = to

    def blocks_of(self, member: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of one longer list, block by block. Rows are the smaller sets of the pairs: those that
        can have a partner of their own size. A block's columns are the sets of fitting sizes.

        Sizes n and m allow at most (n + m)(1 - t) / (1 + t) differences: a share of the row's plus a share
        of the column's, each rounded up. Two words of the sketch (one, where few differences are allowed) are held against that, in single bytes;
        the others and the exact bound come to the few pairs that are left.
        """
        n, most, a, b, c, h, share = columns = self.columns_of(member)
        rows = np.flatnonzero(most >= n)
        rows = rows[np.argsort(most[rows], kind="stable")]
        begin, end = np.searchsorted(n, n[rows], "left"), np.searchsorted(n, most[rows], "right")
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            low, high = int(begin[at : at + BLOCK].min()), int(end[at : at + BLOCK].max())
            for x, y in self.near(columns, some, columns, low + np.flatnonzero(most[low:high] >= n[low])):
                keep = y > x
                if keep.any():
                    yield h[x[keep]], h[y[keep]]

    def columns_of(self, member: np.ndarray) -> tuple[np.ndarray, ...]:
        """(n, most, a, b, c, h, share of the differences) of members by size, each set once."""
        member = member[np.lexsort((member["h"], member["n"]))]
        member = member[np.append(True, member["h"][1:] != member["h"][:-1])]  # a copy that another task has told of
        n, most, a, b, c, h = (np.ascontiguousarray(member[x]) for x in ("n", "most", "a", "b", "c", "h"))
        share = np.minimum(-(-n.astype(np.int64) * (1000 - self.permille) // (1000 + self.permille)), 127).astype(np.int8)
        return n, most, a, b, c, h, np.maximum(share, 1)

    def near(self, left: tuple[np.ndarray, ...], some: np.ndarray, right: tuple[np.ndarray, ...], columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which of some rows (a block at most) and columns can be alike."""
        (n, most, a, b, c, _, share), (m, limit, d, e, f, _, part_) = left, right
        for step in range(0, len(columns), COLUMNS):
            part = columns[step : step + COLUMNS]
            shape, size = (len(some), len(part)), len(some) * len(part)
            words, apart, more = self.words[:size].reshape(shape), self.bits[0, :size].reshape(shape), self.bits[1, :size].reshape(shape)
            np.bitwise_count(np.bitwise_xor(a[some, None], d[None, part], out=words), out=apart)
            one = int(share[some].max()) + int(part_[part].max()) <= ONE_WORD
            if not one:
                np.bitwise_count(np.bitwise_xor(b[some, None], e[None, part], out=words), out=more)
                np.add(apart, more, out=apart)
            # at most 128, less a share of at least 1: the difference is a signed byte
            less = np.subtract(apart.view(np.int8), part_[None, part], out=more.view(np.int8))
            kept = np.flatnonzero(less <= share[some, None])
            if len(kept):
                i, j = np.divmod(kept, len(part))
                x, y = some[i], part[j]
                total = apart.ravel()[kept].astype(np.int64) + np.bitwise_count(c[x] ^ f[y])
                if one:
                    total += np.bitwise_count(b[x] ^ e[y])
                fits = (total <= most_differences(n[x].astype(np.int64), m[y], self.permille)) | (np.maximum(n[x], m[y]) == HUGE)
                fits &= (m[y] <= most[x]) & (n[x] <= limit[y])
                if fits.any():
                    yield x[fits], y[fits]


class _across(_comparer):
    """The same for lists of two sides, the lowest bit of a key being the side: pairs (a, b) have a from side 0 and b from side 1."""

    def list_of(self, key: np.ndarray) -> np.ndarray:
        return key & ~np.uint64(1)

    def directed(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x, y

    def windows(self, place: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.flatnonzero((place >> np.uint64(16)) & np.uint64(1) == 0)
        other = (place[rows] >> np.uint64(16) | np.uint64(1)) << np.uint64(16)
        least = -(-n[rows].astype(np.int64) * self.permille // 1000)
        return rows, np.searchsorted(place, other | least.astype(np.uint64), "left"), np.searchsorted(place, other | most[rows].astype(np.uint64), "right")

    def blocks_of(self, member: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        second = (member["key"] & np.uint64(1)).astype(bool)
        if second.all() or not second.any():
            return
        left, right = self.columns_of(member[~second]), self.columns_of(member[second])
        n, most, h = left[0], left[1], left[5]
        m, limit, g = right[0], right[1], right[5]
        begin, end = np.searchsorted(m, -(-n.astype(np.int64) * self.permille // 1000), "left"), np.searchsorted(m, most, "right")
        for at in range(0, len(n), BLOCK):
            some = np.arange(at, min(at + BLOCK, len(n)))
            low, high = int(begin[some].min()), int(end[some].max())
            if low < high:
                for x, y in self.near(left, some, right, low + np.flatnonzero(limit[low:high] >= n[at])):
                    keep = h[x] != g[y]
                    if keep.any():
                        yield h[x[keep]], g[y[keep]]


def shrink(rows: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """Rows whose key may be in ``wanted`` (one bigint column): a bitmap of ``bits`` bits, whatever the
    number of keys, spares the others the shuffle of the exact join that follows."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    bitmap = (
        wanted.select(slot(F.col(wanted.columns[0])).alias("_v"))
        .groupBy(F.bitmap_bucket_number("_v").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_v")).alias("_bits"))
    )
    marked = rows.withColumn("_v", slot(F.col(key))).withColumn("_bucket", F.bitmap_bucket_number("_v")).withColumn("_at", F.bitmap_bit_position("_v"))
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int)")
    held = marked.join(F.broadcast(bitmap), "_bucket").where(F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0)
    return held.select(rows.columns)


def verify(digested: DataFrame, pairs: DataFrame, permille: int) -> DataFrame:
    """(a, b, shared, size_a, size_b): the pairs whose exact likeness is at least permille/1000."""
    return exact(with_blobs(digested, pairs), permille)


def with_blobs(digested: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, blob_a, blob_b) for pairs (a, b) of set hashes."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = shrink(digested.where(F.col("kind") == SET).select("key", "blob"), "key", wanted).dropDuplicates(["key"])
    left = sets.select(F.col("key").alias("a"), F.col("blob").alias("blob_a"))
    right = sets.select(F.col("key").alias("b"), F.col("blob").alias("blob_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "blob_a", "blob_b")


def exact(pairs: DataFrame, permille: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = ItemSets.of_blobs(batch.column(2)), ItemSets.of_blobs(batch.column(3))
            # an item of pair i shows up twice exactly if both sets of the pair hold it
            owner = np.concatenate([x.owner, y.owner])
            value = np.concatenate([x.flat, y.flat])
            order = by_owner(value, owner, batch.num_rows)
            owner, value = owner[order], value[order]
            twice = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
            shared = np.bincount(owner[1:][twice], minlength=batch.num_rows).astype(np.int64)
            keep = shared * 1000 >= permille * (x.sizes + y.sizes - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(shared[keep]), pa.array(x.sizes[keep]), pa.array(y.sizes[keep])], names=["a", "b", "shared", "size_a", "size_b"])

    return pairs.mapInArrow(run, "a bigint, b bigint, shared bigint, size_a bigint, size_b bigint")
