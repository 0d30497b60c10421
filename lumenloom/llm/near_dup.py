"""Problem 1: groups of near-duplicate records, by a size-aware heavy-light set join.

Sets (the distinct items of a text) are joined on likeness >= t. Two sets of a and b items are alike
exactly if they share at least c(a, b) items.

* Light sets enumerate fixed-size subsets: for every overlap c that a partner's size can ask for, all
  subsets of c items. Two light sets that share c items have such a subset in common. Exact.
* Heavy sets scan inverted lists. In the order "rarest items first", the first shared item of two alike
  sets lies within the first s - ceil(t s) + 1 items of either, so they meet in that item's list. Exact.
* The list of a common item would hold a fixed share of all rows. Where the counts make a list longer
  than a task compares, it is split by the items that may be shared next (``PrefixLists``). Exact, too.
* The light-heavy boundary is chosen by cost: the largest size whose subsets cost less than its lists.

Every candidate is verified exactly on the item sets. Components of the links give the groups.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.itemsets import ItemSets, required_overlap, scramble
from lumenloom.operators.components import connected_components
from lumenloom.operators.simjoin import COPY, SET, Entries, PrefixLists, digest, frequent_items, linked
from lumenloom.operators.skew import join_skewed
from lumenloom.session import materialize

#: Lists of a small heavy set and their members, as the boundary reckons them.
LISTS, LIST_GOAL = 4, 400
#: Cost of a list entry (shuffled, sorted) in comparisons of two members.
ENTRY_COST = 150


def partner_overlaps(size: int, permille: int) -> list[int]:
    """The overlaps c(size, s) over all partner sizes s that can be alike."""
    least, most = -(-size * permille // 1000), size * 1000 // permille
    return sorted({required_overlap(size, s, permille) for s in range(least, most + 1)} - set(range(size + 1, most + 2)))


def light_boundary(permille: int, list_length: float, bands: int) -> int:
    """The largest size up to which enumerating subsets costs less than entering and scanning lists."""
    heavy = bands * (ENTRY_COST + list_length / 2)
    size = 0
    while sum(comb(size + 1, c) for c in partner_overlaps(size + 1, permille)) * ENTRY_COST <= heavy:
        size += 1
    return size


class HeavyLight:
    """The list keys of a batch of sets; frozen statistics, so all tasks agree."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, rows: int, permille: int, limit: int | None = None):
        self.permille, self.lists = permille, PrefixLists(frequent, counts, rows, permille, limit)
        self.light = light_boundary(permille, min(rows, LIST_GOAL), LISTS)

    def __call__(self, sets: ItemSets, wave: int = 0, waves: int = 1) -> Entries:
        sizes, parts = sets.sizes, []
        for size in np.unique(sizes[sizes <= self.light]).tolist():
            which = np.flatnonzero(sizes == size)
            item = scramble(sets.flat[sets.starts[which][:, None] + np.arange(size)], 77)
            for c in partner_overlaps(size, self.permille):
                subsets = np.array(list(combinations(range(size), c)))
                key = scramble(np.bitwise_xor.reduce(item[:, subsets], 2), 1000 + c).ravel()
                owner = np.repeat(which, len(subsets))
                parts.append(Entries(key, owner, np.full(len(key), size * 1000 // self.permille)).of_wave(wave, waves))
        # a light set whose partners are all light needs no lists
        heavy = sizes * 1000 >= self.permille * (self.light + 1)
        if heavy.any():
            entries = self.lists(sets.take(heavy), wave, waves)
            parts.append(entries._replace(owner=np.flatnonzero(heavy)[entries.owner]))
        return Entries.together(parts)


def near_duplicate_groups(records: DataFrame, id_col: str, text_col: str, permille: int = 700, least_items: int = 5) -> DataFrame:
    """``(group_id, member_id, links)``: one row for each record of a group of two or more, itself included.

    Groups are the connected components of likeness >= permille/1000; group_id is the smallest id in
    the group; ``links`` counts the distinct other texts that a record's text is directly linked to.
    Null texts and texts of fewer than ``least_items`` distinct items are in no group; rows with the
    same items (exact copies, repeated rows) are in one group with links counted once; rows without id
    are left out. Very long texts are taken whole. An empty table gives no rows. Other columns of
    ``records`` are not read, whatever their names.
    """
    source = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.lit(0).alias("tag")).where("id is not null and text is not null")
    digested = digest(source, least_items)
    links = alike_sets(digested, permille)
    found = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("vertex")).groupBy("vertex").agg(F.count(F.lit(1)).alias("links"))
    members = digested.where(F.col("kind").isin(SET, COPY)).select(F.col("key").alias("vertex"), "id").distinct()
    known = materialize(found.join(degree, "vertex"), "components")
    placed = join_skewed(members, known, ["vertex"], "left").select(
        F.coalesce("component", "vertex").alias("component"), "id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links")
    )
    placed = materialize(placed, "placed")
    groups = materialize(placed.groupBy("component").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "groups")
    return join_skewed(placed, groups, ["component"]).select("group_id", F.col("id").alias("member_id"), "links")


def alike_sets(digested: DataFrame, permille: int) -> DataFrame:
    """(a, b, shared, size_a, size_b): the distinct item sets that are alike, as hashes, written once."""
    frequent, counts, rows = frequent_items(digested)
    return linked(digested, HeavyLight(frequent, counts, rows, permille), permille)
