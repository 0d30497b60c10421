"""Exact, near and semantic deduplication with deterministic survivors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import text as T
from lumenloom.functions.itemsets import ItemSets, scramble
from lumenloom.operators.components import connected_components
from lumenloom.operators.simjoin import COPY, SET, Emitter, Entries, PrefixLists, digest, frequent_items, linked
from lumenloom.session import materialize


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; null keys are one key.

    ``min_by`` combines before the shuffle, so a key that half of the rows share costs one row a task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = df.select(key.alias("_key"), F.struct(*order).alias("_order"), row.alias("_row")).groupBy("_key").agg(F.min_by("_row", "_order").alias("_row"))
    return first.select("_row.*")


def exact_key(text: Column) -> Column:
    return F.lower(T.strip(text))


def exact_dedup(df: DataFrame, text: str = "text", order: str = "row_id") -> DataFrame:
    """Rows whose trimmed, lower-cased text hasn't stood before; null texts are one text. The key travels as
    a 128-bit digest, so the text itself is shuffled once, within its row."""
    return keep_first(df, F.md5(exact_key(F.col(text))), [F.col(order)])


def word_pairs(df: DataFrame, id_col: str, text_col: str, permille: int = 700) -> DataFrame:
    """``(id_a, id_b, jaccard)``: pairs with token-set similarity >= permille/1000, lossless.

    Tokens of a row are ordered from the rarest to the commonest; two similar rows share one of the first
    s - ceil(t s) + 1. Only those are joined on, then sizes and exact overlap decide. Null texts and texts
    without a word have no pair.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.array_distinct(T.words(F.lower(F.col(text_col)))).alias("words")).where(F.size("words") > 0)
    counts = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.select("id", F.explode("words").alias("word")).join(counts, "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w"))
    sets = materialize(ranked.select("id", F.col("w.word").alias("words")), "word-sets")
    size = F.size("words")
    prefix = F.slice("words", F.lit(1), size - F.ceil(size * permille / 1000).cast("int") + 1)
    keys = sets.select("id", size.alias("s"), F.explode(prefix).alias("word"))
    a, b = keys.alias("a"), keys.alias("b")
    fits = (F.col("a.s") * 1000 >= F.col("b.s") * permille) & (F.col("b.s") * 1000 >= F.col("a.s") * permille)
    pairs = a.join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.id") < F.col("b.id")) & fits).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
    left, right = sets.toDF("id_a", "wa"), sets.toDF("id_b", "wb")
    shared = F.size(F.array_intersect("wa", "wb"))
    full = pairs.join(left, "id_a").join(right, "id_b").withColumn("o", shared).withColumn("u", F.size("wa") + F.size("wb") - F.col("o"))
    return full.where(F.col("o") * 1000 >= F.col("u") * permille).select("id_a", "id_b", (F.col("o") / F.col("u")).alias("jaccard"))


class Bands:
    """Min-hash bands of token sets as list keys."""

    def __init__(self, bands: int, rows: int, permille: int):
        self.bands, self.rows, self.permille = bands, rows, permille

    def __call__(self, sets: ItemSets, wave: int = 0, waves: int = 1) -> Entries:
        keys = []
        for band in range(self.bands):
            key = np.full(len(sets.sizes), band, np.uint64)
            for row in range(self.rows):
                key = scramble(key ^ np.minimum.reduceat(scramble(sets.flat, 1000 + band * self.rows + row), sets.starts), 5)
            keys.append(key)
        owner = np.tile(np.arange(len(sets.sizes)), self.bands)
        return Entries(np.concatenate(keys), owner, sets.sizes[owner] * 1000 // self.permille).of_wave(wave, waves)


def banded_groups(df: DataFrame, id_col: str, text_col: str, permille: int = 700, bands: int = 14, rows: int = 9) -> DataFrame:
    """``(component, id)`` by min-hash banding of item sets (``functions.itemsets``) with exact verification:
    the fast, lossy form (a pair with similarity j is found with probability 1 - (1 - j^rows)^bands). Rows
    without id or text, or without an item, are left out; a row in no pair is a component of its own."""
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.lit(0).alias("tag")).where("id is not null and text is not null")
    digested = digest(source, 1)
    return _grouped(digested, Bands(bands, rows, permille), permille)


def alike_groups(df: DataFrame, id_col: str, text_col: str, permille: int = 700) -> DataFrame:
    """``(component, id)`` like ``banded_groups``, but lossless: every pair with similarity >= permille/1000
    meets in a list of ``PrefixLists``."""
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.lit(0).alias("tag")).where("id is not null and text is not null")
    digested = digest(source, 1)
    return _grouped(digested, PrefixLists(*frequent_items(digested), permille), permille)


def _grouped(digested: DataFrame, emit: Emitter, permille: int) -> DataFrame:
    links = linked(digested, emit, permille)
    found = connected_components(links, "a", "b")
    members = digested.where(F.col("kind").isin(SET, COPY)).select(F.col("key").alias("vertex"), "id").distinct()
    return members.join(found, "vertex", "left").select(F.coalesce("component", "vertex").alias("component"), "id")


def survivors(df: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The longest row of each group, the smallest id among equals; rows in no group survive."""
    placed = df.join(groups.select(F.col("id").alias(id_col), "component"), id_col, "left")
    alone = placed.where("component is null").select(df.columns)
    ranked = keep_first(placed.where("component is not null"), F.col("component"), [-F.coalesce(F.length(text_col), F.lit(-1)), F.col(id_col)])
    return alone.unionByName(ranked.select(df.columns))


_CLUSTER = "id bigint"


def greedy_within(clusters: DataFrame, threshold: float) -> DataFrame:
    """Survivors (id) of order-dependent elimination inside each cluster, rows in id order: of two rows more
    similar than the threshold the lower score goes, the later one of equals; a row that has gone is passed
    over, but one that goes while it is being compared finishes its round.

    ``clusters``: (cluster, id, score, vector). A cluster is a task's work, as its rule is sequential: keep
    clusters bounded (k-means cells), or use ``survivors`` on components, which has no such bound.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        vectors, scores = np.stack(part["vector"].to_numpy()).astype(float), part["score"].to_numpy(float)
        gone = np.zeros(len(part), bool)
        for i in range(len(part)):
            if gone[i]:
                continue
            near = np.flatnonzero(vectors[i + 1 :] @ vectors[i] > threshold) + i + 1
            for j in near:
                if not gone[j]:
                    gone[j if scores[i] >= scores[j] else i] = True
        return part.loc[~gone, ["id"]]

    return clusters.groupBy("cluster").applyInPandas(run, _CLUSTER)

