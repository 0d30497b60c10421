"""Coverage, gaps and validation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import text as T


def frequency(df: DataFrame, by: str, order: str) -> DataFrame:
    """``value, n, first_seen``: a frequency table; sort by n descending, then first_seen."""
    return df.groupBy(F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """``value, n, percent``."""
    counts = df.groupBy(F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def axis(taxonomy: DataFrame, name: str, column: str) -> DataFrame:
    return taxonomy.where(F.col("axis") == name).select(F.col("code").alias(column), F.col("ord").alias(f"{column}_ord"))


def coverage_grid(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``subject, style, n`` for every cell of the two axes, zero where there is no row."""
    counts = df.groupBy("subject", "style").agg(F.count(F.lit(1)).alias("n"))
    grid = axis(taxonomy, "subject", "subject").crossJoin(axis(taxonomy, "style", "style"))  # a fixed grid of codes
    return grid.join(counts, ["subject", "style"], "left").select("subject", "subject_ord", "style", "style_ord", F.coalesce("n", F.lit(0)).alias("n"))


def gaps(grid: DataFrame, target: int, most: int = 20) -> DataFrame:
    """The cells farthest below the target, in grid order among equals."""
    need = grid.withColumn("need", F.lit(target) - F.col("n")).where("need > 0")
    return need.orderBy(F.desc("need"), "subject_ord", "style_ord").limit(most).select("subject", "style", "need")


def margins(df: DataFrame) -> DataFrame:
    """``subject, style, n`` with totals: 'ALL' stands for a whole row, column or the table."""
    cube = df.cube("subject", "style").agg(F.count(F.lit(1)).alias("n"), F.grouping("subject").alias("gs"), F.grouping("style").alias("gt"))
    named = lambda c, g: F.when(F.col(g) == 1, F.lit("ALL")).otherwise(F.col(c)).alias(c)
    return cube.select(named("subject", "gs"), named("style", "gt"), "n")


def pivoted(df: DataFrame, styles: list[str]) -> DataFrame:
    """One row per subject, one column per style, zeros filled, with the row's total."""
    wide = df.groupBy("subject").pivot("style", styles).agg(F.count(F.lit(1)))
    filled = [F.coalesce(F.col(s), F.lit(0)).alias(s) for s in styles]
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in styles), F.lit(0))
    return wide.select("subject", *filled, total.alias("total"))


def validation(df: DataFrame, low: int, high: int, cells: int, floor: int) -> DataFrame:
    """``check, value, status``: rows, populated cells, smallest cell, cells below the floor, language
    shares, mean words of en, exact duplicates, largest source's share. One scan, its rows grouped four ways at once."""
    en = F.coalesce(F.col("lang"), F.lit("en")) == "en"
    rows = df.select(
        "subject", "style", "source", F.md5(F.lower(T.strip(F.col("text")))).alias("_key"),
        F.when(en, 1.0).otherwise(0.0).alias("_en"), F.when(F.col("lang") == "zh", 1.0).otherwise(0.0).alias("_zh"), F.when(en, T.word_count(F.col("text"))).alias("_words"),
    )
    by = ["subject", "style", "source", "_key"]
    sets = rows.groupingSets([[], ["subject", "style"], ["source"], ["_key"]], *by).agg(
        F.grouping_id(*by).alias("_set"), F.count(F.lit(1)).alias("c"), F.avg("_en").alias("e"), F.avg("_zh").alias("z"), F.avg("_words").alias("w")
    )
    # the set's bits: 15 none, 3 subject and style, 13 source, 14 text
    of = lambda number, column: F.when(F.col("_set") == number, column)
    row = sets.agg(
        F.coalesce(F.max(of(15, F.col("c"))), F.lit(0)).alias("rows"), F.max(of(15, F.col("e"))).alias("en"), F.max(of(15, F.col("z"))).alias("zh"), F.max(of(15, F.col("w"))).alias("words"),
        F.count(of(3, F.lit(1))).alias("populated"), F.min(of(3, F.col("c"))).alias("least"), F.sum(of(3, F.when(F.col("c") < floor, 1).otherwise(0))).alias("below"),
        F.max(of(13, F.col("c"))).alias("top"), F.sum(of(14, F.col("c") - 1)).alias("dups"),
    )

    def line(name: str, value: Column, status: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), status.alias("status"))

    def passes(ok: Column, other: str = "WARN") -> Column:
        return F.when(ok, "PASS").otherwise(other)

    share = F.col("top") * 100.0 / F.greatest(F.col("rows"), F.lit(1))
    lines = F.array(
        line("rows", F.col("rows"), passes(F.col("rows").between(low, high))),
        line("populated_cells", F.col("populated"), passes(F.col("populated") == cells)),
        line("min_cell", F.col("least"), F.lit("INFO")),
        line("cells_below_floor", F.col("below"), F.lit("INFO")),
        line("en_percent", F.col("en") * 100, F.lit("INFO")),
        line("zh_percent", F.col("zh") * 100, F.lit("INFO")),
        line("mean_en_words", F.col("words"), passes(F.col("words").between(30, 45), "INFO")),
        line("duplicates", F.coalesce("dups", F.lit(0)), passes(F.coalesce("dups", F.lit(0)) == 0)),
        line("max_source_percent", share, passes(share <= 35)),
    )
    return row.select(F.explode(lines).alias("l")).select("l.*")


def histogram(df: DataFrame, value: Column, width: int) -> DataFrame:
    return df.groupBy((F.floor(value / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def top_words(df: DataFrame, text: str, most: int) -> DataFrame:
    counts = df.select(F.explode(T.words(F.lower(F.col(text)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(most)


def dedup_accounting(df: DataFrame, key: Column, order: str, good: Column) -> DataFrame:
    """``stage, kept``: the rows that came in, those first in the order with their key, and those of them
    that are good. One aggregation of numbers by key; ``order`` is a whole number without nulls."""
    verdict = F.col(order).cast("bigint") * 2 + F.when(good, 0).otherwise(1)
    keys = df.select(key.alias("_key"), verdict.alias("_v")).groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("first"))
    row = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input"), F.count(F.lit(1)).alias("deduplicated"), F.coalesce(F.sum(1 - F.pmod("first", F.lit(2))), F.lit(0)).alias("filtered"))
    stages = ("input", "deduplicated", "filtered")
    return row.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("bigint").alias("kept")) for s in stages])).alias("s")).select("s.*")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """``stage, kept``: the rows after each named stage, in one job."""
    parts = [df.select(F.lit(name).alias("stage")) for name, df in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("stage").agg(F.count(F.lit(1)).alias("kept"))
