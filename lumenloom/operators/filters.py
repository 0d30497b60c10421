"""Record filters as predicates: composed of built-in functions, so Catalyst can push and fuse them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions import text as T


def quality(text: Column, lang: Column) -> Column:
    """Not blank; zh at least 15 characters, else 8 to 200 words; at most one URL; no boilerplate phrase;
    at least seven tenths letters and white space. A null text fails; a null language isn't zh."""
    short = F.when(lang == "zh", F.length(T.strip(text)) >= 15).otherwise(T.word_count(text).between(8, 200))
    ok = (T.strip(text) != "") & short & (T.url_count(text) < 2) & ~T.any_of(text, T.BOILERPLATE) & (T.letter_share(T.strip(text)) >= 0.7)
    return F.coalesce(ok, F.lit(False))


def safe(score: Column, limit: float = 0.5) -> Column:
    """Null, NaN-free scores up to the limit pass; so do null and NaN, which say nothing."""
    return F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)) <= limit


def relaxed_han(text: Column) -> Column:
    return F.coalesce((F.length(T.strip(text)) >= 10) & (T.url_count(text) < 2), F.lit(False))


def long_enough(text: Column, lang: Column, words: int = 5, han: int = 4) -> Column:
    return F.coalesce(F.when(lang == "zh", F.length(T.strip(text)) >= han).otherwise(T.word_count(text) >= words), F.lit(False))


def final_length(text: Column, lang: Column, least: int = 8, most: int = 150, han: int = 20) -> Column:
    return F.coalesce(F.when(lang == "zh", F.length(T.strip(text)) >= han).otherwise(T.word_count(text).between(least, most)), F.lit(False))


def failing(real: Column, fake: Column, gap: Column) -> Column:
    """A discriminator that is sure of everything, blind, or whose logit gap has run away or collapsed; nulls count as usual values."""
    real, fake, gap = F.coalesce(real, F.lit(0.5)), F.coalesce(fake, F.lit(0.5)), F.coalesce(gap, F.lit(1.0))
    return ((real > 0.95) & (fake > 0.95)) | ((real < 0.55) & (fake < 0.55)) | (gap > 15) | (gap < 0.1)


def finite(values: Column) -> Column:
    """Every element is a number; a null array isn't finite."""
    return F.coalesce(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
