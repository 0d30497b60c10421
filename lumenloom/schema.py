"""Fixed schemas of the corpus; readers never infer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW = _strings("text", "source", "lang")
BENCHMARK = _strings("text", "original_category", "source", "language")
CURATED = _strings("text", "subject", "style", "camera", "source", "lang")
TURN = _strings("from", "role", "value", "content")
CONVERSATION = T.StructType([T.StructField("conversations", T.ArrayType(TURN)), T.StructField("caption", T.StringType()), T.StructField("text", T.StringType())])
LEDGER = T.StructType(
    [
        T.StructField("commit", T.StringType()),
        T.StructField("kid_mean", T.DoubleType()),
        T.StructField("peak_vram_gb", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)
MANIFEST = _strings("path", "md5")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor the empty string, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def normalise(df: DataFrame) -> DataFrame:
    """One name for the language (``lang``, else ``language``, else en), missing columns as nulls."""
    have = [F.col(c) for c in ("lang", "language") if c in df.columns]
    out = df.withColumn("lang", F.coalesce(*have, F.lit("en")))
    for name in CURATED.names:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out.drop("language")
