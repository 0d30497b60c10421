"""Problem 6: records that differ only in formatting, by dictionary-encoded columns.

Every distinct value (a source, a whole plain text, the name and the value of a named field) is
canonicalised once per task (as long as the task remembers it) to its letters and digits in lower case and gets an integer identifier.
Identifiers are hashes of the canonical value, so tasks agree on them without a shared dictionary. A
record becomes a sorted tuple of (field, value) identifiers: plain texts have one field, texts with
named fields one for each distinct pair of name and value. Records are grouped by the 128-bit digest
of source and tuple: 32 bytes a record are shuffled, whatever the length of its text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.itemsets import items
from lumenloom.operators.skew import join_skewed
from lumenloom.session import materialize

_DROPPED = re.compile(r"[\W_]+")
_PIECES = re.compile("[;|\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")
#: Canonical values that a task remembers the identifier of.
REMEMBERED = 200_000


def bare(text: str) -> str:
    return _DROPPED.sub("", text.lower())


def named_fields(text: str) -> list[tuple[str, str]] | None:
    """The (name, value) fields of a text, None if it has none.

    A text has named fields if it is a JSON object, or if cut at ``;``, ``|`` and line breaks it gives
    at least three non-blank pieces, each with exactly one colon.
    """
    start = text.lstrip()
    if start.startswith("{"):
        try:
            found = json.loads(text, object_pairs_hook=_Pairs)
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, _Pairs):
            return [(name, _plain(value)) for name, value in found]
    if text.count(":") < 3:
        return None
    pieces = [p for p in _PIECES.split(text) if p.strip()]
    if len(pieces) < 3 or any(p.count(":") != 1 for p in pieces):
        return None
    return [tuple(p.split(":")) for p in pieces]


class _Pairs(list):
    """The members of a JSON object, in order."""


def _plain(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class Dictionary(dict):
    """Value -> identifier of its canonical form (128 bits)."""

    def __missing__(self, value: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        code = self[value] = xxhash.xxh3_128_intdigest(bare(value))
        return code


class Texts:
    """Text -> the digest of its compact tuple, b"" for a text of too few items."""

    def __init__(self, least_items: int):
        self.least_items, self.values, self.known = least_items, Dictionary(), {}

    def body(self, text: str) -> bytes:
        mark = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
        body = self.known.get(mark)
        if body is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            body = self.known[mark] = self._tuple(text) if len(set(items(text))) >= self.least_items else b""
        return body

    def _tuple(self, text: str) -> bytes:
        fields, values = named_fields(text), self.values
        if fields is None:
            return b"plain" + xxhash.xxh3_128_digest(bare(text))
        pairs = sorted({(values[name], values[value]) for name, value in fields})
        return b"named" + xxhash.xxh3_128_digest(b"".join(n.to_bytes(16, "little") + v.to_bytes(16, "little") for n, v in pairs))

    def record(self, source: str, body: bytes) -> bytes:
        return xxhash.xxh3_128_digest(self.values[source].to_bytes(16, "little") + body)


def format_copies(records: DataFrame, id_col: str, text_col: str, source_col: str, least_items: int = 5) -> DataFrame:
    """``(first_id, id, copies)``: one row per record of a class of two or more, ``copies`` the class's size.

    Records are copies if their sources are bare-equal and their texts are bare-equal or made of the same
    named fields. Null ids, sources and texts, and texts of fewer than ``least_items`` distinct items, are
    in no class. Rows of the same id count once. Other columns are not read, whatever their names. An
    empty table gives no rows.
    """
    shape = "h1 bigint, h2 bigint, id bigint"
    arrow = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(least_items)
        for batch in batches:
            ids, digests = [], bytearray()
            for i, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = texts.body(text)
                if body:
                    digests += texts.record(source, body)
                    ids.append(i)
            h = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], schema=arrow)

    rows = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("id is not null and source is not null and text is not null")
    coded = rows.select("id", "source", "text").mapInArrow(run, shape)
    return classes(coded)


def classes(coded: DataFrame) -> DataFrame:
    """Rows (h1, h2, id) to (first_id, id, copies), for the digests that stand more than once.

    The counts are combined before the shuffle; the rows of a very large class learn it where they lie.
    """
    coded = materialize(coded.distinct(), "coded")
    sizes = coded.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return join_skewed(coded, materialize(sizes, "classes"), ["h1", "h2"]).select("first_id", "id", "copies")
