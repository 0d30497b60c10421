"""Problems 7 and 8: encoding with a public tokenizer, and token counts kept up to date by signed deltas.

Encoding is done in overlapping chunks. A long text is cut at nominal places; every chunk carries some
text before and after its own. Around each nominal cut the pre-tokeniser starts afresh a little before
it; the first pre-token boundary after the cut is the proposed real cut, and both neighbours compute
the same one. The chunk on the left, which pre-tokenises from its own real cut, must come through that
place too: then both sequences of boundaries have resynchronised, and the pieces' ids put together are
those of the whole text. If they don't meet, the text is encoded whole. Chunks of one text are encoded
in different tasks; texts of one chunk never leave the task that reads them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.session import discard, materialize, working_dir, write_table

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points of a chunk, and of the text it carries on either side.
CHUNK = 32_768
OVERLAP = 1_024
#: Texts encoded before their ids are packed.
STEP = 256


@lru_cache(maxsize=4)
def tokenizer(name: str, folder: str = TOKENIZERS):
    """A tiktoken encoding of one of the rank files, without special tokens."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(text: str, start: int = 0) -> list[int]:
    """Where the pre-tokens of text[start:] end."""
    return [m.end() for m in _pattern().finditer(text, start)]


def cut_after(text: str, at: int, room: int = OVERLAP) -> int | None:
    """The real cut for a nominal cut ``at`` of ``text``: the first pre-token boundary from ``at`` on, in a
    pre-tokenisation begun ``room`` before, that follows a character other than white space (there the
    pre-tokens on its left don't depend on what comes after)."""
    window = text[max(0, at - room) : at + room]
    offset = max(0, at - room)
    for end in boundaries(window)[:-1]:
        if offset + end >= at and not text[offset + end - 1].isspace():
            return offset + end
    return None


def encode_chunk(piece: str, lead: int, own: int, last: bool, encoding) -> list[int] | None:
    """Ids of a chunk: ``piece`` has ``lead`` code points before the chunk's nominal start, ``own`` of its own,
    then what follows. None if the boundaries don't resynchronise at its end."""
    start = cut_after(piece, lead) if lead else 0
    if start is None:
        return None
    if last:
        return encoding.encode_ordinary(piece[start:])
    end = cut_after(piece, lead + own)
    if end is None or end < start:
        return None
    # the chunk's own pre-tokens must come through the cut; those near the piece's end don't matter
    if end not in boundaries(piece[: end + OVERLAP], start):
        return None
    return encoding.encode_ordinary(piece[start:end])


def _id_lists(lists: list[list[int]]) -> pa.ListArray:
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate([np.array(x, np.int32) for x in lists]) if lists else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat, pa.int32()))


def _texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, STEP):
        yield batch.slice(at, STEP)


def encode(documents: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, counts_only: bool = False) -> DataFrame:
    """``(id, ids array<int>)`` of each row, or ``(id, tokens bigint)`` with ``counts_only``.

    Empty and null texts give an empty list (no tokens). Strings of special tokens are ordinary text.
    Every row gives one row, repeated ids too; a null id stays null. Texts are encoded whole whatever
    their length. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    shape = f"id {id_type}, tokens bigint" if counts_only else f"id {id_type}, ids array<int>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(name, folder)
        for batch in batches:
            for part in _texts(batch):
                ids = [encoding.encode_ordinary(t) if t else [] for t in part.column(1).to_pylist()]
                out = pa.array([len(x) for x in ids], pa.int64()) if counts_only else _id_lists(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=["id", "tokens" if counts_only else "ids"])

    short = texts.where(F.char_length("text") <= CHUNK + OVERLAP).mapInArrow(whole, shape)
    long = texts.where(F.char_length("text") > CHUNK + OVERLAP)
    stitched = materialize(_encode_long(long, id_type, name, folder), "encoded")
    tokens = F.size("ids").cast("bigint").alias("tokens") if counts_only else F.col("ids")
    found = short.unionByName(stitched.where("ids is not null").select("id", tokens))
    apart = stitched.where("ids is null").select("id", "text_id")
    if not apart.isEmpty():
        again = _numbered(long).join(apart.select("text_id").distinct(), "text_id").select("id", "text")
        found = found.unionByName(again.mapInArrow(whole, shape))
    return found


def _numbered(long: DataFrame) -> DataFrame:
    """Repeated ids and repeated texts stay apart by id and content together."""
    return long.withColumn("text_id", F.xxhash64("id", "text"))


def _encode_long(long: DataFrame, id_type: str, name: str, folder: str) -> DataFrame:
    """(id, text_id, ids): ids null where the chunks of a text don't meet."""
    numbered = _numbered(long).groupBy("text_id", "id").agg(F.count(F.lit(1)).alias("times"), F.any_value("text").alias("text"))
    chunks = F.ceil(F.char_length("text") / CHUNK).cast("int")
    lead = F.when(F.col("chunk") > 0, F.lit(OVERLAP)).otherwise(0)
    pieces = (
        numbered.select("id", "text_id", "times", "text", chunks.alias("chunks"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        .withColumn("lead", lead)
        .select("id", "text_id", "times", "chunks", "chunk", "lead", F.substring(F.col("text"), F.col("chunk") * CHUNK - F.col("lead") + 1, F.col("lead") + CHUNK + 2 * OVERLAP).alias("piece"))
        .repartition("text_id", "chunk")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(name, folder)
        for batch in batches:
            for part in _texts(batch):
                _, _, _, chunks, chunk, lead, piece = (c.to_pylist() for c in part.columns)
                ids = [encode_chunk(p, a, CHUNK, k == n - 1, encoding) for n, k, a, p in zip(chunks, chunk, lead, piece, strict=True)]
                good = pa.array([x is not None for x in ids])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), part.column(4), good, _id_lists([x or [] for x in ids])], names=["id", "text_id", "times", "chunk", "good", "ids"])

    done = pieces.mapInArrow(run, f"id {id_type}, text_id bigint, times bigint, chunk int, good boolean, ids array<int>")
    # the chunks of one text: no more than the row that the result must hold anyway
    parts = done.groupBy("text_id", "id", "times").agg(F.min("good").alias("good"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    ids = F.when(F.col("good"), F.flatten(F.col("parts.ids")))
    return parts.select("id", "text_id", ids.alias("ids"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_n")).drop("_n")


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """The text of ids: their raw bytes put together."""
    return tokenizer(name, folder).decode_bytes(ids).decode("utf-8", "replace")


def decode_rows(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id, text)`` of each row of ``encoded``: the inverse of ``encode``. Null and empty lists give an empty text."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _texts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([decode(x, name, folder) if x else "" for x in part.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")


# --- problem 7 ---

SLICE = ["source", "lang", "subject"]
_COUNTS = "content binary, tokenizer string, tokens bigint"
_SEEN = "content binary, source string, lang string, subject string, n bigint"
_CUBE = "source string, lang string, subject string, documents bigint, tokens bigint"
#: Contents that a task remembers to have met.
REMEMBERED_CONTENTS = 1_000_000


def contents(records: DataFrame, text_col: str, slices: dict[str, Column]) -> DataFrame:
    """(content, source, lang, subject, text): each record's 128-bit hash of its text, and its slice."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return records.select(F.unhex(F.md5(text)).alias("content"), *[slices[s].alias(s) for s in SLICE], text.alias("text"))


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (content, text) whose content the task doesn't remember: a hot text leaves each task once."""
    met: set[bytes] = set()
    for batch in batches:
        keep = []
        for content in batch.column(0).to_pylist():
            keep.append(content not in met)
            met.add(content)
        if len(met) > REMEMBERED_CONTENTS:
            met.clear()
        yield batch.filter(pa.array(keep, pa.bool_()))


class TokenLedger:
    """Token counts of a changing collection, kept in a folder.

    The folder holds a table of counts by content and tokenizer hash (each run adds the contents that were
    new to it), the contents and slices of the collection as counted last, and the cube of each run.
    ``update`` encodes only contents without a count, each of them once, and changes the cube by signed
    deltas: the rows of every slice and content that went, negative, and those that came, positive. A
    changed document is one that went and one that came. A run counts once its cube is written; what a
    broken one left is overwritten. A ledger opened on the same folder later goes on from there.
    """

    def __init__(self, spark: SparkSession, home: str | None = None, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
        self.spark, self.name, self.folder = spark, name, folder
        self.home = home or f"{working_dir(spark)}/ledger-{uuid.uuid4().hex}"
        with open(f"{folder}/{name}.tiktoken", "rb") as file:
            self.mark = f"{name}:{hashlib.md5(file.read()).hexdigest()}"  # another vocabulary counts anew
        self.run = self._last_run()
        self.encoded = 0

    def _path(self, table: str, run: int) -> str:
        return f"{self.home}/{table}/run={run}"

    def _last_run(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.home).getFileSystem(self.spark._jsc.hadoopConfiguration())
        run = 0
        while files.exists(path(f"{self._path('cube', run + 1)}/_SUCCESS")):
            run += 1
        return run

    def _read(self, table: str, shape: str, runs: range) -> DataFrame:
        return self.spark.read.schema(shape).parquet(*[self._path(table, run) for run in runs]) if len(runs) else self.spark.createDataFrame([], shape)

    def counts(self) -> DataFrame:
        """(content, tokens) under this tokenizer."""
        return self._read("counts", _COUNTS, range(1, self.run + 1)).where(F.col("tokenizer") == self.mark).select("content", "tokens")

    def cube(self) -> DataFrame:
        """``(source, lang, subject, documents, tokens)`` as of the last run."""
        return self._read("cube", _CUBE, range(self.run, self.run + 1) if self.run else range(0))

    def update(self, records: DataFrame, text_col: str, slices: dict[str, Column]) -> DataFrame:
        """The cube after the collection became ``records``: ``(source, lang, subject, documents, tokens)``.

        Null and empty texts count as documents of no tokens; null slices are slices of their own; repeated
        rows count as often as they stand; texts are encoded whole; an empty table gives no rows.
        """
        run = self.run + 1
        now = contents(records, text_col, slices)
        # combined before the shuffle, so a text that half of the rows share is a row per slice
        write_table(now.groupBy("content", *SLICE).agg(F.count(F.lit(1)).alias("n")), self._path("seen", run))
        seen = self._read("seen", _SEEN, range(run, run + 1))
        fresh = now.select("content", "text")
        if self.run:
            wanted = materialize(seen.select("content").distinct().join(self.counts(), "content", "left_anti"), "wanted")
            fresh = fresh.join(wanted, "content", "left_semi")
        once = fresh.mapInArrow(_first_of_task, "content binary, text string").repartition("content").sortWithinPartitions("content")
        write_table(once.mapInArrow(_token_counter(self.name, self.folder, self.mark), _COUNTS), self._path("counts", run))
        before = self.run
        self.run, self.encoded = run, self._read("counts", _COUNTS, range(run, run + 1)).count()
        if before:
            discard(wanted)
            old = self._read("seen", _SEEN, range(before, before + 1)).withColumn("n", -F.col("n"))
            # what stands on both sides cancels
            deltas = old.unionByName(seen).groupBy("content", *SLICE).agg(F.sum("n").alias("n")).where("n <> 0")
        else:
            deltas = seen
        change = deltas.join(self.counts(), "content").groupBy(*SLICE).agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("tokens")).alias("tokens"))
        if before:
            last = self._read("cube", _CUBE, range(before, before + 1))
            change = last.unionByName(change).groupBy(*SLICE).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        write_table(change.where("documents <> 0"), self._path("cube", run))
        return self.cube()


def _token_counter(name: str, folder: str, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, last = tokenizer(name, folder), None
        for batch in batches:
            for part in _texts(batch):
                found, counts = [], []
                for content, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if content != last:  # the rows are in the order of their contents
                        found.append(content)
                        counts.append(len(encoding.encode_ordinary(text)))
                    last = content
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([mark] * len(found), pa.string()), pa.array(counts, pa.int64())], names=["content", "tokenizer", "tokens"])

    return run
