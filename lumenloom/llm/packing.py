"""Problem 9: filling containers of fixed capacity, by vector best-fit.

A container has three capacities: tokens, documents, and attention cost (the sum of squared lengths).
Documents are taken from the longest to the shortest; among the open containers that can take one under
every constraint, the one with the smallest weighted norm of what would be left is chosen. A document
is split only if it alone exceeds the token capacity: into full pieces, and a rest that is packed.

The table is packed in blocks of bounded size, drawn by a hash of the row; blocks are independent tasks.
Each leaves at most a few containers partly filled, a share of 1 / (containers of a block). Rows that
agree in id and size are counted and numbered first, so that the result depends on the rows alone, not
on how they are partitioned, and the rows of one repeated id still spread over the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.tokens import TOKENIZERS, encode
from lumenloom.session import materialize

#: Documents packed together.
BLOCK_DOCUMENTS = 16_384
#: Documents of a container.
MOST_DOCUMENTS = 512
#: Attention cost of a container in permille of the square of its capacity, unless its spec has another. Less
#: than 1000 binds: what stands beside a long document must then be short ones.
ATTENTION_PERMILLE = 900
#: Weights of the leftover tokens, documents and attention cost in the norm.
WEIGHTS = (1.0, 0.01, 0.05)


def best_fit(sizes: np.ndarray, capacity: int, most: int = MOST_DOCUMENTS, attention: float | None = None, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The container of each item (sizes <= capacity), numbered from 0 in the order of opening.

    ``attention`` is the capacity for the sum of squared sizes, capacity**2 if None; an item whose own
    cost exceeds it gets a container to itself. Equal norms go to the container opened first.
    """
    limit = float(capacity) ** 2 if attention is None else float(attention)
    out = np.empty(len(sizes), np.int64)
    left = np.empty((3, max(len(sizes), 1)))  # residual tokens, documents, cost of each open container
    place = np.empty(max(len(sizes), 1), np.int64)  # its number
    open_, opened = 0, 0
    a, b, c = weights[0] / capacity**2, weights[1] / most**2, weights[2] / max(limit, 1.0) ** 2
    for i in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        n = float(sizes[i])
        tokens, documents, cost = left[0, :open_] - n, left[1, :open_] - 1, left[2, :open_] - n * n
        fits = (tokens >= 0) & (documents >= 0) & (cost >= 0)
        if fits.any():
            norm = a * tokens * tokens + b * documents * documents + c * cost * cost
            k = int(np.where(fits, norm, np.inf).argmin())
            left[0, k], left[1, k], left[2, k] = tokens[k], documents[k], cost[k]
        else:
            k = open_
            left[:, k] = capacity - n, (most - 1 if n * n <= limit else 0), limit - n * n
            place[k] = opened
            open_, opened = open_ + 1, opened + 1
        out[i] = place[k]
        if left[1, k] <= 0 or left[0, k] <= 0 and n > 0:  # full: closed, the last one takes its slot
            open_ -= 1
            left[:, k] = left[:, open_]
            place[k] = place[open_]
    return out


def pack_block(ids: np.ndarray, sizes: np.ndarray, capacity: int, most: int, attention: float | None) -> tuple[np.ndarray, ...]:
    """(container, id, piece, pieces, tokens) of one block."""
    full = np.maximum(sizes - 1, 0) // capacity  # full pieces besides the rest
    pieces = full + 1
    owner = np.repeat(np.arange(len(ids)), pieces)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    tokens = np.where(piece < full[owner], capacity, sizes[owner] - full[owner] * capacity)
    return best_fit(tokens, capacity, most, attention), ids[owner], piece, pieces[owner], tokens


def pack(sizes: DataFrame, capacity: int, most_documents: int = MOST_DOCUMENTS, attention: float | None = None) -> DataFrame:
    """``sizes`` (id bigint, tokens bigint) to ``(container bigint, id, piece, pieces, tokens)``.

    Documents without tokens take a place like any other; null sizes count as 0. Repeated ids are packed
    as often as they stand. An empty table gives no rows. A capacity below 1 is an error.
    """
    if capacity < 1:
        raise ValueError("a container holds at least one token")
    blocks = max(1, -(-sizes.count() // BLOCK_DOCUMENTS))
    counted = sizes.select(F.col("id").cast("bigint"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")).groupBy("id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select("id", "tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    placed = rows.select("id", "tokens", F.pmod(F.xxhash64("id", "tokens", "copy"), F.lit(blocks)).cast("int").alias("block"))
    shape = "container bigint, id bigint, piece int, pieces int, tokens bigint"

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.lexsort((ids, -table.column("tokens").to_numpy()))
        container, owner, piece, pieces, tokens = pack_block(ids[order], table.column("tokens").to_numpy()[order], capacity, most_documents, attention)
        number = int(table.column("block")[0].as_py()) << 32
        return pa.table({"container": container + number, "id": owner, "piece": piece.astype(np.int32), "pieces": pieces.astype(np.int32), "tokens": tokens})

    return placed.groupBy("block").applyInArrow(run, shape)


def pack_documents(documents: DataFrame, id_col: str, text_col: str, specs: DataFrame, folder: str = TOKENIZERS, only: str | None = None) -> DataFrame:
    """``(pack_id, container, id, piece, pieces, tokens)`` for each row of ``specs``: pack_id, tokenizer and
    capacity, and if it has them most_documents and attention_permille (of the square of the capacity; 1000
    or more never binds). Nulls there stand for the defaults.

    A few specs, fixed; sizes are counted once per tokenizer. Null and empty texts have no tokens.
    """
    wanted = [c for c in ("pack_id", "tokenizer", "capacity", "most_documents", "attention_permille") if c in specs.columns]
    rows = [r.asDict() for r in specs.select(wanted).distinct().collect() if only in (None, r["pack_id"])]
    out = documents.sparkSession.createDataFrame([], "pack_id string, container bigint, id bigint, piece int, pieces int, tokens bigint")
    for name in sorted({r["tokenizer"] for r in rows}):
        sizes = materialize(encode(documents, id_col, text_col, name, folder, counts_only=True), "sizes")
        for r in sorted(rows, key=lambda r: r["pack_id"]):
            if r["tokenizer"] == name:
                permille = r.get("attention_permille")
                attention = (ATTENTION_PERMILLE if permille is None else permille) * r["capacity"] ** 2 / 1000
                packed = pack(sizes, r["capacity"], r.get("most_documents") or MOST_DOCUMENTS, attention)
                out = out.unionByName(packed.select(F.lit(r["pack_id"]).alias("pack_id"), "*"))
    return out


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(pack_id, containers, tokens, fill): the share of the containers' capacity in use."""
    known = F.broadcast(specs.select("pack_id", "capacity").distinct())
    total = packed.groupBy("pack_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return total.join(known, "pack_id").select("pack_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
