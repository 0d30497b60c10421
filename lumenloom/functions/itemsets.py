"""Texts as sets of hashed items, and the arrays that set joins work on.

The items of a text, in lower case: of each maximal run of Chinese characters (U+4E00 to U+9FFF) all
pairs of neighbouring characters (a run of one is one item); each other maximal run of letters and
digits is one item. An item is carried as a 48-bit hash, in six bytes where sets are written down.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

_ASCII = re.compile("[a-z0-9]+")
_ANY = re.compile("[一-鿿]+|[^\\W_一-鿿]+")

#: Bytes of an item where it is written down, and the bits of its hash that are kept.
ITEM_BYTES = 6
ITEM_MASK = (1 << 8 * ITEM_BYTES) - 1
#: Distinct words a worker remembers the hash of; beyond it the memory is emptied.
REMEMBERED_WORDS = 400_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) & ITEM_MASK
        return h


def items(text: str) -> list[str]:
    """The items of one text, in order, repeats included."""
    text = text.lower()
    if text.isascii():
        return _ASCII.findall(text)
    out: list[str] = []
    for run in _ANY.findall(text):
        if len(run) > 1 and "一" <= run[0] <= "鿿":
            out.extend(run[i : i + 2] for i in range(len(run) - 1))
        else:
            out.append(run)
    return out


class ItemSets:
    """A batch of sets: ``flat`` holds each set's sorted distinct items, set i at starts[i]:starts[i]+sizes[i]."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self._index()

    def __getstate__(self):
        return self.flat, self.sizes

    def __setstate__(self, state):
        self.flat, self.sizes = state
        self._index()

    def _index(self) -> None:
        sizes = self.sizes
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def take(self, keep: np.ndarray) -> ItemSets:
        return ItemSets(self.flat[keep[self.owner]], self.sizes[keep])

    def pick(self, which: np.ndarray) -> ItemSets:
        """The sets of the given indexes, repeats allowed."""
        sizes = self.sizes[which]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return ItemSets(self.flat[np.repeat(self.starts[which], sizes) + inside], sizes)

    def blobs(self) -> pa.Array:
        """Each set as its items' bytes, little-endian, ``ITEM_BYTES`` an item."""
        offsets = np.append(self.starts, len(self.flat)).astype(np.int32) * ITEM_BYTES
        data = np.ascontiguousarray(self.flat).view(np.uint8).reshape(-1, 8)[:, :ITEM_BYTES].tobytes()
        return pa.Array.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])

    @staticmethod
    def of_blobs(column: pa.Array) -> ItemSets:
        ends, data = binary_parts(column)
        flat = np.zeros((len(data) // ITEM_BYTES, 8), np.uint8)
        flat[:, :ITEM_BYTES] = data.reshape(-1, ITEM_BYTES)
        return ItemSets(flat.view(np.uint64).ravel(), np.diff(ends) // ITEM_BYTES)

    def identity(self) -> np.ndarray:
        """A 64-bit hash of each whole set (non-empty sets only)."""
        mixed = scramble(self.flat, 0x51)
        total = np.add.reduceat(mixed, self.starts)
        other = np.bitwise_xor.reduceat(scramble(self.flat, 0xA7), self.starts)
        return scramble(total ^ scramble(other, 3) ^ self.sizes.astype(np.uint64), 9).view(np.int64)

    def sketch(self, words: int = 2) -> np.ndarray:
        """64 parity bits a word and set: the Hamming distance of two sketches never exceeds that of the sets."""
        bit = self.flat % np.uint64(64 * words)
        one, zero = np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)
        word = bit >> np.uint64(6)
        return np.stack([np.bitwise_xor.reduceat(np.where(word == w, one, zero), self.starts) for w in range(words)], 1)


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets (from zero) and the bytes of a binary column, without a copy; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return ends - ends[0], data


def scramble(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective mix of 64-bit values, another one for each salt."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def item_sets(texts: list[str | None], memory: _Hashes) -> ItemSets:
    """The sets of a batch; a null text has an empty one."""
    flat: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            found = [memory[w] for w in set(items(text))]
            lengths[i] = len(found)
            flat += found
    values = np.array(flat, np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    return ItemSets(values[by_owner(values, owner, len(texts))], lengths)


def by_owner(values: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """The order by owner, then value: a plain sort, then a radix sort of small integers."""
    order = np.argsort(values)
    small = owner[order].astype(np.uint16 if owners <= 65536 else np.int64)
    return order[np.argsort(small, kind="stable")]


def new_memory() -> dict:
    return _Hashes()


def required_overlap(a, b, permille: int):
    """The fewest shared items that give sets of a and b items a likeness of permille/1000."""
    return -(-(a + b) * permille // (1000 + permille))


def most_differences(a, b, permille: int):
    """The largest symmetric difference of such sets."""
    return (a + b) - 2 * required_overlap(a, b, permille)
