"""Words of Arrow string columns as NumPy arrays, without a Python object each.

A task of mapInArrow gets record batches; ``blocks`` cuts them into pieces of a
few megabytes so that memory is bounded whatever the batch size, and ``Words``
finds the words of a piece in its bytes and gives each a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The bytes \x20 and \x09-\x0D.
WHITE_BYTES = np.zeros(256, bool)
WHITE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
#: After lower-casing, everything but digits, a-z and the bytes of non-ASCII characters.
SIGN_BYTES = np.zeros(256, bool)
SIGN_BYTES[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9E3779B97F4A7C55)
_powers = np.cumprod(np.full(256, _STEP, np.uint64))


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), _STEP, np.uint64))
    return _powers


def strings(column: pa.Array) -> pa.Array:
    """A plain string array without nulls."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    return column.fill_null("")


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches of about limit bytes of text, a row at least each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = strings(batch.column(batch.schema.get_field_index(column)))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


class Words:
    """The words of a string array: bytes, where they start and end, and hashes.

    first[r] to first[r + 1] are the words of row r.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = WHITE_BYTES, fold: bool = False):
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.raw = raw
        self.data = _FOLD[raw] if fold else raw
        inside = ~separators[self.data]
        n = len(raw)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~inside[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~inside[1:]
        self.starts = np.flatnonzero(inside & (before | edge[:n]))
        self.ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.offsets = offsets
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def _encoded(self) -> pa.DictionaryArray:
        lengths = self.ends - self.starts
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        words = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[self._inside])])
        return words.dictionary_encode()

    def exact_ids(self) -> np.ndarray:
        """A number for each word, the same for equal words only."""
        return self._encoded().indices.to_numpy()

    def distinct(self) -> tuple[np.ndarray, list[bytes]]:
        """The same numbers, and the words that they stand for."""
        found = self._encoded()
        return found.indices.to_numpy(), found.dictionary.to_pylist()

    def hashes(self, family: int = 0) -> np.ndarray:
        """A uint64 for each word; those of another family don't follow from these."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters = mix(_BYTE ^ np.uint64(family)) if family else _BYTE
        values = letters[self.data[self._inside]] * _power(int(lengths.max()))[place]
        return mix(np.add.reduceat(values, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that Words gives single words; for small fixed lists."""
    return np.concatenate([Words(strings(pa.array([w]))).hashes() for w in words]) if words else np.zeros(0, np.uint64)


def window_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of n consecutive words of a row, and the row borders
    among them (a row of fewer than n words has none).
    """
    per_row = np.maximum(np.diff(first) - n + 1, 0)
    borders = np.concatenate([[0], np.cumsum(per_row)])
    starts = np.arange(borders[-1]) + np.repeat(first[:-1] - borders[:-1], per_row)
    total = np.zeros(borders[-1], np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            total = total * _STEP + hashes[starts + i]
    return mix(total), borders
