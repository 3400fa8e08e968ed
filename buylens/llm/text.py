"""Words, word hashes, shingle sets and Arrow helpers shared by the operators.

Texts stay in Arrow's UTF-8 buffer: words are found and hashed with numpy over pieces of that
buffer, so the memory of a task is bound by the piece and the longest word, not by the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

PIECE_BYTES = 1 << 19
BATCH_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = b" \t\n\v\f\r"


def lowered(keep: Callable[[int], bool]) -> np.ndarray:
    """Byte table: A-Z to a-z, bytes that are no part of a word to a space."""
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([b if keep(b) else 32 for b in lower], dtype=np.uint8)


#: Words of anything but white space, case folded for A-Z or kept.
SPACED = lowered(lambda b: b not in _SPACE)
EXACT = np.array([32 if b in _SPACE else b for b in range(256)], dtype=np.uint8)
#: Words of 0-9, a-z and bytes from 0x80 on.
ALNUM = lowered(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, as long as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.letters = mix(np.arange(1, 257, dtype=np.uint64))

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, PIECE_BYTES + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_powers = _Powers()


class Words:
    """Words of a batch of texts: 64-bit hash, first and last byte, and where each text's words begin."""

    def __init__(self, texts: pa.Array, table: np.ndarray) -> None:
        texts = binary(texts)
        self.bounds, self.data = buffers(texts)
        parts, lo, size = [], 0, int(self.bounds[-1])
        while lo < size:
            hi = self._cut(lo, min(size, lo + PIECE_BYTES), table)
            parts.append(self._piece(lo, hi, table))
            lo = hi
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        #: words of text i are first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, self.bounds)

    def _cut(self, lo: int, hi: int, table: np.ndarray) -> int:
        """The end of a piece: no word goes on after it."""
        size = int(self.bounds[-1])
        while hi < size:
            ends = np.flatnonzero(table[self.data[hi:hi + PIECE_BYTES]] == 32)
            at = self.bounds[np.searchsorted(self.bounds, hi)]
            stop = min(int(at), hi + int(ends[0]) if len(ends) else size)
            if len(ends) or at < hi + PIECE_BYTES:
                return stop
            hi += PIECE_BYTES
        return size

    def _piece(self, lo: int, hi: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = table[self.data[lo:hi]]
        inside = np.zeros(hi - lo + 2, dtype=bool)
        inside[1:-1] = data != 32
        edge = inside[1:] != inside[:-1]
        starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
        cuts = self.bounds[np.searchsorted(self.bounds, lo, "right"):np.searchsorted(self.bounds, hi)] - lo
        cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]]) if len(cuts) else cuts
        if len(cuts):  # two texts that touch without white space
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        _powers.grow(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_powers.letters[data] * _powers.up[:hi - lo], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * _powers.down[starts] + (ends - starts).astype(np.uint64))
        return starts + lo, ends + lo, hashes

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i]:self.first[i + 1]]

    def raw(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def binary(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()) if texts.type == pa.null() else texts, "").cast(pa.large_binary())


def buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds from 0 on and bytes of a large_binary array without nulls."""
    at = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)[at[0]:at[-1]] if len(values) and values.buffers()[2] is not None else np.zeros(0, np.uint8)
    return at - at[0], data


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; of all words if there are fewer; nothing without words."""
    width = min(width, len(hashes))
    if not width:
        return np.zeros(0, dtype=np.uint64)
    n = len(hashes) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + hashes[k:k + n]
    return mix(out)


def ranges(pieces: pa.Array | np.ndarray, most: int = BATCH_BYTES) -> list[slice]:
    """Runs of rows with at most ``most`` bytes, a longer row alone."""
    out, lo = [], 0
    for i in range(1, len(pieces)):
        if i - lo and pieces[i] - pieces[lo] > most and i - 1 > lo:
            out.append(slice(lo, i - 1))
            lo = i - 1
    return [*out, slice(lo, len(pieces) - 1)] if len(pieces) > 1 else out


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds at most ``most`` bytes of text, a longer text alone."""
    for batch in batches:
        bounds, _ = buffers(binary(batch.column(column)))
        for part in ranges(bounds, most):
            yield batch.slice(part.start, part.stop - part.start)


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else (
        pa.RecordBatch.from_arrays([pa.array([], type=f.type) for f in schema], schema=schema))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as make it new among the columns (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession
