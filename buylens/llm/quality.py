"""Quality rules by compression bands.

A text that repeats itself compresses too well, noise hardly at all. Each text is compressed as a
whole and in fixed chunks; the ratio of bytes to compressed bytes has to lie in a band that depends
on the length. Counts of words, symbols, repeated lines and repeated windows come with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from . import text as tx

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """``whole``: (longest in bytes, least ratio, largest ratio), ascending; the last one has no end.

    ``chunk``: least and largest ratio of each full chunk of ``chunk_bytes``; a rest of at least half a chunk
    counts as a chunk too. Short texts carry the compressor's header, hence the lower limits there.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.60, 2.2), (256, 0.90, 2.6), (512, 1.05, 2.9), (1024, 1.15, 3.2), (2048, 1.30, 3.6), (8192, 1.45, 4.2),
        (65536, 1.55, 5.0), (float("inf"), 1.60, 6.0))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (1.35, 4.5)
    level: int = 3
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


SCHEMA = pa.schema([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("ratio", pa.float64()), ("chunk_min", pa.float64()), ("chunk_max", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
_DDL = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double, "
        "chunk_min double, chunk_max double, base_failed boolean, kept boolean")


def repeated_words(hashes: np.ndarray, width: int) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    if len(hashes) <= width:
        return 0
    found = tx.windows(hashes, width)
    ordered = np.sort(found)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(found, twice))
    edge = np.zeros(len(hashes) + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def verdict(raw: bytes, press: zstandard.ZstdCompressor, bands: Bands) -> tuple[float, float | None, float | None, bool]:
    """Ratio of the whole text, least and largest ratio of its chunks, and whether all lie in their bands."""
    if not raw:
        return 0.0, None, None, False
    ratio = len(raw) / len(press.compress(raw))
    low, high = next((lo, hi) for most, lo, hi in bands.whole if len(raw) <= most)
    size, chunks = bands.chunk_bytes, []
    if len(raw) > size:  # a single chunk is the whole text
        # The last chunk ends where the text ends, so that every byte is in one.
        starts = [*range(0, len(raw) - size + 1, size), *([len(raw) - size] if len(raw) % size else [])]
        chunks = [len(part) / len(press.compress(part)) for part in (raw[i:i + size] for i in starts)]
    fine = low <= ratio <= high and all(bands.chunk[0] <= x <= bands.chunk[1] for x in chunks)
    return ratio, min(chunks, default=None), max(chunks, default=None), fine


def measure(texts: pa.Array, bands: Bands) -> list[pa.Array]:
    words, chars = tx.Words(texts, tx.EXACT), pc.utf8_length(pc.fill_null(texts, "")).to_pylist()
    press, rows = zstandard.ZstdCompressor(level=bands.level), []
    for i in range(len(words)):
        raw, own = words.raw(i), words.of(i)
        again = repeated_words(own, bands.window)
        failed = len(own) < bands.min_words or 100 * again > bands.max_repeat_percent * len(own)
        ratio, low, high, fine = verdict(raw, press, bands)
        white = len(raw) - len(raw.translate(None, tx._SPACE))
        rows.append((len(own), chars[i] - white, len(raw) - len(raw.translate(None, SYMBOLS)), repeated_lines(raw), again, ratio, low, high,
                     failed, not failed and fine))
    return tx.rows_to_batch(rows, SCHEMA).columns


def scored(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``docs`` with the columns of ``SCHEMA``, in one pass and without a shuffle.

    Null and empty texts have no words, so they fail. Repeated rows are judged alike, each by itself. An extra column with the
    name of a result is replaced by the result. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c.lower() not in set(SCHEMA.names)]
    source = docs.select(*[f"`{c}`" for c in others])
    fields = ", ".join(f"`{c}` {t}" for c, t in source.dtypes)
    at = next(i for i, c in enumerate(others) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, others[at]):
            yield pa.RecordBatch.from_arrays([*batch.columns, *measure(batch.column(at), bands)], names=[*others, *SCHEMA.names])

    return source.mapInArrow(run, f"{fields}, {_DDL}")


def filtered(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with their own columns."""
    name = tx.free_name(docs, "_kept")
    source = docs.select("*", docs["text"].alias(name))
    keep = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, name):
            fine = measure(batch.column(len(keep) - 1), bands)[-1]
            yield pa.RecordBatch.from_arrays(batch.columns, names=keep).filter(fine)

    return source.mapInArrow(run, source.schema).drop(name)
