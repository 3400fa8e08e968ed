"""Hard negatives from windows below each positive's score, over Hilbert-ordered blocks with zone maps.

Rows are written as Parquet blocks in the order of label and Hilbert curve. Every block carries, for each dimension, the least and the greatest
component, and its least and greatest label. The inner product of an anchor with any row of a block lies between two sums of products with these
bounds, so a block is opened for an anchor only if that interval meets the scores the anchor still looks for: those of its positives, then those
of the window below each positive. Nothing is estimated; a block that cannot be excluded is read.

Anchors come in rounds of bounded size. Within a round three passes go over the zone maps: positives, windows on every ``PROBE``-th block, and
windows on all other blocks with the probe's fifth scores as the least that count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .text import rows_to_batch

PROBE = 16
LOWEST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    """What counts as anchor, positive and negative, and the sizes of the work (which change no result)."""

    every: int = 100
    positives: int = 5
    negatives: int = 5
    low_percent: int = 80
    #: Rows of a block, and bits of each dimension in the Hilbert key.
    block_rows: int = 1024
    bits: int = 2
    #: Bytes of the anchors' vectors that one round broadcasts.
    anchor_bytes: int = 32 << 20


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of ``cells`` (integers below 2**bits) on the Hilbert curve, as bytes that sort in its order.

    The axes are turned into the curve's transposed index bit by bit, from the highest, for all rows at once.
    """
    x = cells.astype(np.uint32).copy()
    n, dims = x.shape
    if not dims:
        return [b""] * n
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(dims):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint32(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, -1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn[:, None]
    planes = np.stack([(x >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1)], axis=1).reshape(n, bits * dims)
    return [row.tobytes() for row in np.packbits(planes.astype(np.uint8), axis=1)]


def dots(left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Inner products of all rows of both as 64-bit integers; by way of doubles where these are exact."""
    if left.shape[1] * most * most < 1 << 52:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def intervals(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product each anchor can have with a vector between ``lo`` and ``hi``, rounded outwards."""
    up, down = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
    lo, hi = lo.astype(np.float64), hi.astype(np.float64)
    most, least = up @ hi + down @ lo, up @ lo + down @ hi
    slack = 1 + 1e-9 * (np.abs(most) + np.abs(least))
    return least - slack, most + slack


def vectors(rows: DataFrame) -> DataFrame:
    """Rows that take part: ``vec_id``, ``label`` (moved on where the id is divisible by 7) and ``v``, the components as integers.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows with the same id the one with the least
    (label, vector) counts, so repeated rows count once. Other columns are ignored.
    """
    value = lambda x: x.cast("double")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) != F.lit(float("inf"))))
    label = F.col("label").cast("long")
    fit = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.struct(F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                 F.transform("embedding", lambda x: F.floor(F.lit(256.0) * value(x))).alias("v")).alias("row"))
    return fit.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.int64)
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    if len(flat) == len(sizes) * dims:
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


_BLOCK = "block long, n int, label_lo long, label_hi long, lo binary, hi binary, ids binary, labels binary, vectors binary"


def blocks(source: DataFrame, mining: Mining, dims: int, least: int, most: int) -> DataFrame:
    """One row per block, in the order of label, Hilbert key and id; rows within a block by id. ``shelf`` is the folder of a run of blocks."""
    bits, size = mining.bits, mining.block_rows
    step = max(1, -(-(most - least + 1) >> bits))
    keyed = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64())), ("curve", pa.binary())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.clip((_matrix(batch.column(2), dims) - least) // step, 0, (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, bits), pa.binary())], schema=keyed)

    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("label_lo", pa.int64()), ("label_hi", pa.int64()),
                        *[(c, pa.binary()) for c in ("lo", "hi", "ids", "labels", "vectors")], ("shelf", pa.int32())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shelf, count, kept, rows = TaskContext.get().partitionId(), 0, [], 0

        def block(part: pa.Table) -> pa.RecordBatch:
            nonlocal count
            part = part.sort_by("vec_id").combine_chunks()
            ids, labels, v = np.asarray(part["vec_id"]), np.asarray(part["label"]), _matrix(part["v"], dims)
            number, count = (shelf << 32) + count, count + 1
            return rows_to_batch([(number, len(ids), int(labels.min()), int(labels.max()), v.min(0).tobytes(), v.max(0).tobytes(),
                                   ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), v.tobytes(), shelf)], schema)

        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            while rows >= size:
                table = pa.Table.from_batches(kept)
                yield block(table.slice(0, size))
                kept, rows = table.slice(size).to_batches(), rows - size
        if rows:
            yield block(pa.Table.from_batches(kept))

    ordered = source.select("vec_id", "label", "v").mapInArrow(keys, "vec_id long, label long, v array<long>, curve binary")
    # The id is part of the range key, so that many rows with one vector are dealt to many partitions.
    ordered = ordered.repartitionByRange("label", "curve", "vec_id").sortWithinPartitions("label", "curve", "vec_id")
    return ordered.select("vec_id", "label", "v").mapInArrow(packed, _BLOCK + ", shelf int")


class Anchors:
    """Anchors of one round, as arrays: the broadcast part of a pass."""

    def __init__(self, rows: list, dims: int, windows: int) -> None:
        rows = sorted(rows, key=lambda r: r.vec_id)
        self.id = np.array([r.vec_id for r in rows], np.int64)
        self.label = np.array([r.label for r in rows], np.int64)
        self.v = np.zeros((len(rows), dims), np.int64)
        for k, r in enumerate(rows):
            v = np.frombuffer(r.vector, np.int64)
            self.v[k, :len(v)] = v
        #: Scores looked for: from low to high, and the least that still counts; positives have one window.
        self.low = np.full((len(rows), windows), LOWEST, np.int64)
        self.high = np.full((len(rows), windows), LOWEST, np.int64)
        self.floor = np.full((len(rows), windows), LOWEST, np.int64)


def _needs(a: Anchors, same: bool, floor: np.ndarray, lo: np.ndarray, hi: np.ndarray, label_lo: int, label_hi: int) -> np.ndarray:
    """Anchors whose windows the block can hold a row for."""
    least, most = intervals(a.v, lo, hi)
    fits = (label_lo <= a.label) & (a.label <= label_hi) if same else ~((a.label == label_lo) & (a.label == label_hi))
    meets = (least[:, None] <= a.high) & (most[:, None] >= np.maximum(a.low, floor))
    return np.flatnonzero(fits & meets.any(1))


def _search(table: DataFrame, shared, same: bool, count: int, most: int, parity: str) -> DataFrame:
    """(anchor, window, id, score): the best ``count`` rows that each task finds for each window, from the blocks that the zone maps leave."""
    zones = table.select("block", "label_lo", "label_hi", "lo", "hi").where(parity)
    number = pa.schema([("chosen", pa.int64())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for batch in batches:
            chosen = [(block,) for block, label_lo, label_hi, lo, hi in zip(*[c.to_pylist() for c in batch.columns], strict=True)
                      if len(_needs(a, same, a.floor, np.frombuffer(lo, np.int64), np.frombuffer(hi, np.int64), label_lo, label_hi))]
            yield rows_to_batch(chosen, number)

    out = pa.schema([("anchor", pa.int32()), ("win", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        floor, shape = a.floor.copy(), (*a.floor.shape, count)
        best = np.full(shape, LOWEST, np.int64)
        best_id = np.full(shape, -1, np.int64)
        held = np.zeros(a.floor.shape, np.int64)
        for batch in batches:
            for n, label_lo, label_hi, lo, hi, ids, labels, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lo, hi, ids, labels = (np.frombuffer(x, np.int64) for x in (lo, hi, ids, labels))
                need = _needs(a, same, floor, lo, hi, label_lo, label_hi)
                if not len(need):
                    continue
                scores = dots(a.v[need], np.frombuffer(v, np.int64).reshape(n, -1), most)
                match = (labels[None, :] == a.label[need][:, None]) & (ids[None, :] != a.id[need][:, None]) if same else labels[None, :] != a.label[need][:, None]
                for w in range(floor.shape[1]):
                    fits = match & (scores <= a.high[need, w][:, None]) & (scores >= np.maximum(a.low[need, w], floor[need, w])[:, None])
                    # Only the block's own best of each anchor can matter; its rows come by id, so equal scores keep the smaller ids.
                    ranked = fits.sum(1)
                    for k in np.flatnonzero(ranked):
                        at = np.flatnonzero(fits[k])
                        row = scores[k, at]
                        if len(at) > count:
                            cut = np.partition(row, len(row) - count)[len(row) - count]
                            at, row = at[row >= cut], row[row >= cut]
                        i, m = need[k], held[need[k], w]
                        s, d = np.concatenate([best[i, w, :m], row]), np.concatenate([best_id[i, w, :m], ids[at]])
                        keep = np.lexsort((d, -s))[:count]
                        held[i, w] = len(keep)
                        best[i, w, :len(keep)], best_id[i, w, :len(keep)] = s[keep], d[keep]
                        if len(keep) == count:
                            floor[i, w] = max(floor[i, w], s[keep][-1])
        i, w, k = np.nonzero(np.arange(count)[None, None, :] < held[:, :, None])
        for at in range(0, max(1, len(i)), 1 << 16):
            p = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(i[p].astype(np.int32)), pa.array(w[p].astype(np.int32)), pa.array(best_id[i[p], w[p], k[p]]),
                                              pa.array(best[i[p], w[p], k[p]])], schema=out)

    picked = zones.mapInArrow(choose, "chosen long")
    opened = table.join(picked, F.col("block") == F.col("chosen"), "left_semi").select("n", "label_lo", "label_hi", "lo", "hi", "ids", "labels", "vectors")
    found = opened.mapInArrow(scan, "anchor int, win int, id long, score long")
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mined(rows: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` for the rows of ``vec_id``, ``embedding``, ``label``.

    Scores are integer inner products, ties go to the smaller id; a vector shorter than the longest counts as filled up with zeros. An anchor
    without another row of its label, or a window without a row, gives no rows; an empty table gives none. See ``vectors`` for rows that take no
    part. Scores are exact while they stay inside 64 bits.
    """
    spark = rows.sparkSession
    source = stored(vectors(rows), "vectors")
    row = source.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v")), F.sum((F.col("vec_id") % mining.every == 0).cast("long"))).first()
    dims, least, top, anchors = (int(x or 0) for x in row)
    most = max(abs(least), abs(top))
    spark_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not anchors:
        return spark.createDataFrame([], spark_schema)
    table = stored(blocks(source, mining, dims, least, top), "vector-blocks", by="shelf")
    rounds = -(-anchors * max(1, dims) * 8 // mining.anchor_bytes)
    asked = source.where(F.col("vec_id") % mining.every == 0)
    parts = [_round(table, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r) if rounds > 1 else asked, mining, dims, most) for r in range(rounds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _round(table: DataFrame, asked: DataFrame, mining: Mining, dims: int, most: int) -> DataFrame:
    """Results of one round of anchors; each pass is written, as the next one starts from its scores."""
    spark = table.sparkSession
    packed = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in _matrix(batch.column(2), dims)], pa.binary())], schema=packed)

    listed = asked.select("vec_id", "label", "v").mapInArrow(pack, "vec_id long, label long, vector binary").collect()
    first = Anchors(listed, dims, 1)
    first.high[:] = np.iinfo(np.int64).max
    nearest = stored(_search(table, spark.sparkContext.broadcast(first), True, mining.positives, most, "true"), "positives")
    second = Anchors(listed, dims, mining.positives)
    # An unused window ends below its beginning, as that of a negative score does: nothing fits it.
    second.low[:] = 0
    for r in nearest.collect():
        second.high[r.anchor, r.rank - 1] = r.score
        second.low[r.anchor, r.rank - 1] = -(-mining.low_percent * r.score // 100)
    probe = stored(_search(table, spark.sparkContext.broadcast(second), False, mining.negatives, most, f"pmod(block + shelf, {PROBE}) = 0"), "window-probe")
    third = Anchors(listed, dims, mining.positives)
    third.low, third.high = second.low, second.high
    for r in probe.where(F.col("rank") == mining.negatives).collect():
        third.floor[r.anchor, r.win] = r.score
    rest = _search(table, spark.sparkContext.broadcast(third), False, mining.negatives, most, f"pmod(block + shelf, {PROBE}) <> 0")
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    both = probe.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mining.negatives)
    positives = nearest.select("anchor", (F.col("rank") - 1).alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = spark.createDataFrame([(k, int(x)) for k, x in enumerate(first.id)], "anchor int, anchor_id long")
    return both.join(positives, ["anchor", "win"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
