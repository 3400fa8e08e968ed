"""Token ids as blocks of a static range asymmetric numeral system.

One frequency table, counted over all documents, serves every block. A block holds up to ``BLOCK`` ids in ``LANES`` interleaved states that share
one stream of 32-bit words; it is decoded without any other. Checkpoints inside a block hold the states and the place in the stream, so parts of a block
can be decoded by themselves; a checksum covers the ids of each part. Blocks are rows of Parquet files that Spark commits, in ascending order of doc_id.

Block layout, little-endian: magic, version, lanes, bits, ids, steps, steps per checkpoint, words (each unsigned 32 bits); per checkpoint its place in the
stream, the checksum of its ids and its states (unsigned 64 bits each); the words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import text as tx
from .shared import folder, stored
from .tokens import ENCODED_BYTES, Encoder, shared_encoder

BITS = 20
LANES = 1024
STEPS_PER_CHECKPOINT = 64
BLOCK = 1 << 18
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4s7I")
_MAGIC, _VERSION = b"RANS", 1


class Table:
    """Frequencies of ids scaled to 2**BITS, each id that occurs with one at least."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order]
        if len(ids) > 1 << BITS:
            raise ValueError(f"more than {1 << BITS} different ids")
        scaled = np.maximum(1, counts.astype(np.float64) * (1 << BITS) / max(1, counts.sum())).astype(np.int64)
        by_size = np.argsort(-scaled, kind="stable")
        rest = (1 << BITS) - int(scaled.sum()) if len(ids) else 0
        if rest > 0:
            scaled[by_size[0]] += rest
        for k in by_size:
            if rest >= 0:
                break
            taken = min(int(scaled[k]) - 1, -rest)
            scaled[k] -= taken
            rest += taken
        self.ids = ids.astype(np.uint32)
        self.freq = scaled.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(scaled)[:-1]]).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)

    def prepare(self) -> Table:
        """Look-up tables, built where they are used."""
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        self.number = np.zeros(size, dtype=np.uint32)
        self.number[self.ids] = np.arange(len(self.ids), dtype=np.uint32)
        self.slot = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))
        return self


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = STEPS_PER_CHECKPOINT) -> bytes:
    """``ids`` (unsigned 32 bits) as one block; ``table`` is prepared and knows every id."""
    steps = -(-len(ids) // lanes)
    symbols = np.zeros(steps * lanes, dtype=np.uint32)
    symbols[:len(ids)] = table.number[ids]
    symbols = symbols.reshape(steps, lanes)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    states: list[np.ndarray] = []
    for step in range(steps - 1, -1, -1):
        freq, start = table.freq[symbols[step]], table.start[symbols[step]]
        full = state >= (freq << np.uint64(63 - BITS))
        words.append(state[full].astype(np.uint32))  # the low 32 bits
        state = np.where(full, state >> np.uint64(32), state)
        times = state // freq
        state = (times << np.uint64(BITS)) + (state - times * freq) + start
        if step % every == 0:
            states.append(state)
    words.reverse()
    states.reverse()
    places = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
    out = [_HEAD.pack(_MAGIC, _VERSION, lanes, BITS, len(ids), steps, every, len(stream))]
    for k, own in enumerate(states):
        part = ids[k * every * lanes:(k + 1) * every * lanes]
        out += [struct.pack("<QQ", int(places[k * every]), zlib.crc32(part.astype("<u4").tobytes())), own.astype("<u8").tobytes()]
    return b"".join([*out, stream.astype("<u4").tobytes()])


def checkpoints(block: bytes) -> int:
    _, _, _, _, _, steps, every, _ = _HEAD.unpack_from(block)
    return -(-steps // every)


def decode_part(block: bytes, k: int, table: Table) -> np.ndarray:
    """The ids from checkpoint ``k`` to the next one; ValueError if the block or its ids are damaged."""
    magic, version, lanes, bits, n, steps, every, n_words = _HEAD.unpack_from(block)
    if magic != _MAGIC or version != _VERSION or bits != BITS:
        raise ValueError("not a block of this format")
    size = 16 + 8 * lanes
    at = _HEAD.size + k * size
    place, crc = struct.unpack_from("<QQ", block, at)
    state = np.frombuffer(block, "<u8", lanes, at + 16).astype(np.uint64)
    stream = np.frombuffer(block, "<u4", n_words, _HEAD.size + -(-steps // every) * size)
    rows = []
    mask, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    for _ in range(k * every, min(steps, (k + 1) * every)):
        low = state & mask
        symbol = table.slot[low]
        rows.append(symbol)
        state = table.freq[symbol] * (state >> shift) + low - table.start[symbol]
        short = np.flatnonzero(state < _LOW)
        if place + len(short) > n_words:
            raise ValueError("the block ends early")
        state[short] = (state[short] << np.uint64(32)) | stream[place:place + len(short)]
        place += len(short)
    if (k + 1) * every < steps:  # the next part begins where this one ends
        at += size
        after, goes_on = np.frombuffer(block, "<u8", lanes, at + 16), struct.unpack_from("<Q", block, at)[0]
    else:
        after, goes_on = _LOW, n_words
    if place != goes_on or (state != after).any():
        raise ValueError("a block's part does not end where the next one begins")
    ids = table.ids[np.concatenate(rows)][:n - k * every * lanes]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block's part differs")
    return ids


def decode_block(block: bytes, table: Table) -> np.ndarray:
    parts = [decode_part(block, k, table) for k in range(checkpoints(block))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def id_type(path: str) -> str:
    """The narrowest type for the tokenizer's ids, for what is stored between the steps."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, ids, counts): each text's ids and the end id as bytes of ``kind``; and, in a last row of each task, how often each id occurred in it."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, counts = shared_encoder(Encoder, path), np.array([end_id], dtype="<u4"), np.zeros(0, dtype=np.int64)
        for batch in tx.small_batches(batches, most=ENCODED_BYTES):
            ids = [np.concatenate([x, end]).astype(kind) for x in encoder.encode_all(batch.column("text"))]
            if ids:
                own = np.bincount(np.concatenate(ids), minlength=len(counts))
                own[:len(counts)] += counts
                counts = own
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.nulls(len(ids), schema.field(2).type)],
                                             schema=schema)
        found = np.flatnonzero(counts)
        yield tx.rows_to_batch([(None, None, [{"id": i, "n": n} for i, n in zip(found.tolist(), counts[found].tolist(), strict=True)])], schema)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, ids binary, counts array<struct<id:bigint,n:bigint>>")


def frequencies(ids: DataFrame) -> Table:
    """The shared table: at most one row for each entry of the vocabulary comes to the driver."""
    pairs = ids.where(F.col("counts").isNotNull()).select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n"))
    table = pairs.toArrow()
    return Table(table["id"].to_numpy(), table["n"].to_numpy())


_FILE = "part int, block int, first bigint, doc_ids array<bigint>, doc_first array<bigint>, doc_tokens array<bigint>, n bigint, payload binary"


def written(docs: DataFrame, path: str, end_id: int, to: str) -> Table:
    """Write the files below ``to``: blocks of each range of doc_id (column ``part``), in order. Gives the shared table, which is stored beside them."""
    spark = docs.sparkSession
    kind = id_type(path)
    ids = stored(encoded(docs, path, end_id, kind), "ids")
    table = frequencies(ids)
    held = spark.sparkContext.broadcast(table)
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_first", pa.list_(pa.int64())),
                        ("doc_tokens", pa.list_(pa.int64())), ("n", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = held.value.prepare(), TaskContext.get().partitionId()
        block, first, size = 0, 0, 0
        docs_in: list[tuple[int | None, int, int]] = []  # id, first id, ids in all; of documents that begin or go on in the block
        held_ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            own = np.concatenate(held_ids)
            columns = [list(x) for x in zip(*docs_in, strict=True)]
            return tx.rows_to_batch([(part, block, first, *columns, len(own), encode_block(own, known))], schema)

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own, begin = np.frombuffer(raw, dtype=kind).astype(np.uint32), first + size
                if size and size + len(own) > BLOCK:
                    yield flush()
                    block, first, size, docs_in, held_ids = block + 1, first + size, 0, [], []
                for at in range(0, len(own), BLOCK):  # a longer document goes on in blocks of its own
                    if at:
                        yield flush()
                        block, first, size, docs_in, held_ids = block + 1, first + size, 0, [], []
                    held_ids.append(own[at:at + BLOCK])
                    docs_in.append((doc, begin, len(own)))
                    size += len(held_ids[-1])
        if size:
            yield flush()

    ordered = ids.where(F.col("ids").isNotNull()).select("doc_id", "ids").repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    ordered.mapInArrow(run, _FILE).write.option("compression", "none").parquet(f"{to}/blocks")
    numbers = zip(table.ids.tolist(), table.freq.astype(np.int64).tolist(), strict=True)
    spark.createDataFrame(list(numbers), "id bigint, freq bigint").coalesce(1).write.parquet(f"{to}/table")
    return table


def read_table(spark: SparkSession, at: str) -> Table:
    rows = spark.read.schema("id bigint, freq bigint").parquet(f"{at}/table").toArrow()
    table = Table(rows["id"].to_numpy(), rows["freq"].to_numpy())
    return table


def _decoded(spark: SparkSession, at: str, name: str, kind: str, of) -> DataFrame:
    """(doc_id, start, n_tokens, fragment, n, ``name``): a row per document and block it lies in; ``of`` makes ``name`` of the ids' bytes.

    ``start`` counts the ids of all documents before it: parts are in order of doc_id, so a running sum over their totals, one row per part, gives it.
    """
    blocks = spark.read.schema(_FILE).parquet(f"{at}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    bases = stored(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    held = spark.sparkContext.broadcast(read_table(spark, at))
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("fragment", pa.int64()), ("n", pa.int64()),
                        (name, pa.binary() if kind == "binary" else pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value.prepare()
        for batch in batches:
            for row in batch.to_pylist():
                ids, rows = decode_block(row["payload"], known).astype("<u4").tobytes(), []
                for doc, begin, n in zip(row["doc_ids"], row["doc_first"], row["doc_tokens"], strict=True):
                    a, b = max(begin, row["first"]), min(begin + n, row["first"] + row["n"])
                    rows.append((row["part"], doc, begin, n, a - begin, b - a, of(ids[4 * (a - row["first"]):4 * (b - row["first"])])))
                yield tx.rows_to_batch(rows, schema)

    found = blocks.mapInArrow(run, f"part int, doc_id bigint, begin bigint, n_tokens bigint, fragment bigint, n bigint, {name} {kind}")
    return found.join(bases, "part").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "fragment", "n", name)


def read(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, fragment, n, ids) from the files alone, ``ids`` as little-endian unsigned 32-bit integers."""
    return _decoded(spark, at, "ids", "binary", lambda raw: raw)


def _times(matrix: list[int], vector: int) -> int:
    return reduce(lambda acc, k: acc ^ matrix[k] if vector >> k & 1 else acc, range(32), 0)


def combined(first: int, second: int, size: int) -> int:
    """Checksum of two byte strings one after the other, from theirs and the second one's length."""
    if not size:
        return first
    one = [0xEDB88320, *(1 << k for k in range(31))]  # by one zero bit
    power, bits = one, 8 * size
    while bits:
        if bits & 1:
            first = _times(power, first)
        power = [_times(power, x) for x in power]
        bits >>= 1
    return first ^ second


def digests(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document from the files alone; the few documents that lie in several blocks are put together
    from their fragments' checksums."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [reduce(lambda acc, x: combined(acc, x["crc"], 4 * x["n"]), own, 0) for own in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = stored(_decoded(spark, at, "crc", "bigint", zlib.crc32), "digests")
    whole = parts.where("n = n_tokens").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    several = parts.where("n < n_tokens").groupBy("doc_id", "start", "n_tokens").agg(
        F.array_sort(F.collect_list(F.struct("fragment", "n", "crc"))).alias("parts"))
    return whole.unionByName(several.mapInArrow(join, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write all documents, read the files back: (doc_id, start, n_tokens, ids_crc32).

    A null or empty text is its end id alone; rows with the same doc_id are ordered by a hash of their ids; a null doc_id comes first. Extra columns are not
    read. An empty table writes no block and gives no rows.
    """
    spark = docs.sparkSession
    at = folder(spark, "rans")
    written(docs, path, end_id, at)
    return digests(spark, at)
