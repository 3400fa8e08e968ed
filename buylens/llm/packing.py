"""Best-fit packing after Martello-Toth dominance reduction.

Documents longer than a sequence are cut into full pieces and a rest. How many pieces there are of each length is all that the packing depends on,
and that table has at most ``capacity`` rows whatever the corpus. On it the reduction fixes sets of up to three lengths that dominate every other
filling of their sequence, as many copies at once as there are; best fit, longest first, packs what is left. The plan says for each length which ranks go to
which sequences. Ranks are numbered per length from counts per task, so no length, however common, meets in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .shared import stored
from .tokens import ENCODED_BYTES, Encoder, shared_encoder

CAPACITY = 4096


@dataclass
class Plan:
    """Rows (length, first rank, count, first sequence, offset): rank first + k goes to sequence first + k."""

    capacity: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    used: defaultdict[int, int] = field(default_factory=lambda: defaultdict(int))
    sequences: int = 0
    fixed: int = 0

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.used[length], count, sequence, offset))
        self.used[length] += count

    def fix(self, lengths: list[int], copies: int) -> None:
        """``copies`` sequences filled with exactly these lengths."""
        offset = 0
        for length in lengths:
            self.put(length, copies, self.sequences, offset)
            offset += length
        self.sequences += copies
        self.fixed += copies


def _least(left: dict[int, int], order: list[int], n: int) -> list[int]:
    """The ``n`` smallest items, fewer if there are fewer."""
    out: list[int] = []
    for length in order:
        out += [length] * min(left[length], n - len(out))
        if len(out) == n:
            break
    return out


def _dominating(length: int, left: dict[int, int], order: list[int], capacity: int) -> list[int] | None:
    """The partners that, with one item of ``length``, dominate every set that contains it; None if none is proven to.

    ``left`` counts the other items, ``order`` holds their lengths, ascending.
    """
    rest = capacity - length
    small = _least(left, order, 3)
    if not small or small[0] > rest:
        return []
    best = order[bisect_right(order, rest) - 1]  # the largest partner that fits
    if best == rest or len(small) == 1 or small[0] + small[1] > rest:
        return [best]
    if len(small) == 3 and sum(small) <= rest:
        return None
    # At most two partners fit: the pair with the largest sum.
    pair, lo, hi = (0, 0, 0), 0, bisect_right(order, rest) - 1
    while lo <= hi:
        a, b = order[hi], order[lo]
        if a + b > rest or (lo == hi and left[a] < 2):
            hi -= 1
        else:
            pair = max(pair, (a + b, a, b))
            lo += 1
    total, a, b = pair
    if best >= total:
        return [best]
    heavier = _least(left, order[bisect_right(order, b):], 2)
    # Any two partners: the larger is at most a, and unless two items heavier than b fit, the smaller is at most b.
    return [a, b] if a == best and (len(heavier) < 2 or sum(heavier) > rest) else None


def reduce(counts: dict[int, int], plan: Plan) -> dict[int, int]:
    """Fix dominating sets until none is found; what is left."""
    left = {k: n for k, n in counts.items() if n}
    changed = True
    while changed:
        changed, order = False, sorted(left)
        for length in reversed(order[:]):
            while left.get(length):
                left[length] -= 1
                others = order if left[length] else [x for x in order if x != length]
                partners = _dominating(length, left, others, plan.capacity)
                left[length] += 1
                if partners is None:
                    break
                chosen = [length, *partners]
                copies = min(left[x] // chosen.count(x) for x in chosen)
                if not copies:
                    break
                plan.fix(chosen, copies)
                changed = True
                for x in chosen:
                    left[x] -= copies
                if any(not left[x] for x in chosen):
                    order = [x for x in order if left[x]]
        left = {k: n for k, n in left.items() if n}
    return left


def best_fit(counts: dict[int, int], plan: Plan) -> None:
    """Longest first, each into the fullest sequence that takes it; alike sequences are handled together."""
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of sequences
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if not open_[room]:
                rooms.insert(bisect_right(rooms, room), room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_right(rooms, length - 1)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room = plan.capacity
                first, n = plan.sequences, -(-todo // (room // length))
                plan.sequences += n
            each = room // length
            full = min(n, todo // each)
            for k in range(each):
                if full:
                    plan.put(length, full, first, plan.capacity - room + k * length)
            todo -= full * each
            add(room - each * length, first, full)
            if full < n:
                some = min(todo, each)
                for k in range(some):
                    plan.put(length, 1, first + full, plan.capacity - room + k * length)
                todo -= some
                add(room - some * length, first + full, 1)
                add(room, first + full + 1, n - full - 1)


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(capacity)
    best_fit(reduce(counts, plan), plan)
    return plan


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, rank): the ids of each piece, and its rank among those of its length in its task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()),
                        ("part", pa.int32()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared_encoder(Encoder, path), TaskContext.get().partitionId()
        ranks, end = defaultdict(int), np.array([end_id], dtype="<u4")
        for batch in tx.small_batches(batches, most=ENCODED_BYTES):
            rows = []
            for doc, own in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text")), strict=True):
                ids = np.concatenate([own, end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    length = min(capacity, len(ids) - at)
                    rows.append((doc, k, at, length, ids[at:at + length].tobytes(), part, ranks[length]))
                    ranks[length] += 1
            yield tx.rows_to_batch(rows, schema)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, piece int, start bigint, length int, ids binary, part int, rank bigint")


def packed(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every piece of every document and its place.

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text is its end id alone. Repeated rows are packed each. Extra columns are not read;
    an empty table gives no rows.
    """
    cut = stored(pieces(docs, path, end_id, capacity), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "bases")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows = np.array(sorted(planned(totals, capacity).rows), dtype=np.int64).reshape(-1, 5)
    held = docs.sparkSession.sparkContext.broadcast(rows)
    names = ["doc_id", "piece", "start", "length", "ids", "rank", "base"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = held.value.T
        keys = (length << 44) + first
        for batch in batches:
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy().astype(np.int64) << 44) + rank, "right") - 1
            own = {c: batch.column(c) for c in names[:5]}
            own["length"] = own["length"].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*own.values(), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                                             names=[*own, "sequence_id", "offset"])

    return cut.join(bases, ["part", "length"]).select(*names).mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, pieces): each sequence's pieces in order; a sequence has at most ``capacity`` of them."""
    return placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("pieces"))


def with_crc(placed: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``, in the same place; a column expression, so no second Python worker runs beside the one that places."""
    return placed.select(*[F.crc32("ids").alias("ids_crc32") if c == "ids" else F.col(f"`{c}`") for c in placed.columns])
