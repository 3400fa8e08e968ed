"""Benchmark decontamination: a broadcast set of normalised test n-grams against all token windows.

The hashes of all windows of the test items form a sorted array; training windows are looked up in it, and each
hit is verified word by word. The array is broadcast in blocks of at most ``block_grams`` windows, so one block's size is
bounded whatever the size of the test set; more items mean more passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .shared import stored

N = 10
BLOCK_GRAMS = 250_000
_HITS = "spans array<struct<start:int,stop:int>>, items array<bigint>, n_words bigint"


class Grams:
    """Windows of test items: sorted hashes, their words, and the items that have them."""

    def __init__(self, rows: list[tuple[int | None, bytes]]) -> None:
        found: dict[bytes, set[int]] = {}
        for item, gram in rows:
            found.setdefault(gram, set()).update([] if item is None else [item])
        self.grams: dict[int, list[tuple[bytes, set[int]]]] = {}
        words, widths = tx.Words(pa.array([g.decode() for g in found], pa.string()), tx.ALNUM), set()
        for i, (gram, items) in enumerate(found.items()):
            own = words.of(i)
            widths.add(len(own))
            self.grams.setdefault(int(tx.windows(own, len(own))[0]), []).append((gram, items))
        self.widths = sorted(widths)
        self.keys = np.array(sorted(self.grams), dtype=np.uint64)
        # a table of 2**20 bits in front of the binary search
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: tx.Words) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """Of each text with a hit: its number, the word ranges that hit, the items."""
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        doc_of = None
        for width in self.widths:
            if len(words.hash) < width:
                continue
            found = tx.windows(words.hash, width)
            at = np.flatnonzero(self.seen[(found >> np.uint64(44)).astype(np.int64)])
            at = at[np.isin(found[at], self.keys)]
            if not len(at):
                continue
            doc_of = np.searchsorted(words.first, at, "right") - 1
            inside = at + width <= words.first[doc_of + 1]
            for k, doc in zip(at[inside].tolist(), doc_of[inside].tolist(), strict=True):
                own = b" ".join(tx.ALNUM[words.data[words.start[k]:words.end[k + width - 1]]].tobytes().split())
                for gram, ids in self.grams[int(found[k])]:
                    if gram == own:
                        spans.setdefault(doc, []).append((k - int(words.first[doc]), k - int(words.first[doc]) + width))
                        items.setdefault(doc, set()).update(ids)
        for doc, ranges in spans.items():
            yield doc, merged(ranges), items[doc]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_grams(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, gram): each window of ``n`` words of each item, all words where there are fewer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches):
            ids, rows = batch.column(0).to_pylist(), []
            for item, raw in zip(ids, tx.binary(batch.column(1)).to_pylist(), strict=True):
                words = tx.ALNUM[np.frombuffer(raw, dtype=np.uint8)].tobytes().split() if raw else []
                rows += [(item, b" ".join(words[i:i + n])) for i in range(max(1, len(words) - n + 1)) if words]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                                 names=["item_id", "gram"])
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(run, "item_id bigint, gram binary")


def scanned(docs: DataFrame, items: DataFrame, n: int = N, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``docs`` with ``spans`` (word ranges that hit, merged), ``items`` (ids with occurring windows) and ``n_words``.

    Null texts have no words and no hits; items without words have no windows; an item without an id marks words but is
    not listed. Repeated items count once, repeated documents each. Extra columns stay; one named like a result is replaced.
    """
    grams = item_grams(items, n)
    total = grams.count()
    blocks = max(1, -(-total // block_grams))
    numbered = grams.withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(blocks))) if blocks > 1 else grams.withColumn("block", F.lit(0))
    if blocks > 1:
        numbered = stored(numbered, "grams")
    keep = [c for c in docs.columns if c.lower() not in ("spans", "items", "n_words")]
    if blocks == 1:
        return _scan(docs.select(*[f"`{c}`" for c in keep]), numbered)
    # More test windows than one broadcast takes: number the rows once, scan them for each block, merge what was found.
    key = tx.free_name(docs, "_row")
    source = stored(docs.select(*[f"`{c}`" for c in keep], F.expr("uuid()").alias(key)), "documents")
    # Block by block: the driver holds the windows of one, and its hits are written before the next one's windows come.
    parts = [stored(_scan(source.select(key, "text"), numbered.where(F.col("block") == b)).where(F.size("spans") > 0).select(key, "spans", "items"), "hits")
             for b in range(blocks)]
    found = _joined(reduce(DataFrame.unionByName, parts), key)
    whole = _scan(source, numbered.where(F.lit(False))).drop("spans", "items").join(found, key, "left").drop(key)
    return whole.select(*[f"`{c}`" for c in keep], F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"),
                        F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"), "n_words")


def _joined(hits: DataFrame, key: str) -> DataFrame:
    """One row per document, with the spans of all blocks merged as those of one are."""
    gathered = hits.groupBy(key).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "stop": b} for a, b in merged([(s["start"], s["stop"]) for s in own])] for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, spans_type), batch.column(2)], names=[key, "spans", "items"])

    return gathered.mapInArrow(run, gathered.schema)


def _scan(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """One pass with the windows of one block, which the driver turns into a broadcast."""
    rows = [(r.item_id, bytes(r.gram)) for r in grams.select("item_id", "gram").collect()]
    held = docs.sparkSession.sparkContext.broadcast(rows)
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    names = docs.columns
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Grams(held.value)
        for batch in tx.small_batches(batches, names[at]):
            words = tx.Words(batch.column(at), tx.ALNUM)
            spans: list[list[dict[str, int]]] = [[] for _ in range(len(words))]
            items: list[list[int]] = [[] for _ in range(len(words))]
            for doc, ranges, ids in known.hits(words):
                spans[doc], items[doc] = [{"start": a, "stop": b} for a, b in ranges], sorted(ids)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(spans, spans_type), pa.array(items, pa.list_(pa.int64())), pa.array(np.diff(words.first), pa.int64())],
                names=[*names, "spans", "items", "n_words"])

    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(_HITS).fields])
    return docs.mapInArrow(run, schema)


def n_hit() -> F.Column:
    """Words inside the spans."""
    begin = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("end"))
    return F.aggregate("spans", begin, lambda acc, s: F.struct(
        (acc["total"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("total"),
        F.greatest(acc["end"], s["stop"]).alias("end")), lambda acc: acc["total"])


def cleaned(docs: DataFrame, items: DataFrame, remove: str = "documents", n: int = N) -> DataFrame:
    """Without the documents that hit (``remove="documents"``), or with the hit words cut out of their texts (``"spans"``)."""
    found = scanned(docs, items, n)
    if remove == "documents":
        return found.where(F.size("spans") == 0).select(*[f"`{c}`" for c in docs.columns])
    if remove != "spans":
        raise ValueError("remove is documents or spans")
    names = found.columns
    at, spans_at = next(i for i, c in enumerate(names) if c.lower() == "text"), names.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(spans_at).to_pylist()):
                if spans:
                    texts[i] = without(texts[i], [(s["start"], s["stop"]) for s in spans])
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(run, found.schema).select(*[f"`{c}`" for c in docs.columns])


def without(value: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans."""
    words = tx.Words(pa.array([value]), tx.ALNUM)
    raw, kept, at = words.raw(0), [], 0
    for a, b in merged(spans):
        kept.append(raw[at:words.start[a]])
        at = int(words.end[b - 1])
    return b"".join([*kept, raw[at:]]).decode()


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
