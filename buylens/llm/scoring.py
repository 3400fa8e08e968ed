"""LM scoring by cross-entropy difference.

Two bigram models, of the target documents and of the whole corpus, share one vocabulary (every word of the corpus, by 64-bit hash), order and smoothing. Each
document's score is the mean over its tokens of the target's loss minus the background's: the lower, the more it is like the target.

Texts are read twice, to count words and to number them; after that only batches of token numbers are kept. The most frequent words have small numbers, which all tasks hold
(at most ``Model.held``); a rarer word is known by its hash. Each batch sends its different words and bigrams, sorted and packed, to the buckets that count them over
the corpus, and gets their counts back in the same order. So no count table has to be joined to single occurrences, and what is counted grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import discard, stored


@dataclass(frozen=True)
class Model:
    """Weight of the bigram against the unigram estimate; count added to each word; and the sizes of the work, which change no result."""

    bigram_weight: float = 0.7
    added: float = 0.5
    #: The most frequent words, which tasks hold by hash: 2**20 at most, as bigrams of them have 42 bits.
    held: int = 1 << 20
    #: Tokens of the corpus per bucket of counted keys.
    bucket: int = 1 << 20


#: Different words a task holds before it passes their counts on.
FLUSH = 400_000
# Kinds of keys, in their highest two bits: bigrams of held words, other bigrams by hash, words as tokens, words with a token after them.
_SHIFT = np.uint64(62)
_MASK = np.uint64((1 << 62) - 1)
_RARE = np.uint64(1 << 61)


def packed(values: np.ndarray) -> bytes:
    """Integers, byte by byte of equal weight, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, words by hash."""
    names = ["word", "n"]

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        words, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        found, at = np.unique(words, return_inverse=True)
        return found, np.bincount(at, n, len(found)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            words, n = summed(parts)
            for at in range(0, len(words), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(words[at:at + (1 << 17)].view(np.int64)), pa.array(n[at:at + (1 << 17)])], names=names)
            parts.clear()

        for batch in tx.small_batches(batches):
            parts.append(np.unique(tx.Words(batch.column("text"), tx.SPACED).hash, return_counts=True))
            if sum(len(p[0]) for p in parts) > 2 * FLUSH:
                parts[:] = [summed(parts)]
                if len(parts[0][0]) > FLUSH:
                    yield from flush()
        if parts:
            yield from flush()

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


_BATCH = "batch bigint, ids array<bigint>, sizes array<int>, tokens binary, rare binary"


def numbered(docs: DataFrame, words_held, held: int) -> DataFrame:
    """Batches of documents: their ids and sizes, token numbers from 1 on (0 stands before a text), and the hashes of words that are not held.

    The held words have the numbers 1 to ``held``; the ones after those are places in the batch's own list of rarer words.
    """
    schema = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()), ("rare", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        known, rank = words_held.value
        base = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(tx.small_batches(batches)):
            words = tx.Words(batch.column("text"), tx.SPACED)
            own, at = np.unique(words.hash, return_inverse=True)
            place = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            there = known[place] == own if len(known) else np.zeros(len(own), bool)
            number = np.where(there, rank[place] if len(known) else 0, 0).astype(np.uint32)
            number[~there] = held + 1 + np.arange((~there).sum(), dtype=np.uint32)
            yield tx.rows_to_batch([(base + k, batch.column("doc_id").to_pylist(), np.diff(words.first).tolist(), packed(number[at]), packed(own[~there]))], schema)

    return docs.mapInArrow(run, _BATCH)


class Keys:
    """A batch's tokens as keys to be counted: bigrams, words, and words with a token after them, each sorted; and where each token finds its own."""

    def __init__(self, sizes: list[int], tokens: bytes, rare: bytes, held: int) -> None:
        self.sizes = np.array(sizes, np.int64)
        own, hashes = unpacked(tokens, np.uint32).astype(np.uint64), unpacked(rare, np.uint64)
        before = np.zeros_like(own)
        before[1:] = own[:-1]
        first = np.cumsum(self.sizes) - self.sizes
        before[first[self.sizes > 0]] = 0
        words = np.concatenate([np.arange(held + 1, dtype=np.uint64), _RARE | (tx.mix(hashes) & (_RARE - np.uint64(1)))])
        both = (own <= held) & (before <= held)
        pair = before << np.uint64(21) | own
        wide = tx.mix(tx.mix(words[before[~both].astype(np.int64)] + np.uint64(1)) + words[own[~both].astype(np.int64)])
        pair[~both] = np.uint64(1) << _SHIFT | wide & _MASK
        parts = [np.unique(x, return_inverse=True, return_counts=True) for x in (pair, own, before)]
        #: For each token the place of its bigram, its word, and the word before it among the keys.
        self.places, at = [], 0
        for _, place, n in parts:
            self.places.append(place + at)
            at += len(n)
        self.keys = np.concatenate([parts[0][0], *(np.uint64(k) << _SHIFT | words[parts[k - 1][0].astype(np.int64)] for k in (2, 3))])
        self.pairs, self.words = len(parts[0][0]), len(parts[1][0])

    def counts(self, marked: np.ndarray) -> np.ndarray:
        """Occurrences of each key in all documents and in the ``marked`` ones."""
        token = np.repeat(marked, self.sizes)
        return np.stack([np.bincount(np.concatenate([p[some] for p in self.places]), minlength=len(self.keys)) for some in (slice(None), token)]).astype(np.uint32)

    def routes(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys' order by bucket and value, and where each bucket begins in it."""
        bucket = (tx.mix(self.keys) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.keys, bucket))
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def sent(batches: DataFrame, buckets: int, held: int) -> DataFrame:
    """(bucket, batch, keys, n, target_n): what each batch asks of each bucket; ``marked`` has the places of its target documents."""
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("target_n", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number, sizes, tokens, rare, marked in zip(*[c.to_pylist() for c in part.columns], strict=True):
                own = Keys(sizes, tokens, rare, held)
                flags = np.zeros(len(sizes), bool)
                flags[np.array(marked or [], np.int64)] = True
                n = own.counts(flags)
                order, cuts = own.routes(buckets)
                rows = []
                for k in np.flatnonzero(np.diff(cuts)):
                    at = order[cuts[k]:cuts[k + 1]]
                    rows.append((int(k), number, packed(np.diff(own.keys[at], prepend=np.uint64(0))), packed(n[0, at]), packed(n[1, at])))
                yield tx.rows_to_batch(rows, schema)

    return batches.select("batch", "sizes", "tokens", "rare", "marked").mapInArrow(run, "bucket int, batch bigint, keys binary, n binary, target_n binary")


def answered(asked: DataFrame) -> DataFrame:
    """(batch, bucket, n, target_n): the corpus's counts of the keys that a batch sent, in the order it sent them."""
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("n", pa.binary()), ("target_n", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(unpacked(k, np.uint64), dtype=np.uint64) for k in table["keys"].to_pylist()]
        keys = np.concatenate(parts)
        _, at = np.unique(keys, return_inverse=True)
        totals = []
        for name in ("n", "target_n"):
            n = np.concatenate([unpacked(x, np.uint32) for x in table[name].to_pylist()])
            totals.append(np.bincount(at, n).astype(np.uint64)[at])
        cuts = np.cumsum([0, *map(len, parts)])
        rows = [[packed(t[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for t in totals]
        return pa.table([table["batch"], table["bucket"], pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary())], schema=schema)

    return asked.groupBy("bucket").applyInArrow(run, "batch bigint, bucket int, n binary, target_n binary")


def scored(docs: DataFrame, target: DataFrame, model: Model = Model()) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of ``docs``; ``target`` has the doc_ids of the target documents.

    Losses are bits per token; score is target minus background. A loss mixes the bigram's share among what follows the word before it with the word's smoothed share;
    after a word that a model has never seen (or has seen only at the end of texts) the latter stands alone. One further word, which never occurs, has its share, too.
    Null or empty texts have no tokens and null losses. Without target documents the target model is uniform. Repeated rows are counted and scored each; repeated
    ids in ``target`` count once and a null one never. Extra columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = stored(word_counts(source), "words")
    total = words.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).first()
    top = words.orderBy(F.desc("n"), "word").limit(model.held).select("word").toArrow()["word"].to_numpy().view(np.uint64)
    order = np.argsort(top)
    words_held = spark.sparkContext.broadcast((top[order], (order + 1).astype(np.uint32)))
    discard(words)
    batches = stored(numbered(source, words_held, model.held), "batches")
    # Only ids meet the target's ids, and only places in a batch come back.
    ids = target.select(F.col("doc_id").cast("bigint").alias("_target")).where(F.col("_target").isNotNull()).distinct()
    each = batches.select("batch", F.posexplode(F.arrays_zip("ids", "sizes")).alias("place", "doc"))
    hits = each.join(ids, F.col("doc.ids") == F.col("_target")).select("batch", "place", F.col("doc.sizes").alias("size"))
    marks = stored(hits.groupBy("batch").agg(F.collect_list("place").alias("marked"), F.sum("size").alias("size")), "marks")
    tokens = (total["n"] or 0, marks.agg(F.sum("size")).first()[0] or 0)
    buckets = max(1, -(-tokens[0] // model.bucket))
    counted = stored(answered(sent(batches.join(marks.select("batch", "marked"), "batch", "left"), buckets, model.held)), "counts")
    discard(marks)
    back = counted.groupBy("batch").agg(F.collect_list(F.struct("bucket", "n", "target_n")).alias("counts"))
    mass = model.added * (total["words"] + 1)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc_ids, sizes, numbers, rare, counts in zip(*[c.to_pylist() for c in part.columns], strict=True):
                own = Keys(sizes, numbers, rare, model.held)
                route, cuts = own.routes(buckets)
                n = np.zeros((2, len(own.keys)))
                for row in counts or []:
                    at = route[cuts[row["bucket"]]:cuts[row["bucket"] + 1]]
                    n[0, at], n[1, at] = unpacked(row["target_n"], np.uint64), unpacked(row["n"], np.uint64)
                first = np.cumsum([0, *own.sizes])
                means = []
                for k, count in ((0, tokens[1]), (1, tokens[0])):
                    pair, word, before = (n[k][p] for p in own.places)
                    single = (word + model.added) / (count + mass)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        loss = -np.log2(np.where(before > 0, model.bigram_weight * pair / before + (1 - model.bigram_weight) * single, single))
                        means.append(np.diff(np.concatenate([[0.0], np.cumsum(loss)])[first]) / own.sizes)
                none = own.sizes == 0
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(own.sizes), *(pa.array(x, pa.float64(), mask=none) for x in (*means, means[0] - means[1]))], schema=schema)

    return batches.join(back, "batch", "left").select("ids", "sizes", "tokens", "rare", "counts").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double")
