"""Ranked lexical search for many items at once, with what they share computed once.

All items of a round are one expression: each item's score is a sum of term impacts. Pairs of summands that several items share are mined again and
again, the most shared one first, and become nodes of their own (a node may hold nodes, so larger shared term sets grow out of pairs). What is left is a
directed graph: leaves are terms, inner nodes are partial sums shared by items. A block of documents gets the impacts of its terms, then every node's
accumulator once, and the items' scores are combined from those. Mining changes the amount of work, never a score.

Documents are read once per round: their counts of the round's terms are written as a table, from which document frequencies and scores are taken.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .shared import discard, stored


@dataclass(frozen=True)
class Ranking:
    """How many documents an item gets, and the sizes of the work (which change no result)."""

    top: int = 20
    #: Terms (with repeats) of the items that one round broadcasts; an item of more is a round of its own.
    round_terms: int = 1 << 16
    #: Summands of an item that are mined together; those of a longer item are mined in parts.
    width: int = 48
    #: Accumulators held at once: nodes times documents of a block.
    cells: int = 1 << 21


def shared_sums(items: list[Counter], leaves: int, width: int = 48) -> tuple[list[tuple[int, int]], list[Counter]]:
    """Inner nodes, as pairs of earlier nodes (leaves are 0 to ``leaves`` - 1, inner ones follow), and each item as counted nodes.

    Every item is the sum of its nodes, and a node is the sum of its two.
    """
    used = Counter(t for item in items for t in item)
    parts: list[dict[int, int]] = []
    owner = []
    for k, item in enumerate(items):
        order = sorted(item, key=lambda t: (-used[t], t))
        for at in range(0, len(order), width):
            parts.append({t: item[t] for t in order[at:at + width]})
            owner.append(k)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for p, part in enumerate(parts):
        own = sorted(part)
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                if used[a] > 1 and used[b] > 1:
                    where[a, b].add(p)
    heap = [(-len(s), pair) for pair, s in where.items() if len(s) > 1]
    heapq.heapify(heap)
    nodes: list[tuple[int, int]] = []
    while heap:
        n, pair = heapq.heappop(heap)
        holders = where.get(pair, set())
        if len(holders) != -n:
            if len(holders) > 1:
                heapq.heappush(heap, (-len(holders), pair))
            continue
        node, grown = leaves + len(nodes), set()
        nodes.append(pair)
        for p in sorted(holders):
            part = parts[p]
            times = min(part[pair[0]], part[pair[1]])
            for t in pair:
                part[t] -= times
                if not part[t]:
                    del part[t]
                    for other in part:
                        where[min(t, other), max(t, other)].discard(p)
            where[pair].discard(p)
            for other in part:
                where[other, node].add(p)
                grown.add((other, node))
            part[node] = times
        for new in grown:
            if len(where[new]) > 1:
                heapq.heappush(heap, (-len(where[new]), new))
    out = [Counter() for _ in items]
    for k, part in zip(owner, parts, strict=True):
        out[k].update(part)
    return nodes, out


class Round:
    """The items of one round: their terms, the sharing graph, and, once counted, the terms' weights."""

    def __init__(self, terms: list[np.ndarray], ranking: Ranking) -> None:
        self.terms = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        items = [Counter(np.searchsorted(self.terms, own).tolist()) for own in terms]
        self.nodes, self.items = shared_sums(items, len(self.terms), ranking.width)
        self.weight = np.zeros(len(self.terms), np.int64)
        self.documents = self.length = 0

    def scores(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Scores, item by document, from counts of terms in a block of documents with ``n`` words each."""
        m = 100 - 25 + (25 * n * self.documents) // self.length
        sums = np.zeros((len(self.terms) + len(self.nodes), len(n)), np.int64)
        sums[term, doc] = self.weight[term] * ((10**9 * tf) // (1000 * tf + 12 * m[doc]))
        for k, (a, b) in enumerate(self.nodes, len(self.terms)):
            np.add(sums[a], sums[b], out=sums[k])
        out = np.zeros((len(self.items), len(n)), np.int64)
        for k, item in enumerate(self.items):
            for node, times in item.items():
                out[k] += sums[node] if times == 1 else times * sums[node]
        return out


class Best:
    """The first ``top`` documents of each item so far: by falling score, then by rising id, null ids last."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.least = top, np.ones(items, np.int64)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * items

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        fits = scores >= self.least[:, None]
        for k in np.flatnonzero(fits.any(1)):
            at = np.flatnonzero(fits[k])
            s, z, d = (np.concatenate(x) for x in zip(self.held[k], (scores[k, at], null[at], ids[at]), strict=True))
            keep = np.lexsort((d, z, -s))[:self.top]
            self.held[k] = s[keep], z[keep], d[keep]
            if len(keep) == self.top:
                self.least[k] = s[keep[-1]]


def _listed(items: DataFrame) -> DataFrame:
    """``item_id``, sorted term hashes and their number, one row per different item with terms."""
    schema = pa.schema([("item_id", pa.int64()), ("terms", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches):
            words = tx.Words(batch.column(1), tx.ALNUM)
            yield tx.rows_to_batch([(i, np.sort(words.of(k)).tobytes(), len(words.of(k))) for k, i in enumerate(batch.column(0).to_pylist()) if len(words.of(k))], schema)

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms binary, n long").distinct()


def _counts(docs: DataFrame, terms) -> DataFrame:
    """Per document with a word: ``doc_id``, ``n`` (its words), and numbers and counts of the round's terms in it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in tx.small_batches(batches):
            words = tx.Words(batch.column(1), tx.ALNUM)
            sizes = np.diff(words.first)
            at = np.minimum(np.searchsorted(known, words.hash), max(0, len(known) - 1))
            mine = np.flatnonzero(known[at] == words.hash) if len(known) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)[mine]
            key, tf = np.unique(doc * len(known) + at[mine], return_counts=True)
            term, tf = (key % max(1, len(known))).astype(np.uint32), tf.astype(np.uint32)
            cut = np.searchsorted(key, np.arange(len(sizes) + 1) * len(known))
            yield tx.rows_to_batch([(i, int(sizes[k]), term[cut[k]:cut[k + 1]].tobytes(), tf[cut[k]:cut[k + 1]].tobytes())
                                    for k, i in enumerate(batch.column(0).to_pylist()) if sizes[k]], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def _frequencies(counts: DataFrame, terms: int) -> DataFrame:
    """(term, documents that hold it), summed up in each task first."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            _, flat = tx.buffers(batch.column(0).cast(pa.large_binary()))
            df += np.bincount(flat.view(np.uint32), minlength=terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], schema=schema)

    return counts.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _scored(counts: DataFrame, shared, ranking: Ranking) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Round = shared.value
        best = Best(len(own.items), ranking.top)
        step = max(8, ranking.cells // max(1, len(own.terms) + len(own.nodes)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                bounds, flat = tx.buffers(batch.column(2).cast(pa.large_binary()))
                doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds) // 4)
                tf = tx.buffers(batch.column(3).cast(pa.large_binary()))[1].view(np.uint32).astype(np.int64)
                ids = batch.column(0)
                scores = own.scores(doc, flat.view(np.uint32).astype(np.int64), tf, np.asarray(batch.column(1)))
                best.add(scores, np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()))
        for at in range(0, len(own.items), 1024):
            yield tx.rows_to_batch([(k, None if z else int(d), int(s)) for k, held in enumerate(best.held[at:at + 1024], at) for s, z, d in zip(*held, strict=True)], schema)

    return counts.mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: for each item the documents of the highest score above 0, equal ones by rising ``doc_id``.

    Null and empty texts have no terms: such documents are no part of the statistics, such items get no rows. Repeated documents are ranked each
    for itself, null ids after all others of their score. Rows with the same id and terms are one item; two texts under one id are ranked each for
    itself. Further columns are ignored. Terms are held as 64-bit hashes.
    """
    spark = docs.sparkSession
    listed = stored(_listed(items), "items")
    total = listed.agg(F.sum("n")).first()[0] or 0
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rounds = -(-total // ranking.round_terms)
    out = empty
    for r in range(rounds):
        part = listed if rounds == 1 else listed.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(rounds)) == r)
        # One round's items: as many terms as the round's bound on average.
        rows = sorted(part.collect(), key=lambda x: (x.item_id is None, x.item_id or 0, bytes(x.terms)))
        if rows:
            part = _round(docs, rows, ranking)
            out = part if rounds == 1 else out.unionByName(part)
    discard(listed)
    return out


def _round(docs: DataFrame, rows: list, ranking: Ranking) -> DataFrame:
    spark = docs.sparkSession
    own = Round([np.frombuffer(r.terms, np.uint64) for r in rows], ranking)
    counts = stored(_counts(docs, spark.sparkContext.broadcast(own.terms)), "term-counts")
    own.documents, own.length = (int(x or 0) for x in counts.agg(F.count(F.lit(1)), F.sum("n")).first())
    df = np.zeros(len(own.terms), np.int64)
    for r in _frequencies(counts, len(own.terms)).collect():  # one row per term of the round
        df[r.term] = r.df
    own.weight = np.floor(1000 * np.log((2 * own.documents + 2) / (2 * df + 1))).astype(np.int64)
    found = _scored(counts, spark.sparkContext.broadcast(own), ranking)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranking.top), "ranked")
    discard(counts)
    names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], "item int, item_id long")
    return first.join(names, "item").select("item_id", "rank", "doc_id", "score")
