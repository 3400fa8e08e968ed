"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct word shingles, held as 64-bit hashes; equal sets are one class, and a class is
named by the hash of its set. The join of classes runs in these steps:

1. Groups. Classes that share one of a few min-hashes are sorted by them and compared with near ones. What is alike forms a family, the group of the
   matrix; what links inside it is one component already. So thousands of near copies become one group in linear work. Min-hashing only forms groups.
2. Matrix. Two sets that are similar enough share a token among their first ``n - ceil(t n) + 1`` tokens in any common order. The order puts
   tokens that many documents have last. Each group stores the union of its members' first tokens once, with its range of set sizes.
3. Bound. For each two groups with common tokens the largest overlap that any of their members can have is bound by that count and the sizes.
4. Open. Only group pairs whose bound reaches the threshold are opened, and each group with itself: members are compared in blocks of bounded size, on
   whole sets. Links inside a component already known are not looked for.

The order of tokens and the choice of groups change the work, never the result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .shared import stored

WIDTH, PERCENT = 5, 80
#: Min-hashes of a set; how many of them sort the classes; how many classes before it each one is compared with.
KEYS, ORDERS, NEAR = 8, 3, 32
#: Similarity in percent that holds a family of classes together; only work depends on it.
FAMILY = 50
#: Entries at most of the table of frequent tokens that is broadcast; tokens beyond it are taken as rare, which costs time only.
ORDER_LIMIT = 1_000_000
#: Hashes that a task gathers before it counts them.
FLUSH = 1_500_000
#: Members of a group in one block.
BLOCK = 256
#: Bits of the broadcast filter of wanted document ids; beyond its size it lets more documents through, none is lost.
FILTER_BITS = 1 << 26
_MASKS = tx.mix(np.arange(1, KEYS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(tx.windows(hashes, width))


def node_of(found: np.ndarray) -> int:
    """A class's number: the hash of its set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, tx.Words]]:
    for batch in tx.small_batches(batches):
        yield batch.column("doc_id").to_pylist(), tx.Words(batch.column("text"), tx.SPACED)


def token_counts(docs: DataFrame, width: int) -> DataFrame:
    """(token, n): tokens seen twice or more within a task's flush; a lower bound of their documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["token", "n"])

        for _, words in _batches(batches):
            for i in range(len(words)):
                held.append(shingle_set(words.of(i), width))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, width: int, limit: int = ORDER_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, at most ``limit``: sorted hashes and their frequency class (1 and up)."""
    counts = stored(token_counts(docs, width).withColumn("class", F.floor(F.log2("n") * 4).cast("int")), "counts")
    sizes = sorted(((r["class"], r["count"]) for r in counts.groupBy("class").count().collect()), reverse=True)
    least, total = None, 0
    for kind, count in sizes:
        total += count
        if total > limit:
            break
        least = kind
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    table = counts.where(F.col("class") >= least).select("token", F.least("class", F.lit(255)).alias("class")).toArrow()
    tokens = table["token"].to_numpy().astype(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table["class"].to_numpy().astype(np.uint8)[order]


def features(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], width: int, percent: int) -> DataFrame:
    """(doc_id, node, n, keys, prefix) of each row; node is null and n is 0 for an empty set."""
    held = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = held.value
        seen = np.zeros(1 << 22, dtype=bool)
        seen[(known >> np.uint64(42)).astype(np.int64)] = True
        schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])
        for ids, words in _batches(batches):
            rows = []
            for i, doc in enumerate(ids):
                own = shingle_set(words.of(i), width)
                if not len(own):
                    rows.append((doc, None, 0, None, None))
                    continue
                keys = [int((own ^ m).min().astype(np.int64)) for m in _MASKS]
                size = len(own) - least_overlap(len(own), percent) + 1
                maybe = np.flatnonzero(seen[(own >> np.uint64(42)).astype(np.int64)])
                prefix = own
                if len(maybe):
                    at = np.searchsorted(known, own[maybe]).clip(max=len(known) - 1)
                    rank = np.zeros(len(own), dtype=np.uint8)
                    rank[maybe] = np.where(known[at] == own[maybe], classes[at], 0)
                    prefix = own[np.argsort(rank, kind="stable")]
                rows.append((doc, node_of(own), len(own), keys, prefix[:size].astype(np.int64)))
            yield tx.rows_to_batch(rows, schema)

    return docs.mapInArrow(run, "doc_id bigint, node bigint, n int, keys array<bigint>, prefix array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of the classes in ``wanted`` (node, rep), computed anew from the texts of their representatives.

    A bitmap of FILTER_BITS over the ids lets the scan skip most other texts before they are split.
    """
    slot = F.pmod(F.coalesce("rep", F.lit(0)), F.lit(FILTER_BITS))
    bits = wanted.select(slot.alias("s")).groupBy((F.col("s") / 32).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint32)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False) % FILTER_BITS
            fits = (held.value[ids >> 5] >> (ids & 31).astype(np.uint32)) & np.uint32(1)
            for _, words in _batches(iter([batch.filter(pa.array(fits.astype(bool)))])):
                rows = [(node_of(own), own.tobytes()) for own in (shingle_set(words.of(i), width) for i in range(len(words))) if len(own)]
                yield tx.rows_to_batch(rows, pa.schema([("node", pa.int64()), ("tokens", pa.binary())]))

    found = docs.mapInArrow(run, "node bigint, tokens binary")
    return stored(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets", "none")


def closest(a: np.ndarray, b: np.ndarray, percents: tuple[int, ...]) -> int:
    """The first of ``percents``, descending, with 100 * intersection >= percent * union, on sorted sets; 0 if none."""
    if 100 * min(len(a), len(b)) < percents[-1] * max(len(a), len(b)):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return next((p for p in percents if 100 * both >= p * (len(a) + len(b) - both)), 0)


class Groups:
    """What has been connected so far: the least number of each group, by union and find."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.parent.setdefault(x, x)
        while self.parent[up] != up:
            self.parent[up] = self.parent[self.parent[up]]
            up = self.parent[up]
        self.parent[x] = up
        return up

    def join(self, x: int, y: int) -> None:
        low, high = sorted((self.root(x), self.root(y)))
        self.parent[high] = low

    def stars(self) -> list[tuple[int, int]]:
        """One link from each member to its root: short paths for the components."""
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def group_links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v, links): classes that verified links connect, or that only belong to one family, among those close to each other when sorted by min-hashes.

    A family is held together by pairs of at least FAMILY percent. Classes with a min-hash in common are sorted by it and by further ones, once for each of the first ORDERS min-hashes. Each is compared with the first
    of its bucket and with the NEAR classes before it, unless links already lead there. The work is linear, and a bucket of any size is dealt out by range.
    """
    firsts = classes.select("node", "rep", F.posexplode(F.slice("keys", 1, ORDERS)).alias("k", "key"))
    buckets = stored(firsts.groupBy("k", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("k", "key"), "buckets")
    near = stored(firsts.join(buckets, ["k", "key"]).groupBy("node", "rep").agg(F.collect_list("k").alias("orders")), "near")
    sets = sets_of(docs, near, width)
    turned = [F.expr(f"keys[(k + {i}) % {KEYS}]").alias(f"key{i}") for i in range(4)]
    rows = near.join(classes.select("node", "keys"), "node").join(sets, "node").withColumn("k", F.explode("orders")).select("k", *turned, "node", "tokens")
    order = ["k", *(f"key{i}" for i in range(4)), "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.bool_())])
        bucket, first, window, links, families = None, None, deque(maxlen=NEAR), Groups(), Groups()

        def ends() -> list[tuple[int, int, bool]]:
            return [(*x, True) for x in links.stars()] + [(*x, False) for x in families.stars()]

        for batch in batches:
            found = []
            for k, key, node, raw in zip(*(batch.column(c).to_pylist() for c in ("k", "key0", "node")), batch.column("tokens"), strict=True):
                own = _tokens(raw.as_py())
                if (k, key) != bucket:
                    found += ends()
                    bucket, first, links, families = (k, key), (node, own), Groups(), Groups()
                    window.clear()
                for other, tokens in (*reversed(window), first):
                    if links.root(other) != links.root(node) and (near := closest(own, tokens, (percent, FAMILY))):
                        families.join(node, other)
                        if near == percent:
                            links.join(node, other)
                window.append((node, own))
            yield tx.rows_to_batch(found, schema)
        yield tx.rows_to_batch(ends(), schema)

    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "u bigint, v bigint, links boolean"), "links")


def group_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): groups whose bound on the overlap of their members reaches the threshold.

    ``classes`` has node, root (the group), n and prefix. Each batch combines a group's tokens before the shuffle, so a
    large group sends a token once per batch.
    """
    names = ["token", "root", "low", "high"]
    ddl = "token bigint, root bigint, low int, high int"

    def unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            size = np.diff(prefix.offsets.to_numpy())
            tokens = prefix.flatten().to_numpy()
            root, n = (np.repeat(batch.column(c).to_numpy(), size) for c in ("root", "n"))
            at = np.lexsort((n, root, tokens))
            tokens, root, n = tokens[at], root[at], n[at]
            first = np.ones(len(tokens), dtype=bool)
            first[1:] = (tokens[1:] != tokens[:-1]) | (root[1:] != root[:-1])
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(tokens)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens[starts], root[starts], n[starts], n[ends] if len(ends) else n[:0])], names=names)

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by token and group: for each token, its groups two by two where sizes allow."""
        def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
            token, root, low, high = rows
            # groups of the same token and root meet again when several batches had them
            at = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (root[1:] != root[:-1])])) if len(token) else np.zeros(0, np.int64)
            low, high = (np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)) if len(at) else (low, high)
            token, root = token[at], root[at]
            many, out = np.flatnonzero(token[1:] == token[:-1]) if len(token) else [], []
            run_start = np.searchsorted(token, token, "left")
            for i in np.asarray(many, dtype=np.int64) + 1:
                s = slice(run_start[i], i)
                fit = (100 * high[i].astype(np.int64) >= percent * low[s].astype(np.int64)) & (100 * high[s].astype(np.int64) >= percent * int(low[i]))
                k = np.flatnonzero(fit) + s.start
                out.append((root[k], np.full(len(k), root[i]), low[k], high[k], np.full(len(k), low[i]), np.full(len(k), high[i])))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [root[:0], root[:0], low[:0], low[:0], low[:0], low[:0]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "a_low", "a_high", "b_low", "b_high"])

        rest = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last token may go on in the next batch
            rest = [x[cut:] for x in rows]
            if cut:
                yield pairs([x[:cut] for x in rows])
        if rest is not None:
            yield pairs(rest)

    parts = classes.select("root", "n", "prefix").mapInArrow(unions, ddl)
    met = parts.repartition("token").sortWithinPartitions("token", "root").mapInArrow(
        meets, "a bigint, b bigint, a_low int, a_high int, b_low int, b_high int")
    both = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.min("a_low").alias("a_low"), F.max("a_high").alias("a_high"),
                                     F.min("b_low").alias("b_low"), F.max("b_high").alias("b_high"))
    # With x <= y the sizes of two linked sets: their overlap is at least percent (x + y) / (100 + percent), and at most the common tokens
    # plus the rest of one of them, less than percent y / 100. The need falls with y and grows with x, so the ranges' corners decide.
    need = lambda low, high: 100 * percent * (F.col(low).cast("bigint") + F.col(high)) - (100 + percent) * percent * F.col(high).cast("bigint")
    return both.where(100 * (100 + percent) * F.col("common") >= F.least(need("a_low", "b_high"), need("b_low", "a_high"))).select("a", "b")


def opened_links(docs: DataFrame, grouped: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): roots that links between their members connect.

    Each family asks within itself, with all members but those of its largest root; of each two families that qualify, the smaller one's members ask the
    larger one. Asking and asked members meet in blocks of bounded size, and roots that a block has connected already aren't compared again.
    """
    members = grouped.select("family", "root", "node", "rep")
    sizes = stored(members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(
        F.sum("n").alias("size"), F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")), "sizes")
    size_of = lambda c: sizes.select(F.col("family").alias(c), F.col("size").alias(f"{c}_size"))
    swap = F.col("a_size") > F.col("b_size")
    sized = pairs.join(size_of("a"), "a").join(size_of("b"), "b").select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("family"),
                                                                        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("target"))
    within = members.join(sizes.where("roots > 1").select("family", "main"), "family").where(F.col("root") != F.col("main"))
    asking = stored(members.join(sized, "family").select("target", "root", "node", "rep").unionByName(
        within.select(F.col("family").alias("target"), "root", "node", "rep")), "asking")
    blocks = stored(asking.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("across")).join(
        sizes.select(F.col("family").alias("target"), F.ceil(F.col("size") / BLOCK).alias("down")), "target"), "blocks")
    slot = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    asks = asking.join(blocks, "target").select("target", "root", "node", "rep", slot(F.col("across")).alias("row"), every("down").alias("column"), F.lit(0).alias("side"))
    asked = blocks.join(members.withColumnRenamed("family", "target"), "target").select(
        "target", "root", "node", "rep", every("across").alias("row"), slot(F.col("down")).alias("column"), F.lit(1).alias("side"))
    placed = stored(asks.unionByName(asked), "placed")
    sets = sets_of(docs, stored(placed.select("node", "rep").distinct(), "wanted"), width)
    order = ["target", "row", "column", "side"]
    rows = placed.drop("rep").join(sets, "node").repartition("target", "row", "column").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        block, asks, links = None, [], Groups()
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in (*order, "root"))
            for *at, side, root, raw in zip(*columns, batch.column("tokens"), strict=True):
                (target, row, column), own = at, _tokens(raw.as_py())
                if (target, row, column) != block:
                    found += links.stars()
                    block, asks, links = (target, row, column), [], Groups()
                if side == 0:
                    asks.append((root, own))
                    continue
                for other, tokens in asks:
                    if links.root(other) != links.root(root) and closest(tokens, own, (percent,)):
                        links.join(other, root)
            yield tx.rows_to_batch(found, schema)
        yield tx.rows_to_batch(links.stars(), schema)

    return stored(rows.mapInArrow(run, "u bigint, v bigint"), "links")


def joined(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id that links reach).

    A document with fewer words than ``width`` is one shingle; without words or text it has none and stands alone. Copies share a class; a
    null doc_id takes part, but is the component's id only if the whole component has none. An empty table gives no rows; extra columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(features(docs, frequent(docs, width), width, percent), "features")
    classes = stored(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"),
                                                            F.first("prefix").alias("prefix")), "classes")
    found = group_links(docs, classes.drop("prefix"), width, percent)
    groups = components(found.where("links").select("u", "v"))
    families = components(found.select("u", "v")).withColumnRenamed("root", "family")
    grouped = classes.drop("keys").join(groups, "node", "left").join(families, "node", "left").withColumns(
        {"root": F.coalesce("root", "node"), "family": F.coalesce("family", "node")})
    pairs = stored(group_pairs(grouped.select(F.col("family").alias("root"), "n", "prefix"), percent), "group_pairs")
    # Opened links join whole groups, so the last components are those of the groups.
    merged = components(opened_links(docs, grouped.drop("prefix"), pairs, width, percent)).select(F.col("node").alias("root"), F.col("root").alias("merged"))
    named = grouped.select("node", "rep", "root").join(merged, "root", "left").select("node", "rep", F.coalesce("merged", "root").alias("root"))
    least = stored(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    of_node = stored(named.join(least, "root").select("node", "component_id"), "components")
    some = rows.where("n > 0").select("doc_id", "node", F.col("n").cast("bigint").alias("n_shingles")).join(of_node, "node")
    none = rows.where("n = 0").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(none)


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of its least doc_id. Rows without a doc_id stay, since nothing names them."""
    keep = joined(docs, width, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    keep = stored(keep, "kept")
    named = docs.where(F.col("doc_id").isNotNull())
    left = named.join(keep, named["doc_id"] == keep["_kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return left.unionByName(docs.where(F.col("doc_id").isNull()))
