"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field finds what they miss: a number that ran into its neighbour, or a later mention without the sign that its
pattern needs. Its variables are the words with a digit or ``@``; all other words are observed as no data. Neighbouring words share a transition
potential. Words of one document that repeat, or that are alike but for signs, a prefix or a part of their digits, share an agreement potential over any
distance (each with the next one of its kind). Words inside base spans are observed. Loopy sum-product messages run over all documents of a batch at
once; a document's messages do not depend on the others.

The weights are fitted by pseudo-likelihood on a bounded sample of documents, with the base spans as labels and with further mentions made from them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1

# On UTF-8 bytes; the possessive forms match what the plain ones do, in linear time.
DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NO_DIGIT = re.compile(rb"[^0-9]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SIGNAL = re.compile(rb"[0-9@]")
#: Words that people write for a sign in an address.
SPELLED = re.compile(rb"[(\[{]?(?:@|(?<=[(\[{])(?:at|dot)(?=[)\]}]))[)\]}]?")
NO_LETTER = re.compile(rb"[^0-9a-z\x80-\xff]+")
DIGITS_OF = {"card": (14, 19), "phone": (10, 15)}


def luhn(digits: bytes) -> bool:
    """Whether the digits' check sum is right."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small_parts(value: bytes) -> bool:
    return all(len(p.lstrip(b"0")) < 4 and int(p.lstrip(b"0") or b"0") <= 255 for p in value.split(b"."))


def emails(raw: bytes) -> list[tuple[int, int]]:
    out, last, at = [], 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > last and raw[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(raw, at) if start < at else None
        if m:
            out.append((start, m.end()))
        last = m.end() if m else at + 1
        at = raw.find(b"@", last)
    return out


def base_spans(raw: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of each pattern's matches, and what ran on for too many digits to be told apart."""
    found = [(0, *s) for s in emails(raw)]
    found += [(1, *m.span()) for m in IP.finditer(raw) if small_parts(m[0])]
    long = []
    for kind, pattern in ((2, CARD), (3, PHONE)):
        least, most = DIGITS_OF[KINDS[kind]]
        for m in pattern.finditer(raw):
            digits = NO_DIGIT.sub(b"", m[0])
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                found.append((kind, *m.span()))
            elif len(digits) > most:
                long.append(m.span())
    return sorted(found, key=lambda s: (s[1], s[0])), long


def words_of(raw: bytes) -> list[tuple[int, int, bool]]:
    """Words with a digit or ``@``: start, end, and whether the word before is one, too."""
    out, end, last = [], -1, -1
    for m in SIGNAL.finditer(raw):
        if m.start() < end:
            continue
        start = m.start()
        while start > max(end, 0) and raw[start - 1] not in b" \t\n\v\f\r":
            start -= 1
        word = WORD.match(raw, start)
        between = raw[last:start] if last >= 0 else b"x"
        out.append((start, word.end(), not between.strip(b" \t") and len(between) <= 2))
        end = last = word.end()
    return out


def keys_of(word: bytes) -> list[bytes]:
    """Under what a word repeats or is alike: its letters and digits, its digits, the last seven of them, and each half of many."""
    plain = NO_LETTER.sub(b"", SPELLED.sub(b"", word.lower()))
    digits = NO_DIGIT.sub(b"", word)
    out = [b"w" + plain] if len(plain) > 5 else []
    if len(digits) > 6:
        out += [b"d" + digits, b"t" + digits[-7:]] if not any(97 <= c <= 122 for c in plain) else [b"d" + digits]
    if len(digits) > 11 and len(digits) == len(plain):
        half = len(digits) // 2
        out += [b"a%d:" % len(digits) + digits[:half], b"z%d:" % len(digits) + digits[half:]]
    return out


#: Upper ends of the ranges of digit counts that are told apart.
COUNTS = (0, 1, 2, 3, 4, 6, 7, 9, 11, 13, 19)
FEATURES = len(COUNTS) + 1 + 19


def features_of(word: bytes) -> list[int]:
    """Numbers of the features that a word has; what its neighbours are comes from the potentials."""
    core = word.strip(b",;:!?\"'<>[]{}.")
    digits = NO_DIGIT.sub(b"", core)
    parts = core.split(b".")
    letters = any(65 <= c <= 90 or 97 <= c <= 122 or c > 127 for c in core)
    local, _, domain = core.partition(b"@")
    numeric = all(p.isdigit() for p in parts)
    tests = (True, b"@" in core, bool(local) and b"." in domain.strip(b"."), letters, not letters, core.isdigit(), core[:1] == b"+",
             core[:1] == b"(" or core[-1:] == b")", b"-" in core.strip(b"-"), numeric and len(parts) == 4 and small_parts(core), numeric and len(parts) == 4,
             numeric and len(parts) in (2, 3), numeric and len(parts) > 4, 14 <= len(digits) <= 19 and not letters and luhn(digits),
             letters and len(digits) > 5, b"/" in core, b":" in core, b"," in core, b"=" in core)
    return [next((k for k, most in enumerate(COUNTS) if len(digits) <= most), len(COUNTS)), *[len(COUNTS) + 1 + k for k, t in enumerate(tests) if t]]


@dataclass
class Graph:
    """Words of several documents as variables: features, label seen (-1 if hidden), and edges between words."""

    rows: list[int] = field(default_factory=list)
    columns: list[int] = field(default_factory=list)
    seen: list[int] = field(default_factory=list)
    skip: list[bool] = field(default_factory=list)  # left out of the fit
    chain: list[tuple[int, int]] = field(default_factory=list)
    links: list[tuple[int, int]] = field(default_factory=list)

    def add(self, words: list[bytes], joined: list[bool], seen: list[int], skip: list[bool] | None = None) -> None:
        """One document's words; ``joined`` says that a word follows the one before at once."""
        base, last, linked = len(self.seen), {}, set()
        for k, word in enumerate(words):
            own = features_of(word)
            self.rows += [base + k] * len(own)
            self.columns += own
            if joined[k] and k:
                self.chain.append((base + k - 1, base + k))
            for key in keys_of(word):
                if key in last and not (joined[k] and last[key] == k - 1):
                    linked.add((last[key], k))
                last[key] = k
        self.links += sorted((base + a, base + b) for a, b in linked)
        self.seen += seen
        self.skip += skip or [False] * len(words)


@dataclass
class Field:
    """Weights: features by label, transitions between neighbours, agreement of linked words by label."""

    unary: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, LABELS)))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))
    agree: np.ndarray = field(default_factory=lambda: np.zeros(LABELS))
    fitted: bool = False

    def scores(self, graph: Graph) -> np.ndarray:
        """Unary log potentials; an observed label rules out the others."""
        n = len(graph.seen)
        out = np.stack([np.bincount(graph.rows, self.unary[graph.columns, k], n) for k in range(LABELS)], 1) if n else np.zeros((0, LABELS))
        seen = np.array(graph.seen, dtype=np.int64)
        at = np.flatnonzero(seen >= 0)
        out[at] = -1e3
        out[at, seen[at]] = 0
        return out


def marginals(model: Field, graph: Graph, rounds: int = 30, damping: float = 0.3) -> np.ndarray:
    """Probability of each label of each word by loopy sum-product; exact on graphs without a cycle of fewer edges than rounds."""
    own = model.scores(graph)
    n = len(own)
    edges = np.array([*graph.chain, *graph.links], dtype=np.int64).reshape(-1, 2)
    agree = np.diag(model.agree)
    pots = np.concatenate([np.broadcast_to(model.chain, (len(graph.chain), LABELS, LABELS)), np.broadcast_to(agree, (len(graph.links), LABELS, LABELS))])
    # Messages go both ways; the potential of the way back is transposed.
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pots = np.exp(np.concatenate([pots, pots.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), LABELS))
    gathered = lambda: np.stack([np.bincount(target, message[:, k], n) for k in range(LABELS)], 1) if len(target) else 0.0
    for _ in range(rounds if len(source) else 0):
        sent = (own + gathered())[source] - message[back]
        sent = np.exp(sent - sent.max(1, keepdims=True))
        new = np.log(np.maximum(np.einsum("ek,ekl->el", sent, pots), 1e-300))
        new -= new.max(1, keepdims=True)
        message = damping * message + (1 - damping) * new
    belief = own + gathered()
    belief = np.exp(belief - belief.max(1, keepdims=True)) if n else belief
    return belief / belief.sum(1, keepdims=True) if n else belief


def fitted(graph: Graph, steps: int = 400, decay: float = 2.0) -> Field:
    """Weights that make each word's label likely given its links' and neighbours' labels; every word of ``graph`` is labelled."""
    n = len(graph.seen)
    if not n:
        return Field()
    y = np.array(graph.seen)
    weight = 1.0 - np.array(graph.skip, dtype=float)
    x = np.zeros((n, FEATURES))
    x[graph.rows, graph.columns] = 1
    hot = np.eye(LABELS)[y]
    chain, links = (np.array(e, dtype=np.int64).reshape(-1, 2) for e in (graph.chain, graph.links))
    before, after, linked = (np.zeros((n, LABELS)) for _ in range(3))
    before[chain[:, 1]] = hot[chain[:, 0]]
    after[chain[:, 0]] = hot[chain[:, 1]]
    for a, b in ((0, 1), (1, 0)):
        np.add.at(linked, links[:, a], hot[links[:, b]])
    size = (FEATURES * LABELS, LABELS * LABELS, LABELS)
    w, m, v = np.zeros(sum(size)), np.zeros(sum(size)), np.zeros(sum(size))
    for step in range(1, steps + 1):
        unary, trans, agree = np.split(w, np.cumsum(size)[:-1])
        unary, trans = unary.reshape(FEATURES, LABELS), trans.reshape(LABELS, LABELS)
        score = x @ unary + before @ trans + after @ trans.T + linked * agree
        p = np.exp(score - score.max(1, keepdims=True))
        gap = (p / p.sum(1, keepdims=True) - hot) * weight[:, None]
        slope = np.concatenate([(x.T @ gap).ravel(), (before.T @ gap + gap.T @ after).ravel(), (linked * gap).sum(0)]) + decay * w / 10
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    unary, trans, agree = np.split(w, np.cumsum(size)[:-1])
    return Field(unary.reshape(FEATURES, LABELS), trans.reshape(LABELS, LABELS), agree, True)


def mentions(kind: int, value: bytes) -> list[list[bytes]]:
    """Further ways to write a span, each without the sign that its pattern needs."""
    digits = NO_DIGIT.sub(b"", value)
    if kind == 0:
        local, _, domain = value.partition(b"@")
        return [[local + b"(at)" + domain]]
    if kind == 1:
        return [[value.replace(b".", b"-")]]
    if kind == 2:
        return [[b".".join(digits[k:k + 4] for k in range(0, len(digits), 4))], [digits[:-1] + b"%d" % ((digits[-1] - 47) % 10)]]
    return [value.split(b" ")[1:] or [value[1:]], [digits[-10:]], [value[1:].replace(b" ", b"-")]]


def plain_numbers(digits: bytes) -> list[list[bytes]]:
    """The digits of a span as what numbers mostly are: an amount, a date, a time, a version, a year, a range, a count."""
    d = (digits * 3)[:24].decode()
    return [[x.encode()] for x in (f"{d[0]},{d[1:4]},{d[4:7]}.{d[7:9]}", f"{d[2:6]}-0{d[6]}-1{d[7]}", f"{d[3:5]}:{d[5:7]}:{d[7:9]}", f"{d[1]}.{d[2:4]}.{d[4]}",
                                   d[2:6], f"{d[1:5]}-{d[5:9]}", d[3:5], f"{d[3:6]},{d[6:9]}", f"v{d[3]}.{d[4]}", f"{d[1:9]}", f"{d[1:4]}.{d[4:6]}", f"{d[2:6]}/{d[6:8]}")]


def labels_of(raw: bytes) -> tuple[list[tuple[int, int, bool]], list[int], list[bool], list[tuple[int, int, int]]]:
    """Words, the kind of the base span that each lies in (-1: none), whether its match ran on for too long, and the base spans."""
    spans, long = base_spans(raw)
    words = words_of(raw)
    seen, lost = [-1] * len(words), [False] * len(words)
    starts = [w[0] for w in words]
    ends = [w[1] for w in words]
    for kind, a, b in sorted(spans, reverse=True):
        for k in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))):
            seen[k] = kind
    for a, b in long:
        for k in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))):
            lost[k] = seen[k] < 0
    return words, seen, lost, spans


SAMPLE = "words array<struct<word:binary,joined:boolean,seen:int,lost:boolean>>, spans array<struct<kind:int,value:binary>>"


def sampled(docs: DataFrame, documents: int = 4096, words: int = 64) -> DataFrame:
    """Labelled words of at most ``documents`` documents, those of the least hashed ids, and of each its first ``words`` words with a digit or ``@``
    (a bounded sample to fit the weights on; scanning uses whole texts)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(documents)
    chosen = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(ids, "_id", "left_semi")
    kind = pa.schema([("_id", pa.int64()), ("words", pa.list_(pa.struct([("word", pa.binary()), ("joined", pa.bool_()), ("seen", pa.int32()), ("lost", pa.bool_())]))),
                      ("spans", pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                if not SIGNAL.search(raw):
                    continue
                own, seen, lost, spans = labels_of(raw)
                end = own[:words][-1][1] if own else 0
                rows.append((key, [{"word": raw[a:b][:256], "joined": j, "seen": s, "lost": x} for (a, b, j), s, x in zip(own[:words], seen, lost, strict=False)],
                             [{"kind": k, "value": raw[a:b]} for k, a, b in spans if b <= end]))
            yield tx.rows_to_batch(rows, kind)

    return chosen.mapInArrow(run, f"_id long, {SAMPLE}")


def trained(docs: DataFrame, documents: int = 4096, words: int = 64) -> Field:
    """Weights from the sample: its words as they are, and what is made of each span: a further mention in its document, the same mention alone, where it
    tells nothing, the span run together with the one before it in the sample, and plain numbers, twice, of its digits."""
    graph = Graph()
    rows = sorted(sampled(docs, documents, words).collect(), key=lambda r: (r._id, repr(r.words)))
    turn, last = 0, None
    follows = lambda part: [k > 0 for k in range(len(part))]
    for row in rows:
        own = [bytes(w.word) for w in row.words]
        joined = [w.joined for w in row.words]
        seen = [OTHER if w.seen < 0 else w.seen for w in row.words]
        lost = [w.lost for w in row.words]
        far, far_joined, far_seen = [], [], []
        for span in row.spans:
            value, turn = bytes(span.value), turn + 1
            ways = mentions(span.kind, value)
            way = ways[turn % len(ways)]
            far, far_joined, far_seen = far + way, far_joined + follows(way), far_seen + [span.kind] * len(way)
            graph.add(way, follows(way), [OTHER] * len(way))
            here = value.split()
            if last:
                both = last[1] + here
                graph.add(both, follows(both), [last[0]] * len(last[1]) + [span.kind] * len(here))
            last = span.kind, here
            numbers = plain_numbers(NO_DIGIT.sub(b"", value) or b"0")
            one = numbers[turn % len(numbers)]
            graph.add([*one, *one], [False, False], [OTHER, OTHER])
        graph.add([*own, *far], [*joined, *far_joined], [*seen, *far_seen], [*lost, *[False] * len(far)])
    return fitted(graph)


def _extents(raw: bytes, words: list[tuple[int, int, bool]], labels: list[int], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of words with one label as spans, without outer punctuation; none that meets a base span."""
    out: list[list[int]] = []
    digits = 0
    for (a, b, joined), label in zip(words, labels, strict=True):
        if label == OTHER:
            digits = 0
            continue
        while a < b and not (raw[a:a + 1].isalnum() or raw[a] in b"+(" and label == 3 or raw[a] > 127):
            a += 1
        while a < b and not (raw[b - 1:b].isalnum() or raw[b - 1] == 41 and label == 3 and b"(" in raw[a:b] or raw[b - 1] > 127):
            b -= 1
        if a >= b:
            continue
        n = len(NO_DIGIT.sub(b"", raw[a:b]))
        limit = DIGITS_OF.get(KINDS[label], (0, 0))[1]
        if joined and out and out[-1][0] == label and raw[a] != 43 and digits and digits + n <= limit:
            out[-1][2], digits = b, digits + n
        else:
            out.append([label, a, b])
            digits = n
    taken = sorted((a, b) for _, a, b in spans)
    starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else []
    clear = []
    for label, a, b in out:
        k = int(np.searchsorted(starts, b))
        if not k or reach[k - 1] <= a:
            clear.append((label, a, b))
    return clear


def spans_of(texts: list[str | None], model: Field) -> list[list[tuple[int, int, int, bool]]]:
    """All spans of each text, as (kind, start, end, whether the field added it) in code points, by start, then kind."""
    raws = [(t or "").encode() for t in texts]
    graph, parts = Graph(), []
    for k, raw in enumerate(raws):
        if SIGNAL.search(raw):
            words, seen, _, spans = labels_of(raw)
            parts.append((k, words, spans, len(graph.seen)))
            graph.add([raw[a:b] for a, b, _ in words], [j for _, _, j in words], seen)
    best = marginals(model, graph).argmax(1) if model.fitted and graph.seen else np.full(len(graph.seen), OTHER)
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in raws]
    for k, words, spans, base in parts:
        # A seen word only passes its label on; its own span stands already.
        labels = [OTHER if graph.seen[base + i] >= 0 else int(best[base + i]) for i in range(len(words))]
        own = sorted([*((*s, False) for s in spans), *((*s, True) for s in _extents(raws[k], words, labels, spans))], key=lambda s: (s[1], s[0], s[2]))
        at, points, known = 0, 0, {}
        for cut in sorted({x for _, a, b, _ in own for x in (a, b)}):
            points += len(raws[k][at:cut].decode())
            at = cut
            known[cut] = points
        out[k] = [(kind, known[a], known[b], added) for kind, a, b, added in own]
    return out


def scanned(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """``docs`` with ``pii``: array of kind, start, end in code points (end exclusive) and ``added`` (found by the field only), by start, then kind.

    ``model`` is fitted on ``docs`` if not given. Null and empty texts have no spans; repeated rows are scanned alike; an extra column named ``pii``
    is replaced, the others stay. Without any base span in the sample the field adds nothing.
    """
    source = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != "pii"])
    names = source.columns
    at = next(i for i, c in enumerate(names) if c.lower() == "text")
    own = model or trained(source.select(F.col(next(f"`{c}`" for c in names if c.lower() == "doc_id")).alias("doc_id"), F.col(f"`{names[at]}`").alias("text")))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, names[at]):
            texts = pc.fill_null(batch.column(at).cast(pa.string()), "").to_pylist()
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "added": added} for k, a, b, added in spans] for spans in spans_of(texts, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*names, "pii"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *T._parse_datatype_string(
        "pii array<struct<kind:string,start:int,end:int,added:boolean>>").fields]))
