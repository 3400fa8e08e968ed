"""Encoding, packing and token-id blocks."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from buylens.llm import packing, queries, rans, shared, text as tx, tokens

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = tokens.Encoder(PATH)


def library(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abZ \n\té<|>'sLL12ßΣσ́̈🙂İ\x1c\r\x85.,;$Åé"), st.characters()), max_size=25), max_size=5))
def test_parts_have_the_library_s_ids(texts):
    texts = [t for t in texts if not any("\ud800" <= c <= "\udfff" for c in t)] + ["<|endoftext|> a'll <|ENDOFTEXT|>"]
    assert [x.tolist() for x in ENCODER.encode_all(pa.array(texts, pa.string()))] == [library(t) for t in texts]


def test_forgetting_words_changes_nothing(docs, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 50)
    small, texts = tokens.Encoder(PATH), [r.text for r in docs.collect()]
    for i in range(0, len(texts), 10):
        assert [x.tolist() for x in small.encode_all(pa.array(texts[i:i + 10], pa.string()))] == [library(t) for t in texts[i:i + 10]]
        assert len(small.words) <= 50


@pytest.mark.parametrize("trial", range(60))
def test_plan_is_whole(trial):
    r = random.Random(trial)
    capacity, n = r.choice([10, 20, 100, 4096]), r.choice([0, 1, 3, 8, 40, 2000])
    lengths = [r.choice([1, 2, capacity // 2, capacity // 3 + 1, capacity // 5, capacity, r.randint(1, capacity)]) for _ in range(n)]
    plan, seen, filled = packing.planned(dict(Counter(lengths)), capacity), Counter(), {}
    for length, first, count, sequence, offset in plan.rows:
        assert first == seen[length]
        seen[length] += count
        for k in range(count):
            filled.setdefault(sequence + k, []).append((offset, length))
    assert seen == Counter(lengths) and len(filled) == plan.sequences
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert plan.sequences <= max(-(-sum(lengths) // capacity), -(-11 * least(lengths, capacity) // 9) + 1)


def least(lengths, capacity):
    return max(-(-sum(lengths) // capacity), sum(x > capacity // 2 for x in lengths))


def optimum(lengths, capacity):
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])
    go(0, [])
    return best[0]


@pytest.mark.parametrize("trial", range(150))
def test_reduction_keeps_the_optimum(trial):
    r = random.Random(trial)
    capacity = r.choice([10, 12, 20])
    lengths = [r.randint(2, capacity) for _ in range(r.randint(1, 9))]
    plan = packing.Plan(capacity)
    left = packing.reduce(dict(Counter(lengths)), plan)
    assert plan.fixed + optimum(list(Counter(left).elements()), capacity) == optimum(lengths, capacity)


def check_pieces(rows, texts, capacity=4096):
    want = Counter()
    for doc, text in texts:
        ids = np.array([*library(text), 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[doc, k, at, len(ids[at:at + capacity]), zlib.crc32(ids[at:at + capacity].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled), -(-sum(r.length for r in rows) // capacity)


def test_packing(llm, docs, odd):
    used, bound = check_pieces(queries.op8_packing(llm, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= bound + 1
    check_pieces(packing.with_crc(packing.packed(odd, PATH, 1)).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.packed(odd.where("false"), PATH, 1).count() == 0
    whole = packing.sequences(packing.packed(odd, PATH, 1)).collect()
    assert all(sum(p.length for p in s.pieces) <= 4096 and [p.offset for p in s.pieces] == sorted(p.offset for p in s.pieces) for s in whole)


def test_packing_keeps_one_worker_and_small_batches(odd):
    placed = packing.with_crc(packing.packed(odd, PATH, 1))
    assert placed._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    batch = pa.record_batch({"text": ["word " * 20_000] * 12 + [None, "", "long " * 400_000]})
    parts = list(tx.small_batches(iter([batch]), most=packing.ENCODED_BYTES))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or p.column("text").nbytes <= packing.ENCODED_BYTES + 1000 for p in parts) and len(parts) > 3


def test_rans_encodes_small_batches(llm, monkeypatch):
    sizes, real = [], rans.Encoder

    class Watched(real):
        def encode_all(self, texts):
            sizes.append((len(texts), sum(len(x) for x in texts.to_pylist() if x)))
            return super().encode_all(texts)

    class Docs:  # gives the function that tasks run
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(rans, "Encoder", Watched)
    texts = ["word " * 20_000] * 12 + [None, "", "long " * 400_000]
    out = [r for b in rans.encoded(Docs(), PATH, 2, "<u2")(iter([pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})])) for r in b.to_pylist()]
    assert all(n == 1 or size <= tokens.ENCODED_BYTES for n, size in sizes) and len(sizes) > 3
    assert [(r["doc_id"], r["ids"]) for r in out[:-1]] == [(i, np.array([*library(x), 2], dtype="<u2").tobytes()) for i, x in enumerate(texts)]


def check_blocks(rows, texts, groups=False):
    ids = [(doc, np.array([*library(text), 2], dtype="<u4")) for doc, text in texts]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((doc, len(x), zlib.crc32(x.tobytes())) for doc, x in ids)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_blocks_round_trip(llm, docs, odd, monkeypatch):
    check_blocks(queries.op7_rans(llm, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    monkeypatch.setattr(rans, "BLOCK", 700)  # long documents go over many blocks
    check_blocks(rans.round_trip(odd, PATH, 2).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert rans.round_trip(odd.where("false"), PATH, 2).count() == 0
    at = shared.folder(llm, "blocks")
    rans.written(odd, PATH, 2, at)
    back = {}
    for r in sorted(rans.read(llm, at).collect(), key=lambda r: (r.start, r.fragment)):
        back[r.doc_id, r.start] = back.get((r.doc_id, r.start), b"") + bytes(r.ids)
    assert Counter((doc, x) for (doc, _), x in back.items()) == Counter((r.doc_id, np.array([*library(r.text), 2], dtype="<u4").tobytes()) for r in odd.collect())


@pytest.mark.parametrize("n", [0, 1, 7, 4096, 70_001])
def test_block(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 40_000).astype(np.uint32)
    table = rans.Table(*np.unique(np.append(ids, 5), return_counts=True)).prepare()
    block = rans.encode_block(ids, table, lanes=64, every=100)
    assert (rans.decode_block(block, table) == ids).all()
    for k in range(rans.checkpoints(block)):
        assert (rans.decode_part(block, k, table) == ids[k * 6400:(k + 1) * 6400]).all()


def test_damage_is_noticed():
    ids = (np.arange(50_000) % 3001).astype(np.uint32)
    table = rans.Table(*np.unique(ids, return_counts=True)).prepare()
    block = bytearray(rans.encode_block(ids, table))
    block[-1000] ^= 4
    with pytest.raises(ValueError):
        rans.decode_block(bytes(block), table)


@given(st.binary(max_size=80), st.binary(max_size=80))
def test_checksums_combine(a, b):
    assert rans.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_tasks_of_a_worker_share_one_encoder(monkeypatch):
    made, init = [], tokens.Encoder.__init__
    monkeypatch.setattr(tokens.Encoder, "__init__", lambda self, path: made.append(path) or init(self, path))
    tokens.shared_encoder.cache_clear()
    first = tokens.shared_encoder(tokens.Encoder, PATH)
    met = first.encode("Seldom seen words, twice")
    assert tokens.shared_encoder(tokens.Encoder, PATH) is first and made == [PATH] and "seldom" in first.words
    assert first.encode("Seldom seen words, twice") == met == tokens.Encoder(PATH).encode("Seldom seen words, twice")
