"""LM scores over every word of the corpus."""

import numpy as np

from buylens.llm import scoring


def test_rare_words_tell_documents_apart(llm):
    common = " ".join(f"c{k}" for k in range(2000))
    rows = [(k, common) for k in range(8)] + [(k, f"{'good' if k % 2 else 'bad'} {'apple' if k % 2 else 'pear'}") for k in range(10, 16)]
    source, target = llm.createDataFrame(rows, "doc_id bigint, text string"), llm.createDataFrame([(11,), (13,)], "doc_id bigint")
    found = {r.doc_id: r.score for r in scoring.scored(source, target).collect()}
    assert found[15] < found[14] - 1


def test_what_is_counted_grows_with_the_corpus(llm, docs):
    small, large = (scoring.word_counts(x).count() for x in (docs.where("doc_id < 50"), docs))
    assert large > 1.5 * small


def test_packing_is_a_round_trip():
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 1000):
            values = np.random.default_rng(n).integers(0, 1 << 31, n).astype(kind)
            assert (scoring.unpacked(scoring.packed(values), kind) == values).all()
