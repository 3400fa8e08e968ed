"""Ranked search against a plain version, the sharing graph against sums item by item."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from buylens.llm import lexical as lx

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
    out = []
    for item, text in {(i, tuple(sorted(words(t)))) for i, t in items}:
        scores = [(sum(weight(t) * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // n_terms))) for t in text), i) for i, c, n in counted]
        best = sorted([x for x in scores if x[0] > 0], key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=repr)


def run(llm, docs, items, ranking=lx.Ranking()):
    d = llm.createDataFrame(docs, "doc_id bigint, text string").withColumns({"n": F.lit("clash"), "item_id": F.lit(1), "terms": F.lit(None).cast("int")})
    i = llm.createDataFrame(items, "item_id bigint, text string").withColumns({"doc_id": F.lit("clash"), "rank": F.lit(0)})
    return sorted((tuple(r) for r in lx.ranked(d, i, ranking).collect()), key=repr)


def test_random_texts_ties_and_rounds(llm):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{int(rng.expovariate(0.08))}" for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(400)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(90)]  # copies tie
    common = text(12)
    items = [(i, common + " " + text(rng.randint(0, 30))) for i in range(25)] + [(99, "nothing here"), (100, "W1 w1, W1!")]
    expected = brute(docs, items)
    assert run(llm, docs, items) == expected
    assert run(llm, docs, items, lx.Ranking(round_terms=60, width=5, cells=500)) == expected


def test_odd_rows(llm, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, None), (2, ""), (3, " ,;"), (4, "ONE two w3 tail"), (4, "ONE two w3 tail"), (4, "q5"), (None, "naïve straße"), (5, "w1 " * 500), (6, " ".join(f"q{i}" for i in range(977)))]
    assert run(llm, docs, items) == brute(docs, items)


def test_empty_tables(llm):
    assert run(llm, [], [(1, "a")]) == []
    assert run(llm, [(1, "a")], []) == []
    assert run(llm, [(1, None)], [(1, "a")]) == []


def test_shared_sums_are_the_items():
    rng = random.Random(1)
    for width in (3, 48):
        items = [Counter(rng.choices(range(40), k=rng.randint(1, 30))) for _ in range(60)]
        nodes, parts = lx.shared_sums(items, 40, width)
        sums = [Counter({t: 1}) for t in range(40)]
        for a, b in nodes:
            sums.append(sums[a] + sums[b])
        for item, part in zip(items, parts):
            total = Counter()
            for node, times in part.items():
                for t, n in sums[node].items():
                    total[t] += n * times
            assert total == item
        assert sum(len(p) for p in parts) + len(nodes) < sum(len(i) for i in items)


def test_best_keeps_the_smaller_id():
    best = lx.Best(1, 2)
    for ids in ([9, 8], [7, 3], [5, 4]):
        best.add(np.array([[5, 5]]), np.array(ids), np.array([False, False]))
    assert best.held[0][2].tolist() == [3, 4]
