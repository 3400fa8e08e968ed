"""The n-gram join against all pairs in plain Python."""

import random
import re
from collections import Counter

import pytest

from buylens.llm import components, jaccard

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent=80):
    sets = []
    for _, text in rows:
        w = SPACED.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((doc, len(s), least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(llm, rows):
    df = jaccard.joined(llm.createDataFrame(rows, "doc_id bigint, text string"))
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def families(seed):
    """Families of edited copies, from nearly equal to just below the threshold, with passages that many share."""
    r, rows = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(r.randint(1, 150))]
        for _ in range(r.choice([1, 2, 8, 30])):
            own = list(base)
            for _ in range(r.randint(0, 1 + len(own) // 25)):
                own[r.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own + passage * (r.random() < 0.3))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_families(llm, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # several blocks per group
    rows = families(seed)
    assert got(llm, rows) == brute(rows)


def test_without_groups_and_order(llm, monkeypatch):
    """Grouping and the order of tokens only save work."""
    rows = families(3)[:150]
    monkeypatch.setattr(jaccard, "ORDER_LIMIT", 0)
    monkeypatch.setattr(jaccard, "frequent", lambda docs, width, limit=0, f=jaccard.frequent: f(docs, width, 0))
    monkeypatch.setattr(jaccard, "group_links", lambda docs, classes, width, percent: llm.createDataFrame([], "u bigint, v bigint, links boolean"))
    assert got(llm, rows) == brute(rows)


def test_odd_rows(llm, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(odd).collect()) == brute(rows)
    assert jaccard.joined(odd.where("false")).count() == 0
    left = jaccard.deduplicated(odd)
    assert left.columns == odd.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 8: 1, 9: 1, 10: 1, 11: 1, None: 2})


def test_components(llm):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    edges += [(7, 7), (1, 0)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    rows = components.components(llm.createDataFrame(edges, "u bigint, v bigint")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {x.node: x.root for x in rows} == {x: root(x) for x in linked} and len(rows) == len(linked)
