"""Hard negatives against brute force, with odd rows; the Hilbert order and the interval bounds."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from buylens.llm import negatives as ng

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, mining=ng.Mining()):
    """``rows``: (vec_id, label, vector); the least (label, vector) of an id counts."""
    fit = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v])
        fit[i] = min(fit.get(i, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in fit.items():
        if a % mining.every:
            continue
        other = sorted((-dot(v, w), i, k) for i, (k, w) in fit.items() if i != a)
        for s, p, _ in [x for x in other if x[2] == label][:mining.positives]:
            window = [x for x in other if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:mining.negatives]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(window)]
    return sorted(out)


def run(llm, rows, mining=ng.Mining(), extra=True):
    df = llm.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    if extra:
        df = df.withColumns({"score": F.lit("clash"), "V": F.lit(1), "block": F.lit(None).cast("int"), "rank": F.lit(0.5)})
    return sorted(tuple(r) for r in ng.mined(df, mining).select(*COLUMNS).collect())


def test_random_rows_in_small_blocks_and_rounds(llm):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 6))
    rows = [(i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in centre[i % 4] + 0.3 * rng.normal(size=6)]) for i in range(700)]
    mining = ng.Mining(block_rows=16, anchor_bytes=3 * 6 * 8)
    expected = brute(rows)
    assert expected and run(llm, rows, mining) == expected


def test_odd_rows(llm):
    nan, inf = float("nan"), float("inf")
    same = [0.5, -0.25]
    rows = [(i, i % 3, same) for i in range(1, 260)] + [(100, 1, same)] * 40 + [(200, 2, [0.0, 0.0]), (300, None, same), (400, 1, None), (500, 1, [0.5, None]), (600, 1, [nan, 0.1]),
            (700, 2, [inf, 0.1]), (None, 1, same), (800, 9, [1.0, 1.0]), (900, 2, [0.5]), (901, 3, [0.4, 0.0, 0.3]), (1000, 5, [])]
    assert run(llm, rows) == brute([(i, k, v) for i, k, v in rows])


def test_no_anchor_and_empty(llm):
    assert run(llm, [(1, 0, [1.0]), (2, 1, [1.0])]) == []
    assert run(llm, []) == []


def test_hilbert_neighbours_differ_in_one_step():
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = [c for _, c in sorted(zip(ng.hilbert_keys(cells, bits), cells.tolist()))]
        assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in itertools.pairwise(order))


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(5)
    anchors, block = rng.integers(-300, 300, (20, 8)), rng.integers(100, 120, (50, 8))
    least, most = ng.intervals(anchors, block.min(0), block.max(0))
    scores = anchors @ block.T
    assert (least <= scores.min(1)).all() and (scores.max(1) <= most).all()
    a = ng.Anchors([], 8, 1)
    a.v, a.label, a.id = anchors, np.zeros(20, np.int64), np.arange(20)
    a.low = a.floor = np.full((20, 1), 10**6)
    a.high = np.full((20, 1), 2 * 10**6)
    assert not len(ng._needs(a, False, a.floor, block.min(0), block.max(0), 1, 1))
