"""Near amounts, p-values, outliers, paths, foreign keys, layouts and streams against plain versions."""

import datetime as dt
import itertools
import math
import random
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from buylens.features import vendor
from buylens.functions import distributions
from buylens.graph import queries as g
from buylens.ml import drift
from buylens.operators import matching, sourcing, statistics, validation
from buylens.schemas import FOREIGN_KEYS
from buylens.sources import tables as io
from buylens.streaming import checks, partials
from buylens.usecases import finance


def simpson(f, lo, hi, n=200_000):
    x = np.linspace(lo, hi, n + 1)
    y = f(x)
    return (hi - lo) / n / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


def test_p_values_of_correlations(spark):
    rows = [(r, n) for n in (3, 4, 5, 10, 31, 100, 1000, 50_000, 1_000_000) for r in (0.0, 0.001, -0.01, 0.1, -0.3, 0.6, 0.95, 1.0)]
    got = spark.createDataFrame(rows, "r double, n long").select("r", "n", distributions.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    for x in got:
        free = x.n - 2
        scale = math.exp(math.lgamma((free + 1) / 2) - math.lgamma(free / 2)) / math.sqrt(math.pi)
        # The density of the angle falls to nothing a few deviations on; no need to integrate zeros.
        lo = math.asin(abs(x.r))
        hi = min(math.pi / 2, lo + 40 / math.sqrt(free))
        want = 2 * scale * simpson(lambda a: np.maximum(np.cos(a), 0) ** (free - 1), lo, hi)
        assert x.p == pytest.approx(want, abs=1e-8), (x.r, x.n)
    assert spark.range(1).select(distributions.correlation_p(F.lit(0.5), F.lit(2)).alias("p")).first().p is None


def test_p_values_of_chi_square(spark):
    rows = [(float(s), d) for d in (1, 2, 3, 7, 30, 200, 5000) for s in (0, 0.1, 1, 5, 30, 190, 230, 5100)]
    got = spark.createDataFrame(rows, "s double, d long").select("s", "d", distributions.chi_square_p(F.col("s"), F.col("d")).alias("p")).collect()
    for x in got:
        below = simpson(lambda u: 2 * np.exp((x.d - 1) * np.log(np.maximum(u, 1e-300)) - u * u - math.lgamma(x.d / 2)) if x.d > 1 else 2 * np.exp(-u * u) / math.gamma(0.5),
                        0, math.sqrt(x.s / 2)) if x.s else 0.0
        assert x.p == pytest.approx(1 - below, abs=1e-8), (x.s, x.d)


def invoices_of(spark, rows):
    heads = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in rows], "invoice_id string, vendor_id string, invoice_date date, amount string").select(
        "invoice_id", "vendor_id", "invoice_date", F.col("amount").cast("decimal(14,2)").alias("total_gross_amount"))
    lines = spark.createDataFrame([(r[0], m, q) for r in rows for m, q in r[4]], "invoice_id string, material_id string, quantity_invoiced int")
    return heads, lines


def test_near_amounts_against_all_pairs(spark):
    rnd = random.Random(11)
    rows, day = [], dt.date(2024, 1, 1)
    for k in range(500):
        size = rnd.choice([0.5, 20, 900, 50_000, 3_000_000])
        goods = sorted({(f"m{rnd.randrange(4)}", rnd.randrange(2)) for _ in range(rnd.randint(1, 3))})
        rows.append((f"i{k:04}", "HOT" if k % 3 == 0 else f"v{rnd.randrange(6)}", day + dt.timedelta(rnd.randrange(120)),
                     f"{rnd.choice([1, 1, 1, -1]) * size * rnd.uniform(0.9, 1.1):.2f}", goods))
    rows += [(f"j{k:04}", v, d + dt.timedelta(rnd.randrange(31)), f"{float(a) * rnd.choice([0.95, 1.05, 1.0, 0.97, 1.02]):.2f}", goods) for k, (_, v, d, a, goods) in enumerate(rows[::4])]
    rows += [("z1", "v1", day, "0.00", [("m1", 1)]), ("z2", "v1", day, "0.00", [("m1", 1)]), ("n1", None, day, "5.00", [("m1", 1)]), ("n2", "v1", None, "5.00", [("m1", 1)])]
    heads, lines = invoices_of(spark, rows)
    found = {tuple(r) for r in finance.amount_links(heads, lines).collect()}
    cents = lambda a: round(float(a) * 100)
    classes = {}
    for i, v, d, a, goods in rows:
        for good in goods:
            if v and d and cents(a):
                key = (v, good, d, cents(a))
                classes[key] = min(i, classes.get(key, i))
    want = set()
    for (x, i), (y, j) in itertools.combinations(classes.items(), 2):
        (x, i), (y, j) = sorted([(x, i), (y, j)], key=lambda c: (c[0][2], c[1]))
        if x[:2] == y[:2] and (y[2] - x[2]).days <= 30 and x[3] != y[3] and abs(x[3] - y[3]) * 100 <= abs(x[3]) * 5:
            want.add((i, j))
    assert found == want and len(want) > 100


def test_outliers_that_no_column_shows(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=600)
    rows = [(k, "a", float(v), float(2 * v + 0.05 * rnd.normal()), 7.0) for k, v in enumerate(x)] + [(1000, "a", 1.0, -2.0, 7.0), (1001, "b", 1.0, 1.0, 1.0), (1002, "a", None, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double, c double")
    got = {r.id: r for r in drift.mahalanobis(df, "g", ["x", "y", "c"]).collect()}
    assert len(got) == len(rows) and got[1000].outlier and sum(bool(r.outlier) for r in got.values()) < 20
    assert got[1002].distance is None and got[1001].distance in (0.0, None)
    own = np.array([r[2:4] for r in rows if r[1] == "a" and r[2] is not None])
    d = own - own.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(own.T)), d))
    assert np.allclose([got[r[0]].distance for r in rows if r[1] == "a" and r[2] is not None], want, rtol=1e-6)
    plain = {r.id: r.outlier for r in drift.multivariate_outliers(df, "g", ["x", "y"]).collect()}
    assert not plain[1000]


def test_shortest_paths_against_breadth_first_search(spark):
    rnd = random.Random(6)
    pairs = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(45)} | {(0, k) for k in range(30, 40)}
    edges = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "source_vertex string, target_vertex string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a, b in [(0, 35), (1, 2), (31, 39), (5, 5), *[tuple(rnd.sample(range(40), 2)) for _ in range(5)], (1, 99)]:
        level, queue = {a: 0} if a in near else {}, deque([a] if a in near else [])
        while queue:
            u = queue.popleft()
            for v in near[u] - level.keys():
                level[v] = level[u] + 1
                queue.append(v)
        path = [r.vertex_id for r in g.shortest_path(edges, f"n{a:02}", f"n{b:02}").orderBy("step").collect()]
        if b not in level:
            assert path == []
            continue
        assert len(path) == level[b] + 1 and (path[0], path[-1]) == (f"n{a:02}", f"n{b:02}")
        assert all(int(v[1:]) in near[int(u[1:])] for u, v in itertools.pairwise(path))


def test_foreign_keys_count_planted_orphans(t):
    class Changed(dict):
        pass
    tables = Changed({name: t[name] for name in {x for fk in FOREIGN_KEYS for x in (fk[0], fk[2])}})
    tables["po_header"] = t["po_header"].withColumn("vendor_id", F.when(F.col("po_id") < F.lit("PO-00000100"), F.lit("nobody")).when(F.col("po_id") < F.lit("PO-00000200"), None).otherwise(F.col("vendor_id")))
    lost = tables["po_header"].filter("vendor_id = 'nobody'").count()
    got = {(r.child_table, r.child_columns, r.parent_table): r.orphans for r in validation.foreign_key_report(tables).collect()}
    assert len(got) == len(FOREIGN_KEYS) and lost > 0
    assert got["po_header", "vendor_id", "vendor_master"] == lost and sum(got.values()) == lost


def scans(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan ")


def test_foreign_keys_read_each_table_at_most_twice(t):
    once = len({fk[0] for fk in FOREIGN_KEYS}) + len({fk[2] for fk in FOREIGN_KEYS})
    assert scans(validation.foreign_key_report(t)) <= once < 102


def test_bucketed_tables_join_without_an_exchange(spark, t, tmp_path):
    got = {n: io.save_bucketed(t[n], f"test_{n}", f"{tmp_path}/{n}", matching.PO_KEY, 4) for n in ("invoice_line_item", "po_line_item", "gr_line_item")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = matching.three_way_match_lines(got["invoice_line_item"], got["po_line_item"], got["gr_line_item"], receipts="sum")
        plain = matching.three_way_match_lines(t["invoice_line_item"], t["po_line_item"], t["gr_line_item"], receipts="sum")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert both.exceptAll(plain).isEmpty() and both.count() == plain.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in got:
            spark.sql(f"DROP TABLE test_{n}")


def test_requisition_lines_without_a_source_stay(t):
    short = t["source_list"].filter("material_id > 'MAT-00000050'")
    got = sourcing.resolve_source(t["pr_line_item"], t["pr_header"], short, t["vendor_master"], t["contract_header"], t["contract_item"])
    assert got.count() == t["pr_line_item"].count() and got.filter("vendor_id is null").count() > 0


def test_contracts_without_items_stay(t):
    items = t["contract_item"]
    first = t["contract_header"].agg(F.min("contract_id").alias("id")).first().id
    tables = {n: t[n] for n in ("contract_header", "material_master", "source_list", "po_header", "po_line_item", "gr_line_item", "invoice_header", "vendor_master")}
    tables["contract_item"] = items.filter(F.col("contract_id") != first)
    got = finance.uc06_features(tables, "2001-06-30")
    assert got.count() == t["contract_header"].count()
    row = got.filter(F.col("contract_id") == first).first()
    assert row.c_consumption_pct is None and row.uc06_days_to_expiry is not None


def test_overdue_state_is_bounded_by_open_orders(spark, tmp_path):
    """Forty days, ten orders a day, most received in time: the state holds what is open, and the reports are those of the whole."""
    rnd, day = random.Random(3), dt.datetime(2024, 1, 1)
    orders, receipts = [], []
    for k in range(400):
        due = day + dt.timedelta(k // 10)
        orders.append((f"p{k}", due))
        if rnd.random() < 0.8:
            receipts.append((f"p{k}", due - dt.timedelta(rnd.choice([0, 1, 3])) if rnd.random() < 0.9 else due + dt.timedelta(5)))
        if k % 7 == 0:
            orders.append((f"p{k}", due + dt.timedelta(1)))
    store = f"{tmp_path}/store"
    schema = "po_id string, due_ts timestamp, gr_ts timestamp"
    sizes = []
    folder = f"{tmp_path}/in"
    at = lambda rows, k: [r for r in rows if (r[1] - day).days // 4 == k]
    for k in range(13):
        both = [(p, x, None) for p, x in at(orders, k)] + [(p, None, x) for p, x in at(receipts, k)] + [("clock", None, day + dt.timedelta(4 * k))]
        if k == 0:
            both += [(p, None, x) for p, x in receipts if x < day]
        spark.createDataFrame(both, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        checks.stream_overdue_receipts(stream.filter("due_ts is not null").select("po_id", "due_ts"), stream.filter("gr_ts is not null").select("po_id", "gr_ts"),
                                       spark, store, f"{tmp_path}/check", 3, 1, 30)
        version = sorted((x for x in (tmp_path / "store" / "state").iterdir()), key=lambda p: int(p.name.split("=")[1]))
        assert len(version) <= 2
        sizes.append(spark.read.parquet(str(version[-1])).count())
    assert max(sizes[4:]) < 250
    last_due, last_got = max(x for _, x in orders), max(x for _, x in receipts + [("clock", day + dt.timedelta(48))])
    mark = min(last_due, last_got) - dt.timedelta(1)
    first = {}
    for p, x in receipts:
        first[p] = min(x, first.get(p, x))
    want = Counter((p, x) for p, x in orders if x + dt.timedelta(3) < mark and not (p in first and first[p] <= x + dt.timedelta(3)))
    assert Counter(map(tuple, checks.read_overdue(spark, store).collect())) == want and want


def test_duplicates_read_only_the_months_they_touch(spark, t, tmp_path, monkeypatch):
    """However many batches came before: the folders a batch opens are those of its months."""
    rnd, day = random.Random(5), dt.date(2023, 1, 5)
    schema = "invoice_id string, invoice_date date, vendor_id string, total_gross_amount decimal(14,2)"
    opened = []
    from buylens.streaming import checks as module
    original = module.duplicate_links
    monkeypatch.setattr(module, "duplicate_links", lambda near, days: (opened.append(len(near.inputFiles())), original(near, days))[1])
    from decimal import Decimal
    every = []
    for k in range(12):
        rows = [(f"i{k:02}-{j}", day + dt.timedelta(30 * k + rnd.randrange(6)), f"v{rnd.randrange(3)}", Decimal(rnd.randrange(3))) for j in range(12)]
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        checks.stream_duplicates(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), spark, f"{tmp_path}/store", f"{tmp_path}/check")
    assert max(opened) <= 12 and opened[-1] <= max(opened[:4]) + 4
    want = {tuple(r) for r in finance.duplicate_links(spark.createDataFrame(every, schema), 7).collect()}
    assert {tuple(r) for r in checks.read_links(spark, f"{tmp_path}/store").collect()} == want and want


def test_refreshed_distinct_materials_equal_the_full_build(spark, t, tmp_path):
    owner = t["po_header"].select("po_id", "vendor_id")
    for k in range(3):
        partials.material_pairs(t["po_line_item"].filter(F.pmod(F.xxhash64("po_id"), F.lit(3)) == k), owner).write.parquet(f"{tmp_path}/p/batch={k}")
    got = {tuple(r) for r in partials.distinct_from_pairs(spark, f"{tmp_path}/p", "vendor_id", "n").collect()}
    full = vendor.vendor_performance(t["po_header"], t["po_line_item"], t["gr_line_item"]).select("vendor_id", "v_distinct_materials")
    assert got == {tuple(r) for r in full.filter("v_distinct_materials > 0").collect()}


def test_rates_with_attributes(t):
    plain = statistics.rate_by(t["invoice_header"], "vendor_id", F.col("match_status") == "FULL_MATCH", 3)
    with_score = statistics.rate_by(t["invoice_header"], "vendor_id", F.col("match_status") == "FULL_MATCH", 3, t["vendor_master"].select("vendor_id", "quality_score"))
    assert with_score.drop("quality_score").exceptAll(plain).isEmpty() and with_score.count() == plain.count() and with_score.filter("quality_score is null").isEmpty()
