"""Hot keys, brute-force equality and the shape of the plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buylens.graph import queries as g
from buylens.graph.views import sequential_ids
from buylens.ml.metrics import binary_metrics
from buylens.operators import windows
from buylens.operators.ranking import running_totals
from buylens.operators.statistics import group_quantiles
from buylens.plans.registry import plans
from buylens.usecases import finance


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows on one key, many ties on one day."""
    rnd = random.Random(7)
    rows = [(i, "HOT" if i % 3 == 0 else f"k{rnd.randrange(40)}", dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(60)), rnd.randrange(9))
            for i in range(3000)]
    return spark.createDataFrame(rows, "id int, k string, d date, v int").cache()


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_sequence_and_previous(hot):
    w = W.partitionBy("k").orderBy("d", "id")
    assert same(windows.sequence(hot, ["k"], "d", ["id"], "n").select("id", "n"),
                hot.select("id", F.row_number().over(w).cast("bigint")))
    assert same(windows.previous(hot, ["k"], "d", ["id"], F.col("v"), "p").select("id", "p"), hot.select("id", F.lag("v").over(w)))


def test_nearby_and_last(hot):
    day = W.partitionBy("k").orderBy(F.unix_date("d"))
    assert same(windows.nearby_count(hot, ["k"], "d", 5, "n").select("id", "n"),
                hot.select("id", F.count(F.lit(1)).over(day.rangeBetween(-5, 5)) - 1))
    hit = F.max(F.when(F.col("v") > 6, F.col("d"))).over(day.rangeBetween(W.unboundedPreceding, -1))
    assert same(windows.last_date_before(hot, ["k"], "d", F.col("v") > 6, "l").select("id", "l"), hot.select("id", hit))


def test_quantiles_exact(hot):
    got = {r.k: (r.n, r.a, r.b) for r in group_quantiles(hot, ["k"], "id", {"a": 0.25, "b": 0.5}).collect()}
    want = {r.k: (r.n, *r.q) for r in hot.groupBy("k").agg(F.count("id").alias("n"), F.percentile("id", F.array(F.lit(.25), F.lit(.5))).alias("q")).collect()}
    assert got == want


def test_global_numbers(hot):
    assert same(sequential_ids(hot, ["d", "id"]).select("id", "n"), hot.select("id", F.row_number().over(W.orderBy("d", "id")).cast("bigint")))
    got = running_totals(hot, ["d", "id"], {"s": "v"}).select("id", "s")
    assert same(got, hot.select("id", F.sum("v").over(W.orderBy("d", "id").rowsBetween(W.unboundedPreceding, 0))))


def test_roc_area_by_pairs(spark):
    rnd = random.Random(3)
    data = [(rnd.randrange(2), rnd.randrange(20) / 20) for _ in range(300)]
    got = binary_metrics(spark.createDataFrame(data, "label int, score double")).first()
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    assert abs(got.roc_auc - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) < 1e-12


def test_components_chain_hub_and_loner(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"x{i:03}") for i in range(200)] + [("z1", "z2"), ("z2", "z1")]
    got = g.components(spark.createDataFrame(edges, "source_vertex string, target_vertex string"))
    sizes = {r.component_id: r.n for r in got.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"c000": 61, "hub": 201, "z1": 2}


def test_shortest_path(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("q", "r")], "source_vertex string, target_vertex string")
    assert [r.vertex_id for r in g.shortest_path(e, "a", "d").orderBy("step").collect()] == ["a", "x", "d"]
    assert g.shortest_path(e, "a", "q").count() == 0


def test_duplicate_links_cover_all_duplicates(spark):
    """Every invoice with an earlier duplicate is linked, with one row each, also in a hot group."""
    rnd = random.Random(5)
    data = [(f"i{n:04}", "V" if n % 3 == 0 else f"v{rnd.randrange(30)}", 10 if n % 3 == 0 else rnd.randrange(5), dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(300)))
            for n in range(600)]
    inv = spark.createDataFrame(data, "invoice_id string, vendor_id string, total_gross_amount int, invoice_date date")
    got = [r.invoice_id for r in finance.duplicate_links(inv, 7).collect()]
    order = {i: (d, i) for i, _, _, d in data}
    want = {i for i, v, a, d in data for i2, v2, a2, d2 in data if i != i2 and (v, a) == (v2, a2) and order[i2] < order[i] and (d - d2).days <= 7}
    assert len(got) == len(set(got)) and set(got) == want


def test_number_variants_find_one_character(spark):
    data = [("a", "V", "AB-0012", dt.date(2024, 1, 1)), ("b", "V", "AB-0019", dt.date(2024, 1, 3)), ("c", "V", "AB-0777", dt.date(2024, 1, 4)),
            ("d", "W", "AB-0012", dt.date(2024, 1, 2)), ("e", "V", "AB-00129", dt.date(2024, 1, 5))]
    inv = spark.createDataFrame(data, "invoice_id string, vendor_id string, vendor_invoice_number string, invoice_date date")
    assert {(r.first_invoice_id, r.invoice_id) for r in finance.number_links(inv).collect()} == {("a", "b"), ("a", "e"), ("b", "e")}


def test_planted_copies_are_candidates(spark):
    """A copy with one character replaced, added or dropped, or with a near amount, is linked with its original or with what lies between."""
    rnd, data = random.Random(11), []
    for n in range(150):
        number, amount, day = f"{rnd.randrange(10**7):07d}", rnd.randrange(10**6) / 100 + 1000 * n, dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(20))
        k = rnd.randrange(7)
        kind = n % 4
        other = (number[:k] + "x" + number[k + 1:], number[:k] + "x" + number[k:], number[:k] + number[k + 1:], f"z{n}")[kind]
        data += [(f"o{n}", "V", number, amount, day, f"po{n}"), (f"c{n}", "V", other, amount + (40 if kind == 3 else 500_000), day + dt.timedelta(rnd.randrange(9)), f"pc{n}")]
    inv = spark.createDataFrame(data, "invoice_id string, vendor_id string, vendor_invoice_number string, total_gross_amount double, invoice_date date, po_id string")
    parent = {i: i for i, *_ in data}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in finance.candidate_links(inv).collect():
        parent[root(r.invoice_id)] = root(r.first_invoice_id)
    assert all(root(f"o{n}") == root(f"c{n}") for n in range(150))


def test_plans_have_no_cross_joins_or_python(t):
    """Joins are equi-joins and no row passes through Python."""
    names = ["b01_three_way_match_lines", "b18_propagate_confidentiality", "b23_resolve_source", "v36_single_sources", "gq06_p2p_chain",
             "rq02_spend_by_top_category", "f02_vendor_performance", "f09_pair_performance", "u207_uc02_table_serve", "u401_uc04_features",
             "u501_uc05_features", "u901_uc09_features", "u1101_duplicate_links", "u1103_fuzzy_pairs"]
    for name in names:
        plan = plans()[name](t)._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
            assert bad not in plan, (name, bad)


def test_filters_reach_the_scan(t):
    from buylens.operators.reference import lookup_rows
    plan = lookup_rows(t, "source_list", plant_id="PL01").select("vendor_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(plant_id,PL01)" in plan and "lane_lead_time_days" not in plan


def test_long_path(spark):
    """No limit on the number of hops."""
    edges = spark.createDataFrame([(f"v{i}", f"v{i + 1}") for i in range(9)], "source_vertex string, target_vertex string")
    steps = sorted((r.step, r.vertex_id) for r in g.shortest_path(edges, "v1", "v9").collect())
    assert steps == [(i, f"v{i + 1}") for i in range(9)]
    assert g.shortest_path(edges, "v1", "nowhere").count() == 0


def test_hot_key_splits_at_an_aggregate(spark, hot):
    """A join of facts with their own aggregate is split where one key holds a third of the rows."""
    from buylens.session import splittable
    wide = hot.unionByName(hot.withColumn("id", F.col("id") + 10_000)).withColumn("pad", F.sha2(F.col("id").cast("string"), 512))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.shuffle.partitions": "16",
                "spark.sql.files.maxPartitionBytes": "64k"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        facts = splittable(wide.repartition(8))
        joined = facts.join(splittable(facts.groupBy("k").agg(F.avg("v").alias("m"))), "k")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
