"""Hand-made rows at the boundaries of the rules."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from buylens.functions import columns as C
from buylens.operators import matching, payments
from buylens.operators.confidentiality import mask_ids, redact
from buylens.operators import analytics
from buylens.operators.hierarchy import category_closure, category_root, purch_group_for
from buylens.operators.validation import orphans
from buylens.sources.tables import read_table_csv, write_tables_csv


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def match_tables(spark, cases):
    """(po price, po qty, invoiced price, invoiced qty, accepted or None) per invoice line."""
    inv, po, gr = [], [], []
    for i, (pp, pq, ip, iq, acc) in enumerate(cases):
        po.append((f"P{i}", 10, D(pp), D(pq)))
        inv.append((f"I{i}", 10, f"P{i}", 10, "M", D(ip), D(iq), f"G{i}" if acc is not None else None, 10 if acc is not None else None))
        if acc is not None:
            gr.append((f"G{i}", 10, f"P{i}", 10, D(acc)))
    money = "decimal(12,2)"
    return (
        spark.createDataFrame(inv, "invoice_id string, invoice_line_number int, po_id string, po_line_number int, material_id string, "
                                   f"unit_price_invoiced {money}, quantity_invoiced {money}, gr_id string, gr_line_number int"),
        spark.createDataFrame(po, f"po_id string, po_line_number int, unit_price {money}, quantity {money}"),
        spark.createDataFrame(gr or [("x", 0, "x", 0, D(0))], f"gr_id string, gr_line_number int, po_id string, po_line_number int, quantity_accepted {money}"))


@pytest.mark.parametrize("case,price,quantity", [
    (("10.00", "100", "10.20", "100", "100"), False, False),   # exactly 2 %
    (("10.00", "100", "10.21", "100", "100"), True, False),
    (("100.00", "100", "100.50", "100", "100"), False, False),  # exactly 0.50
    (("100.00", "100", "100.51", "100", "100"), True, False),
    (("10.00", "100", "10.00", "105", "100"), False, False),   # exactly 5 % of the ordered quantity
    (("10.00", "100", "10.00", "105.01", "100"), False, True),
    (("10.00", "100", "10.00", "500", None), False, False),    # no receipt
    (("0.00", "100", "0.40", "100", "100"), False, False),     # no percentage of zero
    (("0.00", "100", "0.60", "100", "100"), True, False),
    (("10.00", "0", "10.00", "50", "1"), False, False),
    (("10.00", "100", "12.00", "120", "100"), True, True),
])
def test_match_tolerances(spark, case, price, quantity):
    line = matching.three_way_match_lines(*match_tables(spark, [case])).first()
    assert (line.price_breach, line.quantity_breach) == (price, quantity)


def test_match_receipt_modes(spark):
    inv, po, gr = match_tables(spark, [("10", "100", "10", "100", "60")])
    gr = gr.unionByName(spark.createDataFrame([("G9", 10, "P0", 10, D(40))], gr.schema))
    got = {m: matching.three_way_match_lines(inv, po, gr, receipts=m).first().quantity_variance for m in ("referenced", "first", "sum")}
    assert got == {"referenced": D("40.00"), "first": D("40.00"), "sum": D("0.00")}
    with pytest.raises(ValueError):
        matching.three_way_match_lines(inv, po, gr, receipts="last")


def test_discount_window(spark):
    day = dt.date(2024, 1, 1)
    pay = spark.createDataFrame([(f"P{n}", day + dt.timedelta(n)) for n in (9, 10, 11)], "payment_id string, payment_date date")
    link = spark.createDataFrame([(f"P{n}", "I") for n in (9, 10, 11)], "payment_id string, invoice_id string")
    inv = spark.createDataFrame([("I", day, "V", D("100.25"))], "invoice_id string, invoice_date date, vendor_id string, total_net_amount decimal(14,2)")
    for terms, want in (("2/10NET30", [D("2.01"), D("2.01"), D("0.00")]), ("NET30", [D("0.00")] * 3)):
        v = spark.createDataFrame([("V", terms)], "vendor_id string, payment_terms string")
        got = {r.payment_id: r.discount for r in payments.early_discount(pay, link, inv, v).collect()}
        assert [got["P9"], got["P10"], got["P11"]] == want


def test_tiers(spark):
    df = spark.createDataFrame([(None, "PUBLIC"), ("odd", "PUBLIC"), ("RESTRICTED", None), ("PUBLIC", "PUBLIC")], "a string, b string")
    assert [r[0] for r in df.select(C.max_tier("a", "b")).collect()] == ["INTERNAL", "INTERNAL", "RESTRICTED", "PUBLIC"]


def test_business_days(spark):
    start = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(n),) for n in range(14)], "d date")

    def walk(d, n):
        left = abs(n)
        while left:
            d += dt.timedelta(1 if n > 0 else -1)
            left -= d.weekday() < 5
        return d
    for n in (0, 1, 4, 5, 7, 23, -1, -5, -6, -19):
        for r in df.select("d", C.add_business_days("d", n).alias("x")).collect():
            assert r.x == walk(r.d, n), (r.d, n)


def test_category_walks(spark):
    cat = spark.createDataFrame([("A", None, "G1"), ("A-B", "A", None), ("A-B-C", "A-B", "G2"), ("X", "gone", None)],
                                "category_id string, parent_category_id string, owner_purch_group_id string")
    assert rows(category_root(cat), "category_id") == [("A", "A"), ("A-B", "A"), ("A-B-C", "A"), ("X", "X")]
    assert rows(purch_group_for(cat), "category_id") == [("A", "G1"), ("A-B", "G1"), ("A-B-C", "G2"), ("X", None)]
    assert category_closure(cat).count() == 7


def test_deep_tree(spark):
    names = [f"L{i}" for i in range(1, 6)]
    cat = spark.createDataFrame([(n, names[i - 1] if i else None, "G" if i == 0 else None, i + 1) for i, n in enumerate(names)],
                                "category_id string, parent_category_id string, owner_purch_group_id string, level int")
    assert rows(category_root(cat), "category_id") == [(n, "L1") for n in names]
    assert rows(purch_group_for(cat), "category_id") == [(n, "G") for n in names]
    assert category_closure(cat).count() == 15
    t = {"category_hierarchy": cat, "material_master": spark.createDataFrame([(f"M{i}", n) for i, n in enumerate(names)], "material_id string, category_id string"),
         "po_line_item": spark.createDataFrame([(f"M{i}", 10 ** i) for i in range(5)], "material_id string, net_value int")}
    got = {(r.level_1, r.level_2, r.level_3): int(r.total_spend) for r in analytics.spend_rollup(t).collect()}
    assert got == {(None, None, None): 11111, ("L1", None, None): 11111, ("L1", "L1", None): 1, ("L1", "L2", None): 11110, ("L1", "L1", "L1"): 1,
                   ("L1", "L2", "L2"): 10, ("L1", "L2", "L3"): 11100}


def test_cycle_is_an_error(spark):
    cat = spark.createDataFrame([("A", "B"), ("B", "A")], "category_id string, parent_category_id string")
    with pytest.raises(Exception, match="RECURSION"):
        category_closure(cat).collect()


def test_orphans_let_null_keys_pass(spark):
    child = spark.createDataFrame([("1", "a"), ("2", None), ("3", "z")], "id string, k string")
    parent = spark.createDataFrame([("a",)], "p string")
    assert rows(orphans(child, ["k"], parent, ["p"]).select("id"), "id") == [("3",)]


def test_mask_and_redact(spark):
    df = spark.createDataFrame([("S1234567D met T7654321Z, XS1234567D stays", "ACC")], "text string, bank_account string")
    r = redact(mask_ids(df, ["text"]), "INTERNAL").first()
    assert (r.text, r.masked_entities, r.bank_account) == ("[ID] met [ID], XS1234567D stays", 2, None)


def test_csv_text(spark, tmp_path):
    folder = tmp_path / "purchasing_org"
    folder.mkdir()
    (folder / "a.csv").write_text('purch_org_id,purch_org_name,company_code\nP1,"say ""hi"", ok",\nP2,,1000\n')
    assert rows(read_table_csv(spark, str(tmp_path), "purchasing_org"), "purch_org_id") == [("P1", 'say "hi", ok', None), ("P2", None, "1000")]
    (tmp_path / "po_header").mkdir()
    (tmp_path / "po_header" / "a.csv").write_text(
        "po_id,po_date,vendor_id,purch_org_id,purch_group_id,plant_id,po_type,status,incoterms,payment_terms,currency,total_net_value,maverick_flag,notes\n"
        "1,2024-02-30,V,,,,,,,,,12.5,TRUE,\n2,2024-02-28,V,,,,,,,,,abc,no,\n")
    got = rows(read_table_csv(spark, str(tmp_path), "po_header").select("po_id", "po_date", "total_net_value", "maverick_flag"), "po_id")
    assert got == [("1", None, D("12.50"), True), ("2", dt.date(2024, 2, 28), None, None)]


def test_csv_counts(t, tmp_path):
    got = write_tables_csv(t, str(tmp_path), ["plant", "purchasing_org"])
    assert got == {"plant": 5, "purchasing_org": 2}


def test_fx_unknown_currency(spark):
    df = spark.createDataFrame([(D(100), "EUR"), (D(100), "TWD"), (D(100), None)], "a decimal(14,2), c string")
    assert [r[0] for r in df.select(F.round(C.to_usd("a", "c"), 6)).collect()] == [108.0, 100.0, 100.0]
