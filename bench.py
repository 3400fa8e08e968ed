"""Time the headline queries: one JSON line.

The purchasing tables are derived and written first (``setup``), as they would exist
already in use; each query is then run to the end on a no-op sink, best of two.
"""

from __future__ import annotations

import json
import os
import time

from buylens.plans.registry import plans
from buylens.schemas import TABLE_ORDER
from buylens.session import local_session
from buylens.sources import purchasing_tables

HEADLINE = [
    "b01_three_way_match_lines", "b02_match_status", "b16_reconcile_contracts", "b18_propagate_confidentiality", "b23_resolve_source",
    "v19_foreign_keys", "v20_primary_keys", "v49_temporal_order", "ge15_all_edges", "gq06_p2p_chain", "gq22_two_hop", "gq23_components",
    "rq01_spend_by_vendor", "rq02_spend_rollup", "rq05_overdue_invoices", "e07_five_number_amounts", "e16_risk_curve", "f02_vendor_performance",
    "f04_invoice_behavior_loo", "f05_price_benchmarks", "f08_category_spend", "f09_pair_performance", "u207_uc02_table_train",
    "u401_uc04_features", "u403_price_outliers_mad", "u501_uc05_features", "u801_uc08_features", "u901_uc09_features",
    "u1101_duplicate_links", "u1103_fuzzy_pairs", "m06_stratified_folds", "m07_binary_metrics", "st01_stream_match", "st03_refresh_prices",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    start = time.time()
    t = purchasing_tables(spark, sf_dir)
    for name in TABLE_ORDER:
        t[name]
    setup = time.time() - start
    times, all_plans = {}, plans()
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.time()
            all_plans[name](t).write.format("noop").mode("overwrite").save()
            spent = time.time() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "setup": round(setup, 3), "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
