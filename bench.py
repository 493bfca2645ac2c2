"""Headline timings: building the layers, then the queries over them.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from shelfwise import catalog
from shelfwise.plans import staging
from shelfwise.plans.warehouse import Warehouse
from shelfwise.session import local_session
from shelfwise.sources.schemas import RAW_TABLES

HEADLINE = [
    "dq03_business_rules",
    "dq06a_sales_not_in_beg",
    "stg01_sales",
    "dim03_product",
    "fact01_sales",
    "fact02_inventory_snapshot",
    "abc02_running_total",
    "kpi_a3_turnover_dsi",
    "kpi_b1_stockout_rate",
    "kpi_b2_dead_stock",
    "kpi_c2_top_products",
    "m10_inventory_turnover_ytd",
    "m16_dead_stock_value",
    "m24_reorder_alert",
    "m25_reorder_sku_count",
    "rpt01_exec_cards",
    "rpt05_store_abc_matrix",
    "rpt09_risk_detail",
    "rpt14_replenish_matrix",
    "rpt22_dead_stock_clearance",
]
LAYERS = {
    "build_raw": RAW_TABLES,
    "build_staging": tuple(staging.STAGED),
    "build_marts": (
        "dim_vendor",
        "dim_store",
        "product_base",
        "fact_sales",
        "daily_sales",
        "fact_inventory_snapshot",
        "abc_running_total",
        "dim_product",
        "dim_date",
        "daily_moments",
    ),
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    warehouse = Warehouse.over_feed(spark, folder)
    seconds: dict[str, float] = {}

    def timed(name, action) -> None:
        began = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - began, 3)

    for layer, tables in LAYERS.items():
        timed(layer, lambda: [warehouse.table(t) for t in tables])
    queries = catalog.queries()
    for name in HEADLINE:
        # the whole result is computed, nothing is collected or written
        timed(name, lambda: queries[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total seconds, layer builds and headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
