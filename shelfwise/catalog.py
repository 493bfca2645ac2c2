"""Every query by name: the Spark job and, beside it, the SQL to check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import oracles
from shelfwise.operators import abc, quality
from shelfwise.operators.presented import Presentation
from shelfwise.operators.profile import Profiles
from shelfwise.plans import kpis, marts, measures, reports, staging
from shelfwise.plans.measures import CLASS, PRODUCT, STORE, Slice, evaluate
from shelfwise.plans.warehouse import Warehouse
from shelfwise.sources.schemas import column_audit

Job = Callable[[Warehouse], DataFrame]

# The slicers shown by rpt16.
SLICERS = Slice(years=(2001,), months=(8, 9), abc_classes=("A",))

# Parameter: rows per range of the queries that show ordering in many ranges.
RANGE_OF_ROWS = 500

# Slicers as a planner sets them: two stores in a month, some SKUs, two classes.
STORES_IN_DECEMBER = Slice(stores=(3, 11), months=(12,))
SOME_BRANDS = Slice(brands=(11, 12, 21, 33, 47))
LOWER_CLASSES = Slice(years=(1999,), abc_classes=("B", "C"))
STORES_IN_TWO_MONTHS = Slice(stores=(3, 11), months=(6, 12))

# How many rows the short forms of long reports show.
RISKIEST = Presentation(top=25, per=("store_number",))
MOST_URGENT = Presentation(top=200)

GRAINS = {
    "total": [],
    "month": [measures.MONTH],
    "store": [STORE],
    "class": [CLASS],
    "product": [PRODUCT],
    "product_store": [PRODUCT, STORE],
}
# Measure key -> (grain it is shown at, measure).
MEASURES = {
    "m01_total_revenue": ("store", "total_revenue"),
    "m02_total_sales_qty": ("store", "total_sales_qty"),
    "m03_total_cogs": ("store", "total_cogs"),
    "m04_beginning_inventory_value": ("store", "beginning_inventory_value"),
    "m05_ending_inventory_value": ("store", "ending_inventory_value"),
    "m06_current_stock_qty": ("store", "current_stock_qty"),
    "m07_average_inventory_value": ("store", "average_inventory_value"),
    "m08_inventory_turnover": ("store", "inventory_turnover"),
    "m09_dsi": ("store", "dsi_days"),
    "m11_total_snapshot_records": ("store", "total_snapshot_records"),
    "m12_out_of_stock_records": ("store", "out_of_stock_records"),
    "m13_stockout_rate": ("store", "stockout_rate"),
    "m14_stockout_rate_carried": ("store", "stockout_rate_carried"),
    "m15_sales_qty_last_90_days": ("month", "sales_qty_last_90_days"),
    "m16_dead_stock_value": ("store", "dead_stock_value"),
    "m17_dead_stock_sku_count": ("class", "dead_stock_sku_count"),
    "m18_dead_stock_pct": ("class", "dead_stock_pct"),
    "m20_avg_daily_sales_qty": ("store", "avg_daily_sales_qty"),
    "m21_stddev_daily_sales_qty": ("class", "stddev_daily_sales_qty"),
    "m22_safety_stock_qty": ("product", "safety_stock_qty"),
    "m23_reorder_point_qty": ("product", "reorder_point_qty"),
    "m24_reorder_alert": ("product_store", "reorder_alert"),
    "m25_reorder_sku_count": ("class", "reorder_sku_count"),
    "m26_unclassified_sku_count": ("class", "unclassified_sku_count"),
    "m27_unclassified_inventory_value": ("store", "unclassified_inventory_value"),
    "m28_unclassified_dead_stock_value": ("store", "unclassified_dead_stock_value"),
    "m33_days_of_stock_remaining": ("product_store", "days_of_stock_remaining"),
    "m34_stock_vs_rop_gap": ("product_store", "stock_vs_rop_gap"),
}
# Labels have a value for every row, so the row's sales and stock records come along.
STATUSES = {
    "m19_dead_stock_flag": "dead_stock_flag",
    "m29_inventory_status": "inventory_status",
    "m30_stock_record_status": "stock_record_status",
    "m31_sku_lifecycle_status": "sku_lifecycle_status",
    "m32_reorder_alert_sort": "reorder_alert_sort",
    "m35_risk_priority_sort": "risk_priority_sort",
}
ROW_MARKS = ["total_sales_qty", "total_snapshot_records"]


def _measure(grain: str, name: str) -> Job:
    def job(w: Warehouse) -> DataFrame:
        rows = evaluate(w, GRAINS[grain], [name])
        return rows.filter(F.col(name).isNotNull())

    return job


def _status(name: str) -> Job:
    return lambda w: evaluate(w, [PRODUCT, STORE], [*ROW_MARKS, name])


def _all_measures(grain: str) -> Job:
    return lambda w: evaluate(w, GRAINS[grain], measures.ALL)


NULL_CHECKS = {
    "dq02a_null_sales": "raw_sales",
    "dq02b_null_purchases": "raw_purchases",
    "dq02c_null_beg_inventory": "raw_beg_inventory",
    "dq02d_null_end_inventory": "raw_end_inventory",
    "dq02e_null_prices": "raw_purchase_prices",
    "dq02f_null_invoices": "raw_invoice_purchases",
}


def audit_jobs(profiles: Profiles) -> dict[str, Job]:
    """The audits that a load has answered already, in place of the scans of the same name."""
    jobs: dict[str, Job] = {
        "src08_column_audit": lambda w: profiles.column_audit(),
        "dq01_row_counts": lambda w: profiles.row_counts(),
        "dq03_business_rules": lambda w: profiles.business_rules(),
        "dq04_date_ranges": lambda w: profiles.date_ranges(w.settings.period),
    }
    for key, table in NULL_CHECKS.items():
        jobs[key] = lambda w, t=table: profiles.null_counts(t)
    for key, (check, _) in oracles.BUSINESS_RULES.items():
        jobs[key] = lambda w, c=check: profiles.business_rule(c)
    return jobs


def _quality_jobs() -> dict[str, Job]:
    jobs: dict[str, Job] = {
        "src08_column_audit": lambda w: column_audit(w.raw_tables()),
        "dq01_row_counts": lambda w: quality.row_counts(w.raw_tables()),
        "dq03_business_rules": lambda w: quality.business_rules(w.raw_tables()),
        "dq11_junk_values": lambda w: staging.junk_counts(w.raw_tables()),
        "dq04_date_ranges": lambda w: quality.date_ranges(w.raw_tables(), w.settings.period),
        "dq05a_dup_sales": lambda w: quality.duplicates(
            w.table("raw_sales"), ["inventory_id", "sales_date", "sales_quantity"]
        ),
        "dq05b_dup_prices": lambda w: quality.duplicates(
            w.table("raw_purchase_prices"), ["brand", "description", "size"]
        ),
        "dq06a_sales_not_in_beg": lambda w: quality.orphan_count(
            w.table("raw_sales"),
            w.table("raw_beg_inventory"),
            "inventory_id",
            "sales_not_in_beg_inv",
        ),
        "dq06b_sales_not_in_end": lambda w: quality.orphan_count(
            w.table("raw_sales"),
            w.table("raw_end_inventory"),
            "inventory_id",
            "sales_not_in_end_inv",
        ),
        "dq06c_vendor_not_in_invoice": lambda w: quality.orphan_count(
            w.table("raw_purchases"),
            w.table("raw_invoice_purchases"),
            "vendor_number",
            "purchase_vendor_not_in_invoice",
        ),
        "dq07_vendor_whitespace": lambda w: quality.vendor_whitespace(w.table("raw_sales")),
        "dq08_staging_row_audit": lambda w: quality.reconcile(
            w.raw_tables(), w.staged_tables()
        ),
        "dq09_mart_row_counts": lambda w: quality.row_counts(
            {
                t: w.table(t)
                for t in (
                    "fact_sales",
                    "fact_inventory_snapshot",
                    "dim_product",
                    "dim_store",
                    "dim_vendor",
                )
            }
        ),
        "dq10_snapshot_probe": lambda w: quality.snapshot_probe(
            w.table("fact_inventory_snapshot"), w.table("dim_store"), w.table("dim_product")
        ),
    }
    for key, table in NULL_CHECKS.items():
        jobs[key] = lambda w, t=table: quality.null_counts(w.table(t), t)
    for key, (check, _) in oracles.BUSINESS_RULES.items():
        jobs[key] = lambda w, c=check: quality.business_rule(
            {c.split(" - ")[0]: w.table(c.split(" - ")[0])}, c
        )
    return jobs


def _layer_jobs() -> dict[str, Job]:
    jobs: dict[str, Job] = {}
    for i, table in enumerate(staging.STAGED, start=1):
        jobs[f"stg{i:02d}_{table[4:]}"] = lambda w, t=table: w.build(t)
    facts = ("fact_sales", "fact_inventory_snapshot")
    jobs |= {
        "dim01_vendor": lambda w: w.build("dim_vendor"),
        "dim02_store": lambda w: w.build("dim_store"),
        "dim03_product": lambda w: w.build("product_base").withColumn(
            "abc_class", F.lit(None).cast("string")
        ),
        "dim04_date": lambda w: w.build("dim_date"),
        "dim05_date_labels": lambda w: marts.with_date_labels(w.table("dim_date")),
        "dim06_abc_labels": lambda w: marts.with_abc_labels(w.table("dim_product")),
        "fact01_sales": lambda w: w.build("fact_sales"),
        "fact03_daily_moments": lambda w: w.build("daily_moments"),
        "fact02_inventory_snapshot": lambda w: w.build("fact_inventory_snapshot"),
        "abc01_product_revenue": lambda w: abc.product_revenue(w.table("fact_sales")),
        "abc02_running_total": lambda w: w.build("abc_running_total"),
        # the same with many ranges, as large tables have them
        "abc02_in_ranges": lambda w: abc.with_running_total(
            abc.product_revenue(w.table("fact_sales")), rows_per_range=RANGE_OF_ROWS
        ),
        "dim03_in_ranges": lambda w: marts.product_base(
            w.table("stg_purchase_prices"), w.table("stg_sales"), rows_per_range=RANGE_OF_ROWS
        ),
        "abc03_labels": lambda w: abc.labels(w.table("abc_running_total")),
        "abc04_backfill": lambda w: w.build("dim_product"),
        "abc05_verify": lambda w: abc.class_summary(w.table("dim_product")),
        "kpi_a2_sales_totals": lambda w: kpis.sales_totals(w.table("fact_sales")),
        # costs add up over days
        "kpi_a3_turnover_dsi": lambda w: kpis.turnover_dsi(
            w.table("daily_sales"), w.table("fact_inventory_snapshot")
        ),
        "kpi_b1_stockout_rate": lambda w: kpis.stockout_rate(
            w.table("fact_inventory_snapshot")
        ),
        "kpi_b2_dead_stock": lambda w: kpis.dead_stock(*[w.table(f) for f in facts]),
        "kpi_c1_abc_distribution": lambda w: abc.class_distribution(w.table("dim_product")),
        "kpi_c2_top_products": lambda w: kpis.best_sellers(
            w.table("fact_sales"), w.table("dim_product")
        ),
    }
    return jobs


def _measure_jobs() -> dict[str, Job]:
    jobs = {key: _measure(grain, name) for key, (grain, name) in MEASURES.items()}
    jobs |= {key: _status(name) for key, name in STATUSES.items()}
    jobs["m10_inventory_turnover_ytd"] = measures.turnover_ytd
    jobs["m10_stores_and_months"] = lambda w: measures.turnover_ytd(w, STORES_IN_TWO_MONTHS)
    jobs |= {f"measures_by_{grain}": _all_measures(grain) for grain in GRAINS}
    return dict(sorted(jobs.items()))


def _report_jobs() -> dict[str, Job]:
    return {
        "rpt01_exec_cards": reports.exec_cards,
        "rpt02_monthly_trend": reports.monthly_trend,
        "rpt03_stockout_by_store": reports.stockout_by_store,
        "rpt04_dead_stock_by_abc": reports.dead_stock_by_abc,
        "rpt05_store_abc_matrix": reports.store_abc_matrix,
        "rpt06_risk_cards": reports.risk_cards,
        "rpt07_store_risk_quadrant": reports.store_risk_quadrant,
        "rpt08_dead_stock_by_store": reports.dead_stock_by_store,
        "rpt09_risk_detail": reports.risk_detail,
        "rpt09_riskiest_per_store": lambda w: reports.risk_detail(w, shown=RISKIEST),
        "rpt10_replenish_cards": reports.replenish_cards,
        "rpt11_rop_gap": reports.rop_gap,
        "rpt11_most_urgent": lambda w: reports.rop_gap(w, shown=MOST_URGENT),
        "rpt12_reorder_by_abc": reports.reorder_by_abc,
        "rpt13_top_reorder": reports.top_reorder,
        "rpt14_replenish_matrix": reports.replenish_matrix,
        "rpt15_sku_detail": reports.sku_detail,
        "rpt16_filters": lambda w: reports.sliced_by_store(w, SLICERS),
        "rpt16_stores_and_month": lambda w: reports.sliced_by_store(w, STORES_IN_DECEMBER),
        "rpt16_brands": lambda w: reports.sliced_by_store(w, SOME_BRANDS),
        "rpt16_classes_and_year": lambda w: reports.sliced_by_store(w, LOWER_CLASSES),
        "rpt15_some_skus": lambda w: reports.sku_detail(w, SOME_BRANDS),
        "rpt17_inventory_growth": reports.inventory_growth,
        "rpt18_monthly_share": reports.monthly_share,
        "rpt19_store_revenue_rank": reports.store_revenue_rank,
        "rpt20_sku_week_run_rate": reports.sku_week_run_rate,
        "rpt21_bottom_c_class": reports.bottom_c_class,
        "rpt22_dead_stock_clearance": reports.dead_stock_clearance,
    }


def jobs() -> dict[str, Job]:
    return {**_quality_jobs(), **_layer_jobs(), **_measure_jobs(), **_report_jobs()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(job: Job) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: job(Warehouse.over_feed(spark, sf_dir))

    found = {name: bound(job) for name, job in jobs().items()}
    # the duplicate check on a table that does hold duplicates
    found["dq05_dup_order_lines"] = lambda spark, sf_dir: quality.duplicates(
        spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], top=None
    )
    return dict(sorted(found.items()))


def _measure_sql() -> dict[str, str]:
    def one(grain: str, columns: list[str], condition: str) -> str:
        shown = ", ".join([*GRAINS[grain], *columns])
        return oracles.measures_sql(grain, f"SELECT {shown} FROM m WHERE {condition}")

    sql = {k: one(g, [n], f"{n} IS NOT NULL") for k, (g, n) in MEASURES.items()}
    sql |= {k: one("product_store", [*ROW_MARKS, n], "TRUE") for k, n in STATUSES.items()}
    sql["m10_inventory_turnover_ytd"] = oracles.with_ctes(oracles.YTD_SQL)
    sql["m10_stores_and_months"] = oracles.ytd_of_stores((3, 11), (6, 12))
    sql |= {f"measures_by_{g}": oracles.measures_sql(g) for g in GRAINS}
    return sql


def oracle_sql() -> dict[str, str]:
    return {
        **oracles.quality_sql(),
        **oracles.layer_sql(),
        **_measure_sql(),
        **oracles.report_sql(),
    }
