"""Dimensions too large to broadcast, and one brand holding a third of the sales."""

import duckdb
import pytest

import __spark_entry__ as contract
from shelfwise.config import CALENDAR_2016
from shelfwise.plans.measures import PRODUCT, evaluate
from shelfwise.plans.warehouse import Warehouse
from tests.conftest import SMALL
from tools.check import TABLES, canonical

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
SPLIT_EARLY = {
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
}


@pytest.fixture
def settings(spark):
    before = {}

    def use(changes):
        for key, value in changes.items():
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield use
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize(
    "name",
    ["fact01_sales", "kpi_b2_dead_stock", "m25_reorder_sku_count", "measures_by_month", "rpt05_store_abc_matrix", "rpt22_dead_stock_clearance"],
)
def test_same_result_without_broadcast(spark, settings, name):
    settings(NO_BROADCAST)
    df = contract.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert canonical(df.columns, df.collect()) == canonical(names, result.fetchall())


def test_a_hot_brand_is_split_and_nothing_is_lost(spark, settings, raw, tmp_path):
    n = 60_000
    sales = spark.range(n).selectExpr(
        "CONCAT('1_A_', id) AS inventory_id",
        "CAST(1 + id % 5 AS STRING) AS store",
        # a third is brand 1, a tenth has no brand
        "CASE WHEN id % 3 = 0 THEN '1' WHEN id % 10 = 1 THEN NULL ELSE CAST(id % 900 AS STRING) END AS brand",
        "CONCAT('item ', id % 7) AS description",
        "'750mL' AS size",
        "'2' AS sales_quantity",
        "'6' AS sales_dollars",
        "'3' AS sales_price",
        "CAST(DATE_ADD(DATE'2016-01-01', CAST(id % 366 AS INT)) AS STRING) AS sales_date",
        "'750' AS volume",
        "'1' AS classification",
        "'0.1' AS excise_tax",
        "CAST(id % 40 AS STRING) AS vendor_no",
        "'ACME' AS vendor_name",
    )
    empty = ("raw_purchases", "raw_invoice_purchases", "raw_beg_inventory", "raw_end_inventory")
    tables = {t: raw(t, []) for t in empty}
    tables["raw_purchase_prices"] = raw(
        "raw_purchase_prices", [{"brand": str(b), "price": "3", "purchase_price": "2"} for b in range(900)]
    )
    w = Warehouse.over_raw(spark, {"raw_sales": sales, **tables}, CALENDAR_2016, str(tmp_path))
    w.table("product_base"), w.table("dim_store"), w.table("dim_vendor")
    settings({**NO_BROADCAST, **SPLIT_EARLY})
    fact = w.build("fact_sales")
    assert len(fact.collect()) == n
    assert "skew=true" in fact._jdf.queryExecution().executedPlan().toString()
    got = {r[PRODUCT]: r for r in evaluate(w, [PRODUCT], ["total_revenue", "avg_daily_sales_qty"]).collect()}
    hot = sum(1 for i in range(n) if i % 3 == 0 or (i % 10 != 1 and i % 900 == 1))
    brandless = sum(1 for i in range(n) if i % 3 and i % 10 == 1)
    sk = w.table("product_base").filter("brand = 1").first()[PRODUCT]
    assert got[sk].total_revenue == 6 * hot and got[None].total_revenue == 6 * brandless
    assert sum(r.total_revenue for r in got.values()) == 6 * n
