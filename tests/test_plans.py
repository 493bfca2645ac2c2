"""What the plans must look like for the jobs to hold at scale."""

import re

import pytest

from shelfwise import catalog
from shelfwise.plans import marts
from shelfwise.plans.measures import Slice, evaluate
from shelfwise.plans.warehouse import Warehouse
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def plan(spark):
    def of(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return of


@pytest.fixture(scope="module")
def queries():
    return catalog.queries()


def test_scans_read_only_what_is_used(spark, plan, queries):
    text = plan(queries["m01_total_revenue"](spark, SMALL))
    assert "ReadSchema: struct<sales_dollars:decimal(22,2),store_sk:bigint>" in text or (
        "ReadSchema: struct<store_sk:bigint,sales_dollars:decimal(22,2)>" in text
    )


def test_stock_counts_read_one_partition(spark, plan, queries):
    text = plan(queries["kpi_b1_stockout_rate"](spark, SMALL))
    assert re.search(r"PartitionFilters: \[.*snapshot_type.*ENDING", text)


def test_year_slicer_prunes_months(spark, plan):
    w = Warehouse.over_feed(spark, SMALL)
    text = plan(evaluate(w, [], ["total_revenue"], Slice(years=(2000,))))
    assert re.search(r"PartitionFilters: \[[^\]]*sales_month", text)


def test_window_measure_prunes_months_at_run_time(spark, plan, queries):
    text = plan(queries["m16_dead_stock_value"](spark, SMALL))
    assert re.search(r"sales_month#\d+ >= .*Subquery|PartitionFilters: \[[^\]]*sales_month", text)


def test_facts_are_grouped_in_one_shuffle(spark, plan, queries):
    """Sales, window and stock of a pair meet in a single exchange on the pair."""
    text = plan(queries["m29_inventory_status"](spark, SMALL))
    assert text.count("Exchange hashpartitioning(product_sk") == 1


def test_dead_stock_join_uses_the_grouping(spark, plan, queries):
    text = plan(queries["kpi_b2_dead_stock"](spark, SMALL))
    assert text.count("Exchange hashpartitioning(product_sk") == 2


def test_no_python_and_no_cross_join_anywhere(spark, plan, queries):
    for name in ("measures_by_product_store", "rpt14_replenish_matrix", "rpt22_dead_stock_clearance", "fact01_sales"):
        text = plan(queries[name](spark, SMALL))
        assert "Python" not in text and "Pandas" not in text, name
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_text_is_deduplicated_by_hash_before_its_maximum(spark, plan, queries):
    """The maximum of a text sorts its input, so it must not see the fact's rows."""
    w = Warehouse.over_feed(spark, SMALL)
    rows = marts.product_rows(w.table("stg_purchase_prices"), w.table("stg_sales"))
    text = plan(rows)
    below_union = text[text.index("Union") :]
    assert below_union.count("HashAggregate") == 2 and "Sort" not in below_union


def test_reorder_matrix_reads_each_table_once(spark, plan, queries):
    """Three levels of measures that do not add up, from one pass over both facts."""
    text = plan(queries["rpt14_replenish_matrix"](spark, SMALL))
    for column in ("sales_quantity", "quantity_on_hand"):  # of the daily sales, of the stock counts
        assert len(re.findall(rf"FileScan parquet.*ReadSchema: \S*{column}", text)) == 1, column


def test_a_brand_sold_with_many_numbers_is_one_row_before_its_texts(spark, plan):
    """Volumes and classifications fold by hash, with the texts as keys."""
    w = Warehouse.over_feed(spark, SMALL)
    text = plan(marts.product_rows(w.table("stg_purchase_prices"), w.table("stg_sales")))
    below_union = text[text.index("Union") :]
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", below_union)
    assert [len(k.split(", ")) for k in keys] == [4]  # brand, two texts and the number of partitions


def test_parts_become_packs_behind_the_join(spark, plan):
    w = Warehouse.over_feed(spark, SMALL)
    text = plan(w.build("raw_purchase_prices"))
    at = {name: text.index(name) for name in ("Generate posexplode", "FileScan parquet")}
    assert at["Generate posexplode"] < at["FileScan parquet"]
    assert re.search(r"Exchange hashpartitioning\(l_partkey#\d+L?, \d+\)", text)
