from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators import abc
from shelfwise.operators.ordered import number_rows, running_total
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def revenue(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    return lines.groupBy(F.col("l_partkey").alias("product_sk")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).alias("total_sales_dollars")
    )


@pytest.mark.parametrize("rows_per_range", [7, 60, 1000])
def test_row_numbers_equal_a_single_window(revenue, rows_per_range):
    order = [F.desc("total_sales_dollars"), F.asc("product_sk")]
    got = {
        r.product_sk: (r.n, r.total) for r in number_rows(revenue, order, "n", "total", rows_per_range).collect()
    }
    one = revenue.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    size = revenue.count()
    assert got == {r.product_sk: (r.n, size) for r in one.collect()}


@pytest.mark.parametrize("rows_per_range", [7, 60, 1000])
def test_running_total_equals_a_single_window(revenue, rows_per_range):
    order = [F.desc("total_sales_dollars"), F.asc("product_sk")]
    got = running_total(
        revenue, order, "total_sales_dollars", "running", "whole", rows_per_range
    ).collect()
    frame = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    one = revenue.withColumn("running", F.sum("total_sales_dollars").over(frame)).collect()
    assert {r.product_sk: r.running for r in got} == {r.product_sk: r.running for r in one}
    assert {r.whole for r in got} == {max(r.running for r in one)}


def test_one_value_in_all_rows_is_spread_by_the_tie_break(spark):
    df = spark.range(1000).selectExpr("id AS product_sk", "CAST(5 AS DECIMAL(12,2)) AS v")
    numbered = number_rows(
        df, [F.desc("v"), F.asc("product_sk")], "n", rows_per_range=100
    )
    assert {r.product_sk: r.n for r in numbered.collect()} == {i: i + 1 for i in range(1000)}


def test_ranges_are_worked_on_apart(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    numbered = number_rows(df, [F.asc("k")], "n", rows_per_range=100)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan


def _classes(spark, values):
    df = spark.createDataFrame(
        [(k, None if v is None else Decimal(v)) for k, v in values],
        "product_sk bigint, total_sales_dollars decimal(22,2)",
    )
    return {
        r.product_sk: (r.cumulative_pct, r.abc_class)
        for r in abc.labels(abc.with_running_total(df)).collect()
    }


def test_a_single_product_is_class_c(spark):
    assert _classes(spark, [(1, "10")]) == {1: (100.0, "C")}


def test_limits_belong_to_the_lower_class_and_ties_go_by_product(spark):
    got = _classes(spark, [(4, "40"), (2, "40"), (3, "15"), (1, "5")])
    assert got == {2: (40.0, "A"), 4: (80.0, "A"), 3: (95.0, "B"), 1: (100.0, "C")}


def test_no_revenue_at_all_is_class_c(spark):
    assert _classes(spark, [(1, "0"), (2, "0")]) == {1: (None, "C"), 2: (None, "C")}


def test_percent_is_rounded_once(spark):
    # 79.99995 and 80.00005 percent: a quotient cut to six places would round twice
    assert _classes(spark, [(1, "7999995"), (2, "2000005")])[1] == (80.0, "A")
    assert _classes(spark, [(1, "8000005"), (2, "1999995")])[1] == (80.0001, "B")


def test_classes_partition_the_products_and_percent_grows(spark, revenue):
    running = abc.with_running_total(revenue)
    rows = running.orderBy(F.desc("total_sales_dollars"), "product_sk").collect()
    pct = [r.cumulative_pct for r in rows]
    assert pct == sorted(pct) and pct[-1] == 100.0
    got = [r.abc_class for r in abc.labels(running).orderBy("cumulative_pct").collect()]
    assert len(got) == len(rows) and got == sorted(got) and set(got) == {"A", "B", "C"}
