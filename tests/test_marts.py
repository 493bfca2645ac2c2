import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import kpis, marts
from tests import tiny


@pytest.fixture(scope="module")
def w(spark, raw, tmp_path_factory):
    return tiny.warehouse(spark, raw, str(tmp_path_factory.mktemp("tiny")))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_dimensions(w):
    assert rows(w.table("dim_vendor"), "vendor_sk", "vendor_number", "vendor_name") == [
        (1, 3, "ZETA"),
        (2, 7, "ACME"),
    ]
    stores = w.table("dim_store").orderBy("store_sk").collect()
    assert [(r.store_sk, r.store_number, r.city) for r in stores] == [
        (1, 1, "ALPHA"),
        (2, 2, None),
        (3, 3, None),
    ]
    products = w.table("dim_product").orderBy("product_sk").collect()
    assert [(r.product_sk, r.brand) for r in products] == [
        (1, 10),
        (2, 20),
        (3, 30),
        (4, 40),
        (5, 50),
    ]
    by_brand = {r.brand: r for r in products}
    assert by_brand[20].default_cost_price is None  # a price of zero is no price
    assert by_brand[50].description == "item 50" and by_brand[50].default_retail_price is None
    # revenue 120, 15, 14, 4 of 153: 78.4, 88.2, 97.4, 100 percent
    assert {r.brand: r.abc_class for r in products} == {
        10: "A",
        20: "B",
        30: "C",
        50: "C",
        40: None,
    }


def test_facts_keep_every_row(w):
    assert w.table("fact_sales").count() == len(tiny.SALES)
    snapshot = w.table("fact_inventory_snapshot")
    assert snapshot.count() == len(tiny.BEGINNING) + len(tiny.ENDING)
    unknown = snapshot.filter("product_sk IS NULL").collect()
    assert [(r.inventory_id, r.total_inventory_value) for r in unknown] == [
        ("2_None_60", Decimal("15.0000"))
    ]
    cogs = {r.product_sk: r.c for r in w.table("fact_sales").groupBy("product_sk").agg(F.sum("estimated_cogs").alias("c")).collect()}
    assert cogs == {1: Decimal("72.0000"), 2: 0, 3: Decimal("7.0000"), 5: 0}


def test_calendar(w):
    days = w.table("dim_date").orderBy("date_key").collect()
    assert len(days) == 366
    first = days[0]
    assert (first.date_key, first.week_of_year, first.day_of_week) == (dt.date(2016, 1, 1), 53, 5)
    assert (first.month_name, first.day_name) == ("January  ", "Friday   ")
    assert first.is_weekend is False and days[1].is_weekend is True
    labels = marts.with_date_labels(w.table("dim_date")).filter("date_key = '2016-05-03'").first()
    assert (labels.month_name_short, labels.month_sort, labels.year_month, labels.quarter_label) == (
        "May",
        5,
        "2016-05",
        "Q2",
    )


def test_abc_labels(w):
    got = {
        r.brand: (r.abc_class_display, r.abc_class_sort, r.abc_priority_group)
        for r in marts.with_abc_labels(w.table("dim_product")).collect()
    }
    assert got[10] == ("A", 1, "A - Critical")
    assert got[40] == ("Unclassified", 4, "Review - Unclassified")


def test_kpis(w):
    sales, snapshot = w.table("fact_sales"), w.table("fact_inventory_snapshot")
    a3 = kpis.turnover_dsi(sales, snapshot).first()
    # cost 79; opening 110, closing 0 + 90 + 60 - 2 + 15 + 0 = 163
    assert (a3.total_cogs, a3.beg_inventory_value, a3.end_inventory_value) == (79, 110, 163)
    assert (a3.avg_inventory_value, a3.inventory_turnover, a3.dsi_days) == (137, 0.58, 630.7)  # 365 * 136.5 / 79 = 630.66
    b1 = kpis.stockout_rate(snapshot).first()
    assert tuple(b1) == (6, 2, 33.33)  # a negative stock is not equal to zero
    b2 = kpis.dead_stock(sales, snapshot).first()
    # only the unknown product is in stock and unsold in its store
    assert tuple(b2) == (6, 1, 16.67, 5)
    top = kpis.best_sellers(sales, w.table("dim_product")).collect()
    assert [(r.brand, r.total_revenue, r.total_qty_sold, r.avg_selling_price) for r in top] == [
        (10, 120, Decimal("12.00"), 10.0)
    ]


def test_one_pass_product_base_equals_the_full_outer_join(spark):
    rnd = random.Random(5)

    def text():
        return rnd.choice([None, "a", "b", "c"])

    prices = spark.createDataFrame(
        [(rnd.choice([None, *range(12)]), text(), text(), rnd.choice([None, 1, 2]), rnd.choice([None, 1, 2]), rnd.randint(1, 9), rnd.randint(1, 9), 1) for _ in range(30)],
        "brand bigint, description string, size string, volume_ml int, classification int, retail_price int, purchase_price int, gross_margin_pct int",
    )
    sales = spark.createDataFrame(
        [(rnd.choice([None, *range(6, 20)]), text(), text(), rnd.choice([None, 3, 4]), rnd.choice([None, 3])) for _ in range(40)],
        "brand bigint, description string, size string, volume_ml int, classification int",
    )
    prices.createOrReplaceTempView("p_list")
    sales.createOrReplaceTempView("p_sales")
    shared = ("description", "size", "volume_ml", "classification")
    expected = spark.sql(
        "SELECT COALESCE(p.brand, s.brand) AS brand, "
        + ", ".join(f"MAX(COALESCE(p.{c}, s.{c})) AS {c}" for c in shared)
        + ", MAX(retail_price) AS default_retail_price FROM p_list p FULL OUTER JOIN (SELECT brand, "
        + ", ".join(f"MAX({c}) AS {c}" for c in shared)
        + " FROM p_sales WHERE brand IS NOT NULL GROUP BY brand) s ON p.brand = s.brand GROUP BY 1"
    )
    got = marts.product_base(prices, sales)
    columns = ["brand", *shared, "default_retail_price"]

    def table(df):
        return sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))

    assert table(got) == table(expected)
    # numbered 1..n by brand, the row without a brand last
    numbered = got.orderBy("product_sk").collect()
    assert [r.product_sk for r in numbered] == list(range(1, len(numbered) + 1))
    brands = [r.brand for r in numbered]
    assert brands[-1] is None and brands[:-1] == sorted(brands[:-1])
