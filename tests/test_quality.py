from shelfwise.config import CALENDAR_2016
from shelfwise.operators import quality


def test_missing_values(raw):
    prices = raw("raw_purchase_prices", [{"brand": "1", "price": ""}, {"price": "2"}])
    assert quality.null_counts(prices, "raw_purchase_prices").first().asDict() == {
        "total_rows": 2,
        "null_brand": 1,
        "null_price": 1,
        "null_purchase_price": 2,
        "null_vendor_number": 2,
    }


def test_business_rules(raw):
    tables = {
        "raw_sales": raw(
            "raw_sales",
            [
                {"sales_quantity": "0", "sales_dollars": "-1", "sales_price": "1"},
                {"sales_quantity": "2", "sales_dollars": "2.02", "sales_price": "1"},
                {"sales_quantity": "2", "sales_dollars": "2.03", "sales_price": "1"},
                {"sales_quantity": "Unknown", "sales_dollars": "", "sales_price": "1"},
            ],
        ),
        "raw_beg_inventory": raw("raw_beg_inventory", [{"on_hand": "-1"}, {"on_hand": "0"}]),
        "raw_end_inventory": raw("raw_end_inventory", [{"on_hand": "1"}]),
        "raw_purchase_prices": raw(
            "raw_purchase_prices",
            [
                {"price": "0", "purchase_price": "0.00"},
                {"price": ""},
                {"price": "3", "purchase_price": "2"},
            ],
        ),
        "raw_purchases": raw(
            "raw_purchases", [{"quantity": "2", "purchase_price": "2", "dollars": "5"}]
        ),
    }
    got = {r.check_name: r.fail_count for r in quality.business_rules(tables).collect()}
    assert got == {
        "raw_sales - non-positive qty": 1,
        "raw_sales - negative dollars": 1,
        "raw_sales - price calc mismatch": 2,
        "raw_beg_inventory - negative on_hand": 1,
        "raw_end_inventory - negative on_hand": 0,
        "raw_purchase_prices - zero or null price": 2,
        "raw_purchase_prices - price vs purchase_price differ": 1,
        "raw_purchases - dollar calc mismatch": 1,
    }
    assert list(got) == sorted(got)
    for check, count in got.items():
        assert quality.business_rule(tables, check).first().fail_count == count


def test_date_ranges(raw):
    tables = {
        "raw_sales": raw(
            "raw_sales", [{"sales_date": "2015-12-31"}, {"sales_date": "2016-12-31"}, {}]
        ),
        "raw_purchases": raw("raw_purchases", [{"po_date": "2015-01-01"}]),
        "raw_invoice_purchases": raw(
            "raw_invoice_purchases", [{"invoice_date": "2014-12-31"}, {"invoice_date": "2017-01-10"}]
        ),
    }
    got = {r.table_name: r for r in quality.date_ranges(tables, CALENDAR_2016).collect()}
    assert {t: r.out_of_range for t, r in got.items()} == {
        "raw_sales": 1,
        "raw_purchases": 0,
        "raw_invoice_purchases": 2,
    }
    assert str(got["raw_invoice_purchases"].max_date) == "2017-01-10"


def test_duplicates_are_listed_with_their_count(raw):
    sale = {"inventory_id": "1_A_1", "sales_date": "2016-01-01", "sales_quantity": "1"}
    other = {**sale, "inventory_id": "2_A_1"}
    df = raw("raw_sales", [sale, sale, sale, other, other, {**sale, "sales_quantity": "2"}])
    got = quality.duplicates(df, ["inventory_id", "sales_date", "sales_quantity"]).collect()
    assert [(r.inventory_id, r.dup_count) for r in got] == [("1_A_1", 3), ("2_A_1", 2)]
    prices = raw("raw_purchase_prices", [{"brand": "1"}, {"brand": "1"}, {"brand": "2"}])
    assert quality.duplicates(prices, ["brand", "description", "size"]).first().dup_count == 2


def test_duplicate_report_is_a_top_list(spark):
    df = spark.range(60).selectExpr("CAST(id % 30 AS STRING) AS k")
    assert quality.duplicates(df, ["k"]).count() == 20
    assert quality.duplicates(df, ["k"], top=None).count() == 30


def test_orphans_ignore_missing_keys(spark):
    child = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    parent = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert quality.orphan_count(child, parent, "k", "n").first().n == 2


def test_vendor_whitespace(raw):
    names = ["ACME  ", "ACME", "  LONG NAME  ", None, "ACME  "]
    df = raw("raw_sales", [{"vendor_name": n} for n in names])
    got = [tuple(r) for r in quality.vendor_whitespace(df).collect()]
    assert got == [("  LONG NAME  ", 13, 9), ("ACME  ", 6, 4)]


def test_reconcile_reports_lost_rows(raw):
    sales = raw("raw_sales", [{"brand": "1"}, {"brand": "2"}])
    got = quality.reconcile({"raw_sales": sales}, {"stg_sales": sales.limit(1)}).first()
    assert (got.row_count, got.raw_row_count, got.delta, got.ok) == (1, 2, -1, False)
