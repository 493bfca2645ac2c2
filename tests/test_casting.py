import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.config import CALENDAR_2016
from shelfwise.functions.casting import defensive_cast, safe_divide
from shelfwise.plans.staging import STAGED, quarantine, stage, stamped


@pytest.fixture(scope="module")
def texts(spark):
    values = [None, "", "   ", "Unknown", " Unknown ", " 7 ", "162.5"]
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_blank_and_placeholder_become_null(texts):
    got = [r[0] for r in texts.select(defensive_cast("v", "decimal(10,2)")).collect()]
    assert got == [None] * 5 + [Decimal("7.00"), Decimal("162.50")]


def test_fraction_is_no_integer(spark):
    df = spark.createDataFrame([("162.5",)], "v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(defensive_cast("v", "bigint")).collect()
    assert df.select(defensive_cast("v", "bigint", strict=False)).first()[0] is None


def test_junk_fails_or_is_quarantined(raw):
    df = raw("raw_sales", [{"brand": "1", "store": "abc"}, {"brand": "2", "store": "3"}])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        stage(df, "stg_sales", CALENDAR_2016).collect()
    assert stage(df, "stg_sales", CALENDAR_2016, strict=False).count() == 2
    bad = quarantine(df, "stg_sales").select("brand", "junk_columns").collect()
    assert [(r.brand, r.junk_columns) for r in bad] == [("1", ["store"])]


def test_prices_and_margin(raw):
    rows = [
        {"brand": "68", "price": "24.99", "purchase_price": "18.93"},
        {"brand": "2", "price": "0", "purchase_price": "5"},
        {"brand": "3", "price": "5", "purchase_price": "Unknown"},
        {"brand": "4", "price": "10", "purchase_price": "12.5"},
    ]
    staged = stage(raw("raw_purchase_prices", rows), "stg_purchase_prices", CALENDAR_2016)
    got = {r.brand: (r.retail_price, r.gross_margin_pct) for r in staged.collect()}
    assert got == {
        68: (Decimal("24.99"), Decimal("24.25")),
        2: (None, None),
        3: (Decimal("5.00"), None),
        4: (Decimal("10.00"), Decimal("-25.00")),
    }


def test_carry_over_flag(raw):
    rows = [
        {"po_number": "1", "invoice_date": "2016-12-31"},
        {"po_number": "2", "invoice_date": "2017-01-01"},
        {"po_number": "3"},
    ]
    staged = stage(raw("raw_invoice_purchases", rows), "stg_invoice_purchases", CALENDAR_2016)
    got = {r.po_number: r.is_carryover_invoice for r in staged.collect()}
    assert got == {1: False, 2: True, 3: False}


def test_types_names_and_trim(raw):
    row = {
        "vendor_no": "12546",
        "vendor_name": "ACME TRADING    ",
        "volume": "750",
        "sales_date": "2016-01-01",
        "sales_dollars": "16.49",
    }
    staged = stage(raw("raw_sales", [row]), "stg_sales", CALENDAR_2016)
    kinds = dict(staged.dtypes)
    assert kinds["vendor_number"] == "bigint" and kinds["volume_ml"] == "decimal(10,2)"
    assert kinds["sales_dollars"] == "decimal(12,2)" and kinds["sales_date"] == "date"
    first = staged.first()
    assert first.vendor_name == "ACME TRADING"
    assert first.sales_date == dt.date(2016, 1, 1)
    assert stamped(staged).first().stg_loaded_at is not None
    assert list(STAGED["stg_sales"]) == staged.columns


def test_safe_divide(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "x double, y double")
    assert [r[0] for r in df.select(safe_divide(F.col("x"), F.col("y"))).collect()] == [
        None,
        None,
        0.25,
    ]
