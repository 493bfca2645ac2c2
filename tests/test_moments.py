"""Measures from stored daily moments are those from the days."""

import re

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import marts, measures
from shelfwise.plans.measures import CLASS, DAILY, MONTH, PRODUCT, STORE, Context, Slice, evaluate
from shelfwise.plans.warehouse import Warehouse
from tests import tiny
from tests.conftest import SMALL

GRAINS = [[], [PRODUCT], [STORE, CLASS], [PRODUCT, STORE], [PRODUCT, MONTH], [CLASS, MONTH]]
SLICES = {
    "all": Slice(),
    "months": Slice(years=(2000,), months=(3, 4)),
    "stores": Slice(stores=(3, 11)),
    "class": Slice(abc_classes=("A",)),
    "brands": Slice(brands=(21, 22, 31), stores=(3,)),
    "vendors": Slice(vendors=(1, 2, 3)),
}


@pytest.fixture(scope="module")
def feed(spark):
    return Warehouse.over_feed(spark, SMALL)


@pytest.mark.parametrize("grain", GRAINS, ids=str)
@pytest.mark.parametrize("where", SLICES)
def test_months_tell_what_days_tell(feed, monkeypatch, grain, where):
    ctx = Context(feed, grain, SLICES[where])
    params = feed.settings.replenishment
    by_month = measures.daily_statistics(ctx, params).collect()
    monkeypatch.setattr(Context, "moments", lambda *_: None)
    by_day = measures.daily_statistics(ctx, params).collect()
    assert sorted(map(str, by_month)) == sorted(map(str, by_day)) and by_day


def test_days_are_asked_where_slicers_cut_through_the_keys(feed):
    def told(grain, **slicers):
        return Context(feed, grain, Slice(**slicers)).moments(grain) is not None

    assert told([PRODUCT], brands=(21,)) and told([CLASS], abc_classes=("A",)) and told([STORE], stores=(3,))
    assert told([], years=(2000,)) and told([PRODUCT, STORE, CLASS], abc_classes=("A",))
    assert not told([PRODUCT], stores=(3,)) and not told([STORE], brands=(21,))
    assert not told([STORE], abc_classes=("A",)) and not told([PRODUCT], vendors=(1,))
    assert not told([CLASS], brands=(21,))


def test_whole_months_do_not_read_days(spark, feed):
    df = evaluate(feed, [PRODUCT], DAILY, Slice(years=(2000,)))
    text = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet.*", text)
    assert any("daily_moments" in s or "sxx" in s for s in scans)
    assert not any("sales_quantity" in s for s in scans)
    assert re.search(r"PartitionFilters: \[[^\]]*moments_of", text)


def test_days_without_a_date_or_a_quantity(spark):
    """A sale without a date is in the sums but is no active day; a day without a quantity is an
    active day but has no value. Repeated rows of a day are one value."""
    daily = spark.createDataFrame(
        [
            (201601, 1, 1, "2016-01-05", 4.0),
            (201601, 1, 1, "2016-01-05", 1.0),
            (201601, 1, 2, "2016-01-05", -2.0),
            (201601, 1, 1, "2016-01-06", None),
            (None, 1, 1, None, 3.0),
            (201602, None, 1, "2016-02-01", 7.0),
        ],
        "sales_month int, product_sk long, store_sk long, sales_date string, q double",
    ).select(
        "sales_month",
        "product_sk",
        "store_sk",
        F.to_date("sales_date").alias("sales_date"),
        F.col("q").cast("decimal(20,2)").alias("sales_quantity"),
    )
    products = spark.createDataFrame([(1, "A")], "product_sk long, abc_class string")
    rows = marts.daily_moments(daily, products).collect()
    got = {
        (r.moments_of, r.sales_month, r.abc_class_display, r.product_sk, r.store_sk): tuple(
            None if v is None else float(v) for v in (r.sx, r.sxx, r.n, r.active_days)
        )
        for r in rows
    }
    assert len(got) == len(rows)
    assert got["product_sk", 201601, None, 1, None] == (3, 9, 1, 2)
    assert got["product_sk_store_sk", 201601, None, 1, 1] == (5, 25, 1, 2)
    assert got["product_sk_store_sk", 201601, None, 1, 2] == (-2, 4, 1, 1)
    assert got["abc_class_display", 201601, "A", None, None] == (3, 9, 1, 2)
    assert got["abc_class_display", 201602, None, None, None] == (7, 49, 1, 1)
    assert got["all", None, None, None, None] == (3, 9, 1, 0)
    assert marts.daily_moments(daily.limit(0), products).count() == 0


def test_no_sales_have_no_moments(spark, raw, tmp_path):
    tables = tiny.raw_tables(raw)
    tables["raw_sales"] = tables["raw_sales"].limit(0)
    w = Warehouse.over_raw(spark, tables, tiny.CALENDAR_2016, str(tmp_path))
    assert w.table("daily_moments").count() == 0
    assert evaluate(w, [PRODUCT], DAILY).count() == 0
