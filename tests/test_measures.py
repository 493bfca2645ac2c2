import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.config import Replenishment
from shelfwise.functions import labels
from shelfwise.operators.quality import snapshot_probe
from shelfwise.plans import measures, reports
from shelfwise.plans.measures import (
    CLASS,
    DAILY,
    LEVEL,
    MONTH,
    PRODUCT,
    STOCK_VS_ROP,
    STORE,
    Slice,
    evaluate,
    evaluate_levels,
)
from tests import tiny


@pytest.fixture(scope="module")
def w(spark, raw, tmp_path_factory):
    return tiny.warehouse(spark, raw, str(tmp_path_factory.mktemp("tiny")))


def by_pair(w, names, **options):
    found = evaluate(w, [PRODUCT, STORE], names, **options).filter(F.col(PRODUCT).isNotNull()).collect()
    return {(r[STORE], 10 * r[PRODUCT]): r for r in found}


def test_blank_differs_from_zero(w):
    got = by_pair(w, ["total_sales_qty", "current_stock_qty", "sales_qty_last_90_days"])
    assert got[1, 10].current_stock_qty == 0
    assert got[1, 30].current_stock_qty is None  # sold, never counted
    assert got[2, 20].total_sales_qty is None
    assert got[1, 20].sales_qty_last_90_days is None
    assert (1, 60) not in got and (2, 60) not in got


def test_window_has_ninety_days(w):
    got = by_pair(w, ["sales_qty_last_90_days"])
    assert got[2, 10].sales_qty_last_90_days == 1  # 3 October counts, 2 October does not
    assert got[1, 10].sales_qty_last_90_days == 2


def test_statuses(w):
    got = by_pair(w, ["total_sales_qty", *measures.STATUS, "current_stock_qty"])
    seen = {k: (r.inventory_status, r.stock_record_status, r.sku_lifecycle_status, r.risk_priority_sort, r.dead_stock_flag) for k, r in got.items()}
    assert seen == {
        (1, 10): ("Out of Stock (Active SKU)", "Has Snapshot", "Stable", 3, "Active"),
        (2, 10): ("Healthy", "Has Snapshot", "New Introduction", 5, "Active"),
        (1, 20): ("Dead Stock", "Has Snapshot", "New Introduction", 1, "Dead Stock"),
        (2, 20): ("Discontinued", "Has Snapshot", "Stable", 99, "Active"),
        (1, 30): ("Not Carried", "No Snapshot, Has Sales", "No Inventory Record (DSD?)", 2, None),
        (3, 50): ("Not Carried", "No Snapshot, Has Sales", "No Inventory Record (DSD?)", 2, None),
        (2, 40): ("Healthy", "Has Snapshot", "New Introduction", 5, "Active"),
    }


def test_dead_stock_is_not_additive(w):
    total = evaluate(w, [], ["dead_stock_value", "dead_stock_sku_count"]).first()
    # brand 20 sold nothing lately anywhere; brand 10 sold somewhere
    assert total.dead_stock_value == 60 and total.dead_stock_sku_count == 1
    stores = {r[STORE]: r.dead_stock_value for r in evaluate(w, [STORE], ["dead_stock_value"]).collect()}
    assert stores[1] == 60 and stores[2] is None


def test_totals(w):
    r = evaluate(w, [], measures.ALL).first()
    assert r.total_revenue == 153 and r.total_cogs == 79
    assert r.ending_inventory_value == 163 and r.average_inventory_value == 136.5
    assert r.total_snapshot_records == 8 and r.out_of_stock_records == 3
    assert r.stockout_rate == 0.5  # 0, 0 and -2 of six closing rows
    assert r.unclassified_sku_count == 1 and r.unclassified_inventory_value == Decimal("-2")
    assert r.avg_daily_sales_qty == round(23 / 7, 4)


def _deviation(daily, days):
    mean = sum(daily) / len(daily)
    return math.sqrt(sum((x - mean) ** 2 for x in daily + [0] * (days - len(daily))) / days)


def test_reorder_point(w):
    r = by_pair(w, measures.DAILY)[1, 10]
    sd = _deviation([4, 2], 366)
    assert r.stddev_daily_sales_qty == pytest.approx(sd, abs=1e-4)
    assert r.safety_stock_qty == pytest.approx(1.65 * sd * math.sqrt(7), abs=1e-4)
    assert r.reorder_point_qty == round(3 * 7 + 1.65 * sd * math.sqrt(7))
    plain = by_pair(w, measures.DAILY, params=Replenishment(deviation="active_days"))[1, 10]
    assert plain.stddev_daily_sales_qty == pytest.approx(1.0)


def test_alert_limits(spark):
    cases = [("0", 10.0), ("10", 10.0), ("12", 10.0), ("12.01", 10.0), (None, 10.0), ("5", None), ("-1", 10.0)]
    df = spark.createDataFrame(
        [(i, None if s is None else Decimal(s), r) for i, (s, r) in enumerate(cases)],
        "i int, stock decimal(10,2), rop double",
    )
    code = labels.alert_code(F.col("stock"), F.col("rop"))
    assert [r[0] for r in df.orderBy("i").select(code).collect()] == [1, 2, 3, 4, 4, 4, 1]


def test_alerts_take_the_most_urgent_store(w):
    got = {10 * r[PRODUCT]: r.reorder_alert for r in evaluate(w, [PRODUCT], ["reorder_alert"]).filter(F.col(PRODUCT).isNotNull()).collect()}
    # brand 10 is empty in store 1; brand 30 has no stock record, so no alert at all;
    # brand 40 never sold, so its point is unknown
    assert got == {10: "Out of Stock", 20: "Out of Stock", 30: None, 40: "OK", 50: None}
    sort = {10 * r[PRODUCT]: r.reorder_alert_sort for r in evaluate(w, [PRODUCT], ["reorder_alert_sort"]).filter(F.col(PRODUCT).isNotNull()).collect()}
    assert sort[10] == 1 and sort[30] == 5


def test_months(w):
    got = {r[MONTH]: r for r in evaluate(w, [MONTH], ["total_revenue", "beginning_inventory_value", "sales_qty_last_90_days"]).collect()}
    assert got["2016-01"].total_revenue == 40 and got["2016-01"].beginning_inventory_value == 110
    # the window reaches back over month ends
    assert got["2016-12"].sales_qty_last_90_days == 11
    ytd = {r[MONTH]: r for r in measures.turnover_ytd(w).collect()}
    assert len(ytd) == 12
    # until December only the opening count is in range
    assert ytd["2016-06"].inventory_turnover_ytd == round(24 / (110 / 2), 4)
    assert ytd["2016-12"].inventory_turnover_ytd == round(79 / 136.5, 4)


def test_slicers(w):
    one = evaluate(w, [], ["total_revenue", "sales_qty_last_90_days"], Slice(years=(2016,), months=(11,))).first()
    assert one.total_revenue is None and one.sales_qty_last_90_days == 6
    store = evaluate(w, [], ["total_revenue", "ending_inventory_value"], Slice(stores=(2,))).first()
    assert store.total_revenue == 60 and store.ending_inventory_value == 103
    classes = evaluate(w, [CLASS], ["total_revenue"], Slice(abc_classes=("A", "B"))).collect()
    assert {r[CLASS] for r in classes} == {"A", "B"}
    vendor = evaluate(w, [], ["total_revenue", "ending_inventory_value"], Slice(vendors=(3,))).first()
    assert vendor.total_revenue is None and vendor.ending_inventory_value == 163
    assert evaluate(w, [], ["total_revenue"], Slice(brands=(20,))).first().total_revenue == 15


def test_unknown_grain_is_refused(w):
    with pytest.raises(ValueError):
        evaluate(w, ["vendor_sk"], ["total_revenue"])


def test_report_order(w):
    got = [(r.store_number, r.brand) for r in reports.risk_detail(w).collect() if r.brand]
    assert got == [(1, 20), (1, 30), (1, 10), (2, 10), (2, 40), (2, 20), (3, 50)]
    alerts = [r.reorder_alert_sort for r in reports.replenish_matrix(w).collect()]
    assert alerts == sorted(alerts)
    # every known product in stock has sold in its store; what is unknown is cleared too
    assert all(r.brand is None for r in reports.dead_stock_clearance(w).collect())


def test_product_rows_add_up_to_the_total(w):
    names = ["total_revenue", "total_cogs", "ending_inventory_value", "total_snapshot_records"]
    rows = evaluate(w, [PRODUCT], names).collect()
    total = evaluate(w, [], names).first()
    assert any(r[PRODUCT] is None for r in rows)
    for n in names:
        assert sum(r[n] for r in rows if r[n] is not None) == total[n]


def test_year_to_date_counts_months_that_are_not_shown(w):
    whole = {r[MONTH]: r for r in measures.turnover_ytd(w).collect()}
    shown = measures.turnover_ytd(w, Slice(months=(12,))).collect()
    assert [r[MONTH] for r in shown] == ["2016-12"] and shown[0] == whole["2016-12"]


def test_days_and_single_sales_give_the_same(w):
    every_vendor = tuple(r[0] for r in w.table("dim_vendor").select("vendor_number").collect())
    names = ["total_revenue", "total_sales_qty", "total_cogs", *measures.DAILY]
    sold = F.col("total_sales_qty").isNotNull() & F.col(PRODUCT).isNotNull()
    by_day = evaluate(w, [PRODUCT, STORE], names).filter(sold)
    single = evaluate(w, [PRODUCT, STORE], names, Slice(vendors=every_vendor)).filter(sold)
    assert sorted(map(tuple, by_day.collect())) == sorted(map(tuple, single.collect()))


def test_quadrants(spark):
    df = spark.createDataFrame([(0.06, 0.04), (0.06, 0.03), (0.05, 0.04), (0.05, None)], "s double, d double")
    got = [r[0] for r in df.select(labels.risk_quadrant(F.col("s"), F.col("d"))).collect()]
    assert got == list(labels.QUADRANTS)


def test_snapshot_probe_of_one_pair(w):
    found = snapshot_probe(
        w.table("fact_inventory_snapshot"), w.table("dim_store"), w.table("dim_product"), 1, 10
    ).collect()
    assert {(r.snapshot_type, r.n, int(r.qty)) for r in found} == {("BEGINNING", 1, 8), ("ENDING", 1, 0)}


@pytest.mark.parametrize("where", [Slice(), Slice(months=(10, 11, 12)), Slice(stores=(1,)), Slice(abc_classes=("A",))])
def test_levels_are_the_measures_of_their_grain(w, where):
    """One pass over the facts gives what one evaluation for each grain gives."""
    names = ["current_stock_qty", *DAILY, "reorder_alert", "reorder_alert_sort", *STOCK_VS_ROP]
    levels = evaluate_levels(w, names, where).cache()
    for level, grain in ((CLASS, [CLASS]), (PRODUCT, [PRODUCT]), (STORE, [PRODUCT, STORE])):
        of_level = levels.filter(levels[LEVEL] == level).select(*grain, *names).collect()
        alone = evaluate(w, grain, names, where).collect()
        assert sorted(map(str, of_level)) == sorted(map(str, alone)) and alone


def test_levels_refuse_other_measures(w):
    with pytest.raises(ValueError, match="dead_stock_value"):
        evaluate_levels(w, ["dead_stock_value"])


@pytest.mark.parametrize("grain", [[PRODUCT], [PRODUCT, STORE], [PRODUCT, CLASS, MONTH]], ids=str)
@pytest.mark.parametrize("where", [Slice(), Slice(months=(10, 11, 12), stores=(1, 2))], ids=["all", "some"])
def test_products_count_by_their_own_alert(w, grain, where):
    """Beside an alert the count of a product is read off its row, and is the count by itself."""
    both = evaluate(w, grain, ["reorder_alert", "reorder_sku_count"], where)
    alone = evaluate(w, grain, ["reorder_sku_count"], where)
    counted = [df.select(*grain, "reorder_sku_count").filter("reorder_sku_count IS NOT NULL") for df in (both, alone)]
    assert sorted(map(str, counted[0].collect())) == sorted(map(str, counted[1].collect()))
    assert both.schema["reorder_sku_count"].dataType == alone.schema["reorder_sku_count"].dataType
    if grain == [PRODUCT, STORE] and where == Slice():
        assert {r.reorder_sku_count for r in both.collect()} == {None, 1}


def test_the_count_beside_an_alert_asks_for_no_more_shuffles(w):
    def exchanges(*names):
        text = evaluate(w, [PRODUCT, STORE], [*names])._jdf.queryExecution().executedPlan().toString()
        return text.count("Exchange")

    assert exchanges("reorder_alert", "reorder_sku_count") == exchanges("reorder_alert")
