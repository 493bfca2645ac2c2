"""Datasets behind the report pages; each visual is one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import DSI_DAYS, REORDER_WEEKS
from shelfwise.functions.casting import ratio, rounded, safe_divide
from shelfwise.functions.labels import (
    abc_display,
    abc_priority_group,
    abc_sort,
    alert_label,
    risk_quadrant,
)
from shelfwise.operators.ordered import number_rows
from shelfwise.operators.presented import ALL_IN_ORDER, Presentation
from shelfwise.plans import kpis
from shelfwise.plans.marts import sales_month
from shelfwise.plans.measures import (
    CLASS,
    LEVEL,
    MONTH,
    PRODUCT,
    STORE,
    Context,
    Slice,
    evaluate,
    evaluate_levels,
    product_alerts,
)
from shelfwise.plans.warehouse import Warehouse

BOTTOM_SHARE = 5  # the lowest fifth


def _store_numbers(w: Warehouse) -> DataFrame:
    return w.table("dim_store").select(STORE, "store_number")


def _by_store(w: Warehouse, names: list[str], where: Slice) -> DataFrame:
    rows = evaluate(w, [STORE], names, where)
    return rows.join(_store_numbers(w), STORE, "left").select("store_number", *names)


def _product_names(w: Warehouse, *columns: str | Column) -> DataFrame:
    """To be joined from the left: facts of unknown products keep a row, with NULL names."""
    return w.table("dim_product").select(PRODUCT, *columns)


def exec_cards(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    return evaluate(
        w, [], ["inventory_turnover", "dsi_days", "stockout_rate", "dead_stock_pct"], where
    )


def monthly_trend(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    return evaluate(w, [MONTH], ["total_revenue", "total_cogs"], where).orderBy(MONTH)


def stockout_by_store(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    rows = _by_store(w, ["stockout_rate"], where).filter(F.col("stockout_rate").isNotNull())
    return rows.orderBy(F.desc("stockout_rate"), "store_number")


def dead_stock_by_abc(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    rows = evaluate(w, [CLASS], ["dead_stock_value"], where)
    return rows.filter(F.col("dead_stock_value").isNotNull()).orderBy(CLASS)


def store_abc_matrix(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    """Store by class with subtotals. These five are sums or ratios of sums, so a
    rollup of the sums at the finest level serves every level."""
    sums = [
        "total_revenue",
        "total_cogs",
        "beginning_inventory_value",
        "ending_inventory_value",
        "ending_rows",
        "ending_out_of_stock_rows",
    ]
    levels = (
        evaluate(w, [STORE, CLASS], sums, where)
        .rollup(STORE, CLASS)
        .agg(F.grouping_id().alias("gid"), *[F.sum(c).alias(c) for c in sums])
    )
    zero = F.lit(0).cast("decimal(28,4)")
    beg, end = F.col("beginning_inventory_value"), F.col("ending_inventory_value")
    average = F.when(
        beg.isNotNull() | end.isNotNull(),
        (F.coalesce(beg, zero) + F.coalesce(end, zero)).cast("double") / 2,
    )
    turnover = safe_divide(F.col("total_cogs"), average)
    level = F.when(F.col("gid") == 0, "class").when(F.col("gid") == 1, "store").otherwise("total")
    return (
        levels.join(_store_numbers(w), STORE, "left")
        .select(
            level.alias("level"),
            "store_number",
            CLASS,
            F.col("total_revenue").cast("decimal(28,2)").alias("total_revenue"),
            end.cast("decimal(28,4)").alias("ending_inventory_value"),
            rounded(turnover).alias("inventory_turnover"),
            ratio(F.lit(DSI_DAYS), turnover).alias("dsi_days"),
            ratio(F.col("ending_out_of_stock_rows"), F.col("ending_rows")).alias("stockout_rate"),
        )
        .orderBy(F.asc_nulls_last("store_number"), "level", F.asc_nulls_last(CLASS))
    )


def risk_cards(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    names = ["dead_stock_value", "dead_stock_sku_count", "out_of_stock_records"]
    return evaluate(w, [], names, where)


def store_risk_quadrant(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    rows = _by_store(w, ["stockout_rate", "dead_stock_pct", "ending_inventory_value"], where)
    return (
        rows.filter(F.col("ending_inventory_value").isNotNull())
        .withColumn("quadrant", risk_quadrant(F.col("stockout_rate"), F.col("dead_stock_pct")))
        .orderBy("store_number")
    )


def dead_stock_by_store(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    rows = _by_store(w, ["dead_stock_value"], where)
    return rows.filter(F.col("dead_stock_value").isNotNull()).orderBy(
        F.desc("dead_stock_value"), "store_number"
    )


def risk_detail(
    w: Warehouse, where: Slice = Slice(), shown: Presentation = ALL_IN_ORDER
) -> DataFrame:
    """Every store and SKU with stock or sales records, the riskiest first per store."""
    names = [
        "current_stock_qty",
        "sales_qty_last_90_days",
        "dead_stock_value",
        "dead_stock_flag",
        "inventory_status",
        "stock_record_status",
        "sku_lifecycle_status",
        "risk_priority_sort",
    ]
    rows = evaluate(w, [PRODUCT, STORE], ["total_sales_qty", *names], where)
    named = rows.join(_product_names(w, "brand", abc_display().alias(CLASS)), PRODUCT, "left").join(
        _store_numbers(w), STORE, "left"
    )
    riskiest = [
        F.asc("store_number"),
        F.asc("risk_priority_sort"),
        F.desc_nulls_last("dead_stock_value"),
        F.desc_nulls_last("sales_qty_last_90_days"),
        F.asc("brand"),
    ]
    return shown.of(named.select("store_number", "brand", CLASS, *names), riskiest)


def replenish_cards(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    names = ["reorder_sku_count", "avg_daily_sales_qty", "ending_inventory_value"]
    return evaluate(w, [], names, where)


def rop_gap(w: Warehouse, where: Slice = Slice(), shown: Presentation = ALL_IN_ORDER) -> DataFrame:
    """Every store and SKU, the largest lack of stock first."""
    names = ["current_stock_qty", "reorder_point_qty", "stock_vs_rop_gap"]
    rows = evaluate(w, [PRODUCT, STORE], names, where)
    named = (
        rows.filter(F.col("stock_vs_rop_gap").isNotNull())
        .join(_product_names(w, "brand"), PRODUCT, "left")
        .join(_store_numbers(w), STORE, "left")
        .select("store_number", "brand", *names)
    )
    return shown.of(named, [F.asc("stock_vs_rop_gap"), F.asc("store_number"), F.asc("brand")])


def reorder_by_abc(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    """SKUs per class and alert, in class order."""
    alerts = product_alerts(Context(w, [], where), w.settings.replenishment)
    return (
        alerts.filter(F.col("alert_code").isNotNull())
        .join(_product_names(w, "abc_class"), PRODUCT)
        .groupBy("abc_class", "alert_code")
        .agg(F.count(F.lit(1)).alias("sku_count"))
        .select(
            F.coalesce("abc_class", F.lit("Unclassified")).alias(CLASS),
            abc_sort().alias("abc_class_sort"),
            alert_label(F.col("alert_code")).alias("reorder_alert"),
            "sku_count",
        )
        .orderBy("abc_class_sort", "reorder_alert")
    )


def top_reorder(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    alerts = product_alerts(Context(w, [], where), w.settings.replenishment)
    return (
        alerts.filter(F.col("alert_code") == 2)
        .join(_product_names(w, "brand"), PRODUCT)
        .select("brand", rounded(F.col("reorder_point_qty")).alias("reorder_point_qty"))
        .orderBy(F.desc("reorder_point_qty"), "brand")
    )


REPLENISHMENT = [
    "current_stock_qty",
    "avg_daily_sales_qty",
    "safety_stock_qty",
    "reorder_point_qty",
    "reorder_alert",
    "reorder_alert_sort",
    "days_of_stock_remaining",
    "stock_vs_rop_gap",
]


def replenish_matrix(
    w: Warehouse, where: Slice = Slice(), shown: Presentation = ALL_IN_ORDER
) -> DataFrame:
    """Priority group, brand and store, with subtotals evaluated at their own level:
    a reorder point of a group is not the sum of those of its stores."""
    brands = _product_names(w, "brand", "abc_class").select(
        PRODUCT, "brand", abc_priority_group().alias("group_of_brand")
    )
    of_class = F.col(LEVEL) == CLASS
    known_class = F.when(F.col(CLASS) != "Unclassified", F.col(CLASS)).alias("abc_class")
    level = F.when(of_class, "group").when(F.col(LEVEL) == STORE, "store").otherwise("brand")
    rows = evaluate_levels(w, REPLENISHMENT, where).select("*", known_class, level.alias("level"))
    group_of_class = F.when(F.col(CLASS).isNotNull(), abc_priority_group())
    named = (
        rows.join(brands, PRODUCT, "left")
        .join(_store_numbers(w), STORE, "left")
        .select(
            "level",
            F.when(of_class, group_of_class).otherwise(F.col("group_of_brand")).alias("abc_priority_group"),
            "brand",
            "store_number",
            *REPLENISHMENT,
        )
    )
    most_urgent = [
        F.asc_nulls_last("reorder_alert_sort"),
        F.asc_nulls_last("stock_vs_rop_gap"),
        F.desc_nulls_last("avg_daily_sales_qty"),
        F.asc("abc_priority_group"),
        F.asc_nulls_first("brand"),
        F.asc_nulls_first("store_number"),
    ]
    return shown.of(named, most_urgent)


def sku_detail(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    """The tooltip of a SKU; ``Slice(brands=(...,))`` narrows it to one."""
    names = [
        "avg_daily_sales_qty",
        "safety_stock_qty",
        "reorder_point_qty",
        "current_stock_qty",
        "reorder_alert",
    ]
    rows = evaluate(w, [PRODUCT], names, where)
    labelled = _product_names(w, "brand", "abc_class").select(
        PRODUCT, "brand", abc_priority_group().alias("abc_priority_group")
    )
    return rows.join(labelled, PRODUCT, "left").select("brand", "abc_priority_group", *names)


def sliced_by_store(w: Warehouse, where: Slice) -> DataFrame:
    """Store figures under slicers on date, class, store or brand."""
    names = [
        "total_revenue",
        "total_sales_qty",
        "ending_inventory_value",
        "sales_qty_last_90_days",
        "dead_stock_value",
        "avg_daily_sales_qty",
    ]
    return _by_store(w, names, where).orderBy("store_number")


def inventory_growth(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    beg, end = F.col("beg"), F.col("end")
    return kpis.inventory_values(Context(w, [], where).snapshot()).select(
        beg.alias("beginning_inventory_value"),
        end.alias("ending_inventory_value"),
        (end - beg).cast("decimal(28,4)").alias("inventory_growth"),
        ratio((end - beg) * 100, beg).alias("inventory_growth_pct"),
    )


def monthly_share(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    """Share and rank of each month in its year, and the share of the best two.

    The windows run over the at most twelve month rows of a year.
    """
    months = evaluate(w, [MONTH], ["total_revenue"], where).filter(
        F.col("total_revenue").isNotNull() & F.col(MONTH).isNotNull()
    )
    year = Window.partitionBy("year")
    best = year.orderBy(F.desc("total_revenue"), MONTH)
    worst = year.orderBy("total_revenue", MONTH)
    of_year = F.sum("total_revenue").over(year)
    top_two = F.sum(F.when(F.col("peak_rank") <= 2, F.col("total_revenue"))).over(year)
    return (
        months.withColumn("year", F.substring(MONTH, 1, 4).cast("int"))
        .withColumn("peak_rank", F.row_number().over(best))
        .withColumn("trough_rank", F.row_number().over(worst))
        .select(
            MONTH,
            "total_revenue",
            ratio(F.col("total_revenue"), of_year).alias("share_of_year"),
            "peak_rank",
            "trough_rank",
            ratio(top_two, of_year).alias("top_two_share"),
        )
        .orderBy(MONTH)
    )


def store_revenue_rank(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    rows = _by_store(w, ["total_revenue"], where).filter(F.col("total_revenue").isNotNull())
    order = [F.desc("total_revenue"), F.asc_nulls_last("store_number")]
    return number_rows(rows, order, "revenue_rank").orderBy("revenue_rank")


def sku_week_run_rate(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    """Weekly revenue at stake per SKU, and the stock level that should trigger an order."""
    weeks = F.lit(w.settings.period.weeks)
    rows = evaluate(w, [PRODUCT], ["total_revenue", "total_sales_qty"], where)
    velocity = safe_divide(F.col("total_sales_qty"), weeks)
    return (
        rows.filter(F.col("total_revenue").isNotNull())
        .join(_product_names(w, "brand"), PRODUCT, "left")
        .select(
            "brand",
            "total_revenue",
            ratio(F.col("total_revenue"), weeks).alias("revenue_per_week"),
            rounded(velocity).alias("qty_per_week"),
            rounded(velocity * REORDER_WEEKS).alias("reorder_trigger_qty"),
        )
    )


def bottom_c_class(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    """Class C products in the lowest fifth by revenue without a sale in the last calendar
    quarter of the period. Sold and returned is sold."""
    rows = evaluate(
        w, [PRODUCT], ["total_revenue"], where
    )
    class_c = rows.join(
        _product_names(w, "brand", "abc_class").filter(F.col("abc_class") == "C"), PRODUCT
    ).filter(F.col("total_revenue").isNotNull())
    placed = number_rows(
        class_c, [F.asc("total_revenue"), F.asc(PRODUCT)], "velocity_rank", "class_size"
    )
    period = w.settings.period
    day = F.col("sales_date")
    lately = (
        Context(w, [PRODUCT], where)
        .all_sales()
        .filter((day >= F.lit(period.last_quarter_start)) & (day <= F.lit(period.end)))
        .filter(F.col("sales_month") >= sales_month(F.lit(period.last_quarter_start)))
        .select(PRODUCT)
        .distinct()
    )
    slow = placed.filter(F.col("velocity_rank") * BOTTOM_SHARE <= F.col("class_size"))
    return slow.join(lately, PRODUCT, "left_anti").select("brand", "total_revenue", "velocity_rank")


def dead_stock_clearance(w: Warehouse, where: Slice = Slice()) -> DataFrame:
    """Stock of pairs that never sold, in clearing order. For class A and B goods, how
    many other stores sell the SKU and which sells most: one row per SKU is joined,
    not one per pair of stores."""
    ctx = Context(w, [], where)
    dead = kpis.unsold_flagged(ctx.sales(), ctx.snapshot()).filter(F.col("sold").isNull() & (F.col("end_qty") > 0))
    sold_at = (
        ctx.sales()
        .groupBy(PRODUCT, STORE)
        .agg(F.sum("sales_quantity").alias("qty"))
        .join(_store_numbers(w), STORE)
    )
    sellers = sold_at.groupBy(PRODUCT).agg(
        F.count(F.lit(1)).alias("selling_stores"),
        F.max(F.struct("qty", (-F.col("store_number")).alias("minus_store"))).alias("best"),
    )
    movable = F.col("abc_class").isin("A", "B")
    step = (
        F.when(F.col("abc_class") == "C", 1).when(F.col("abc_class").isNull(), 2).otherwise(3)
    )
    return (
        dead.join(_product_names(w, "brand", "abc_class", abc_display().alias(CLASS)), PRODUCT, "left")
        .join(_store_numbers(w), STORE, "left")
        .join(sellers, PRODUCT, "left")
        .select(
            "store_number",
            "brand",
            CLASS,
            F.col("end_qty").cast("decimal(28,2)").alias("dead_units"),
            step.alias("clearance_step"),
            F.when(movable, F.col("selling_stores")).alias("selling_stores"),
            F.when(movable, -F.col("best.minus_store")).alias("transfer_to_store"),
        )
        .orderBy("clearance_step", F.desc("dead_units"), "store_number", "brand")
    )
