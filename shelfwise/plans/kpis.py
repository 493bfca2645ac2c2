"""Headline inventory KPIs over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import BEST_SELLERS_N, DSI_DAYS
from shelfwise.functions.casting import ratio, rounded, safe_divide
from shelfwise.plans.marts import BEGINNING, ENDING

PAIR = ["product_sk", "store_sk"]


def sales_totals(fact_sales: DataFrame) -> DataFrame:
    return fact_sales.agg(
        F.round(F.sum("sales_dollars"), 0).cast("decimal(28,0)").alias("total_sales_revenue"),
        F.sum("sales_quantity").cast("decimal(28,2)").alias("total_sales_qty"),
        F.min("sales_date").alias("date_start"),
        F.max("sales_date").alias("date_end"),
    )


def _value(kind: str) -> Column:
    return F.sum(F.when(F.col("snapshot_type") == kind, F.col("total_inventory_value")))


def inventory_values(snapshot: DataFrame) -> DataFrame:
    """Opening and closing value in one pass."""
    return snapshot.agg(
        _value(BEGINNING).cast("decimal(28,4)").alias("beg"),
        _value(ENDING).cast("decimal(28,4)").alias("end"),
    )


def turnover_dsi(fact_sales: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Single sales or their sums by day give the same."""
    cogs = fact_sales.agg(F.sum("estimated_cogs").cast("decimal(28,4)")).scalar()
    average = (F.col("beg") + F.col("end")).cast("double") / 2
    turnover = safe_divide(F.col("cogs"), average)
    return (
        inventory_values(snapshot)
        .withColumn("cogs", cogs)
        .select(
            F.round("cogs", 0).cast("decimal(28,0)").alias("total_cogs"),
            F.round("beg", 0).cast("decimal(28,0)").alias("beg_inventory_value"),
            F.round("end", 0).cast("decimal(28,0)").alias("end_inventory_value"),
            F.round((F.col("beg") + F.col("end")) / 2, 0)
            .cast("decimal(28,0)")
            .alias("avg_inventory_value"),
            rounded(turnover, 2).alias("inventory_turnover"),
            ratio(F.lit(DSI_DAYS), turnover, 1).alias("dsi_days"),
        )
    )


def ending_positions(snapshot: DataFrame) -> DataFrame:
    return (
        snapshot.filter(F.col("snapshot_type") == ENDING)
        .groupBy(*PAIR)
        .agg(F.sum("quantity_on_hand").alias("end_qty"))
    )


def unsold_flagged(fact_sales: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Ending positions with ``sold`` NULL where the pair never sold.

    Both sides are already grouped by the pair, so the join needs no further shuffle.
    """
    sold = fact_sales.select(*PAIR).distinct().withColumn("sold", F.lit(True))
    return ending_positions(snapshot).join(sold, PAIR, "left")


def stockout_rate(snapshot: DataFrame) -> DataFrame:
    empty = F.count_if(F.col("end_qty") == 0)
    return ending_positions(snapshot).agg(
        F.count(F.lit(1)).alias("total_sku_store_combos"),
        empty.alias("stockout_count"),
        ratio(empty * 100, F.count(F.lit(1)), 2).alias("stockout_rate_pct"),
    )


def dead_stock(fact_sales: DataFrame, snapshot: DataFrame) -> DataFrame:
    dead = F.col("sold").isNull() & (F.col("end_qty") > 0)
    units = F.sum(F.when(dead, F.col("end_qty")).otherwise(F.lit(0).cast("decimal(10,2)")))
    return unsold_flagged(fact_sales, snapshot).agg(
        F.count(F.lit(1)).alias("total_ending_positions"),
        F.count_if(dead).alias("dead_stock_count"),
        ratio(F.count_if(dead) * 100, F.count(F.lit(1)), 2).alias(
            "dead_stock_pct"
        ),
        F.round(units, 0).cast("decimal(28,0)").alias("dead_stock_total_units"),
    )


def best_sellers(
    fact_sales: DataFrame, dim_product: DataFrame, abc_class: str = "A", top: int = BEST_SELLERS_N
) -> DataFrame:
    """Top products of a class by revenue; the price is averaged over sales rows.

    Sales are reduced to one row per product before they meet the dimension.
    """
    per_product = fact_sales.groupBy("product_sk").agg(
        F.sum("sales_dollars").alias("revenue"),
        F.sum("sales_quantity").alias("qty"),
        F.sum("sales_price").alias("price_sum"),
        F.count("sales_price").alias("price_rows"),
    )
    wanted = dim_product.filter(F.col("abc_class") == abc_class).select(
        "product_sk", "brand", "description", "abc_class"
    )
    return (
        per_product.join(wanted, "product_sk")
        .select(
            "brand",
            "description",
            "abc_class",
            F.round("revenue", 0).cast("decimal(28,0)").alias("total_revenue"),
            F.col("qty").cast("decimal(28,2)").alias("total_qty_sold"),
            ratio(F.col("price_sum"), F.col("price_rows"), 2).alias(
                "avg_selling_price"
            ),
        )
        .orderBy(F.desc("total_revenue"), "brand")
        .limit(top)
    )
