"""Static ABC (Pareto) classes of the products by cumulative revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import ABC_A_MAX_PCT, ABC_B_MAX_PCT
from shelfwise.functions.casting import ratio
from shelfwise.operators.ordered import ROWS_PER_RANGE, running_total

PCT_DIGITS = 4


def product_revenue(fact_sales: DataFrame) -> DataFrame:
    """Sales of unknown products form a group of their own and share in the total.

    Single sales or their sums by day give the same."""
    return (
        fact_sales.filter(F.col("sales_dollars").isNotNull())
        .groupBy("product_sk")
        .agg(F.sum("sales_dollars").cast("decimal(22,2)").alias("total_sales_dollars"))
    )


def revenue_by_brand(sales: DataFrame, products: DataFrame) -> DataFrame:
    """``product_revenue`` of staged sales, which shrink to their brands before they meet the
    products; it waits for no sales mart."""
    per_brand = (
        sales.filter(F.col("sales_dollars").isNotNull())
        .groupBy("brand")
        .agg(F.sum("sales_dollars").alias("sales_dollars"))
    )
    return product_revenue(per_brand.join(products.select("product_sk", "brand"), "brand", "left"))


def exact_pct(part: Column, whole: Column, digits: int = PCT_DIGITS) -> Column:
    """100 * part / whole, rounded half away from zero, in whole-number arithmetic.

    A decimal quotient would be cut to six places before it is rounded.
    """
    unit = 10**digits
    a, b = F.abs(part), F.abs(whole)
    scaled = F.call_function("div", a * F.lit(200 * unit) + b, b * F.lit(2))
    sign = F.signum(part.cast("double")) * F.signum(whole.cast("double"))
    return F.when(whole != 0, sign * scaled.cast("double") / F.lit(float(unit)))


def with_running_total(revenue: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Grand total, cumulative revenue and percent; ties in product order."""
    order = [F.desc_nulls_last("total_sales_dollars"), F.asc_nulls_last("product_sk")]
    summed = running_total(
        revenue,
        order,
        "total_sales_dollars",
        "cumulative_sales",
        "grand_total",
        rows_per_range,
    )
    return summed.withColumn(
        "cumulative_pct", exact_pct(F.col("cumulative_sales"), F.col("grand_total"))
    )


def labels(running: DataFrame) -> DataFrame:
    """The product that crosses a limit already belongs to the next class."""
    pct = F.col("cumulative_pct")
    return running.select(
        "product_sk",
        "cumulative_pct",
        F.when(pct <= ABC_A_MAX_PCT, "A")
        .when(pct <= ABC_B_MAX_PCT, "B")
        .otherwise("C")
        .alias("abc_class"),
    )


def classified(products: DataFrame, abc_labels: DataFrame) -> DataFrame:
    """The product dimension with its class; unsold products keep NULL."""
    return products.join(abc_labels.select("product_sk", "abc_class"), "product_sk", "left")


def _share_of_all(count: Column) -> Column:
    """Percent of the grand total; the window sees one row per class."""
    return ratio(count * 100, F.sum(count).over(Window.partitionBy()), 2)


def class_summary(dim_product: DataFrame) -> DataFrame:
    per_class = dim_product.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("sku_count"),
        F.round(F.sum("default_retail_price"), 2).alias("sample_value"),
    )
    return per_class.select(
        "abc_class",
        "sku_count",
        _share_of_all(F.col("sku_count")).alias("sku_pct"),
        "sample_value",
    ).orderBy(F.asc_nulls_last("abc_class"))


def class_distribution(dim_product: DataFrame) -> DataFrame:
    margin = F.col("default_gross_margin_pct")
    per_class = dim_product.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("sku_count"),
        ratio(F.sum(margin), F.count(margin), 2).alias("avg_gross_margin_pct"),
    )
    return per_class.select(
        "abc_class",
        "sku_count",
        _share_of_all(F.col("sku_count")).alias("sku_pct"),
        "avg_gross_margin_pct",
    ).orderBy(F.asc_nulls_last("abc_class"))
