"""Star schema: four dimensions, two facts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.labels import abc_display, abc_priority_group, abc_sort
from shelfwise.operators.ordered import ROWS_PER_RANGE, number_rows

# Snapshot types and the width names are padded to.
BEGINNING, ENDING = "BEGINNING", "ENDING"
NAME_WIDTH = 9

# the sets of keys that daily moments are kept for
MOMENT_KEYS = [
    [],
    ["store_sk"],
    ["abc_class_display"],
    ["abc_class_display", "store_sk"],
    ["product_sk"],
    ["product_sk", "store_sk"],
]
# those that the measures read; a product in a store has hardly more days than months
COARSE_KEYS, PRODUCT_KEYS = MOMENT_KEYS[:-2], MOMENT_KEYS[-2:-1]


def _latest_name_per_key(tables: list[DataFrame], key: str, name: str) -> DataFrame:
    """The greatest name per key over all tables.

    Duplicates go first, by hash and before the shuffle: the maximum of a text sorts its
    input, which then is a few rows per key instead of every row of the facts.
    """
    rows = reduce(
        DataFrame.unionByName,
        [t.select(F.col(key), F.col(name)).filter(F.col(key).isNotNull()) for t in tables],
    )
    return rows.distinct().groupBy(key).agg(F.max(name).alias(name))


def dim_vendor(
    purchases: DataFrame, sales: DataFrame, invoices: DataFrame, prices: DataFrame
) -> DataFrame:
    vendors = _latest_name_per_key(
        [purchases, sales, invoices, prices], "vendor_number", "vendor_name"
    )
    return number_rows(vendors, [F.asc("vendor_number")], "vendor_sk")


def dim_store(beginning: DataFrame, ending: DataFrame, sales: DataFrame) -> DataFrame:
    unnamed = sales.select("store", F.lit(None).cast("string").alias("city"))
    stores = _latest_name_per_key([beginning, ending, unnamed], "store", "city")
    return number_rows(stores, [F.asc("store")], "store_sk").withColumnRenamed(
        "store", "store_number"
    )


def product_base(
    prices: DataFrame, sales: DataFrame, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """One row per brand of the price list or of the sales, without a class yet."""
    return number_rows(
        product_rows(prices, sales),
        [F.asc_nulls_last("brand")],
        "product_sk",
        rows_per_range=rows_per_range,
    )


def product_rows(prices: DataFrame, sales: DataFrame) -> DataFrame:
    """Products without their key.

    Means the same as a full outer join of the price list with sales per brand, the
    price list's attributes coming first: a brand's sales fill in when it has no
    listed row, or a listed row lacks the attribute. Sales are reduced by hash to their
    different texts, each with the greatest numbers, so that a brand seldom has more than one
    row left; then both sides are grouped together once.
    """
    shared = ["description", "size", "volume_ml", "classification"]
    priced_only = ["retail_price", "purchase_price", "gross_margin_pct"]
    listed = prices.select(
        "brand",
        F.lit(True).alias("listed"),
        *[F.col(c).alias(f"p_{c}") for c in shared],
        *priced_only,
    )
    texts, numbers = shared[:2], shared[2:]
    sold = (
        sales.filter(F.col("brand").isNotNull())
        .groupBy("brand", *[F.col(c).alias(f"s_{c}") for c in texts])
        .agg(*[F.max(c).alias(f"s_{c}") for c in numbers])
        .withColumn("listed", F.lit(False))
    )

    def merged(c: str) -> Column:
        from_list, from_sales = F.max(f"p_{c}"), F.max(f"s_{c}")
        gap = F.bool_or(F.col("listed") & F.col(f"p_{c}").isNull())
        fill = F.when(~F.bool_or("listed") | gap, from_sales)
        return F.greatest(from_list, fill).alias(c)

    return (
        listed.unionByName(sold, allowMissingColumns=True)
        .groupBy("brand")
        .agg(
            *[merged(c) for c in shared],
            F.max("retail_price").alias("default_retail_price"),
            F.max("purchase_price").alias("default_cost_price"),
            F.max("gross_margin_pct").alias("default_gross_margin_pct"),
        )
    )


def _at_cost(sales: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Sales with the keys of product and store (NULL where unknown) and the product's cost.

    No broadcast hint: the dimensions are written tables, so the planner knows their
    size and broadcasts those below its threshold; larger ones take a sort-merge join
    whose skewed partitions are split at run time.
    """
    costs = products.select("product_sk", "brand", F.col("default_cost_price").alias("cost"))
    return sales.join(costs, "brand", "left").join(
        stores.select("store_sk", F.col("store_number").alias("store")), "store", "left"
    )


def fact_sales(
    sales: DataFrame, products: DataFrame, stores: DataFrame, vendors: DataFrame
) -> DataFrame:
    """Every staged sale with its surrogate keys (NULL where unknown) and estimated cost."""
    return (
        _at_cost(sales, products, stores)
        .join(vendors.select("vendor_sk", "vendor_number"), "vendor_number", "left")
        .select(
            "product_sk",
            "store_sk",
            "vendor_sk",
            "inventory_id",
            "sales_date",
            "sales_quantity",
            "sales_price",
            "sales_dollars",
            "excise_tax",
            _cogs().alias("estimated_cogs"),
        )
    )


def _cogs() -> Column:
    """The cost of a sale; that of an unknown product is 0."""
    return F.col("sales_quantity") * F.coalesce(F.col("cost"), F.lit(0).cast("decimal(10,2)"))


def sales_month(day: Column) -> Column:
    """Partition key of the stored sales fact, e.g. 201603."""
    return (F.year(day) * 100 + F.month(day)).cast("int")


def daily_sales(stored_sales: DataFrame) -> DataFrame:
    """Sales by product, store and day. Every sum of the measures is one of these sums, so
    reports that do not ask for vendors read this instead of the single sales."""
    return _by_day(stored_sales.repartitionByRange("sales_month", "product_sk"))


def daily_sales_of(sales: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """``daily_sales`` of staged sales. Vendors, inventory numbers and prices are in none of its
    sums, so the single sales need not be stored for it, nor travel with more than it adds up."""
    rows = _at_cost(sales, products, stores).select(
        sales_month(F.col("sales_date")).alias("sales_month"),
        "product_sk",
        "store_sk",
        "sales_date",
        "sales_quantity",
        "sales_dollars",
        "cost",
    )
    laid_out = rows.repartitionByRange("sales_month", "product_sk")
    return _by_day(laid_out.withColumn("estimated_cogs", _cogs()))


def _by_day(laid_out: DataFrame) -> DataFrame:
    """One shuffle groups the days and lays the months out for writing."""
    return laid_out.groupBy("sales_month", "product_sk", "store_sk", "sales_date").agg(
        F.sum("sales_quantity").cast("decimal(20,2)").alias("sales_quantity"),
        F.sum("sales_dollars").cast("decimal(22,2)").alias("sales_dollars"),
        F.sum("estimated_cogs").cast("decimal(31,4)").alias("estimated_cogs"),
    )


def moments_of(keys: Iterable[str]) -> str:
    """The value of ``moments_of`` in ``daily_moments`` for its rows by ``keys``."""
    return "_".join(sorted(keys)) or "all"


def daily_moments(
    daily: DataFrame, products: DataFrame | None, sets: list[list[str]] = MOMENT_KEYS
) -> DataFrame:
    """Per month and each of the ``sets`` of keys: sums over the days of the month of the
    daily quantity and of its square, days with a quantity, and days with sales.

    Means and deviations of daily quantities do not add up over stores or products, since those
    share days, but over months they do: these four are added up instead of the days. Sets with
    products have about as many days as there are sales, so these are shuffled once, by product and
    month; the others come from the few days of classes in stores.
    """
    names = sorted({k for keys in MOMENT_KEYS for k in keys})
    day = ["sales_month", "sales_date"]
    x = F.col("x")
    moments = [
        F.sum("x").cast("decimal(38,2)").alias("sx"),
        F.sum(x * x).cast("decimal(38,4)").alias("sxx"),
        F.count("x").alias("n"),
        F.count("sales_date").alias("active_days"),
    ]
    parts = []
    fine = [k for k in sets if "product_sk" in k]
    finest = max(fine, key=len, default=[])
    # the days of a product in a month are few, whatever the stores, and every set has the same
    # rows by the same keys shuffled, so that one shuffle serves them all
    in_months = daily.repartition("sales_month", "product_sk")
    per_finest = in_months.groupBy(*day, *finest).agg(F.sum("sales_quantity").alias("x"))
    for keys in fine:
        per_day = per_finest if keys == finest else per_finest.groupBy(*day, *keys).agg(F.sum("x").alias("x"))
        kept = per_day.groupBy("sales_month", *keys).agg(*moments)
        parts.append(kept.withColumn("moments_of", F.lit(moments_of(keys))))
    coarse = [k for k in sets if "product_sk" not in k]
    if coarse:
        few = sorted({k for keys in coarse for k in keys})
        classes = products.select("product_sk", abc_display().alias("abc_class_display"))
        # a key can be NULL by itself, so the rows carry the names of their keys
        named = F.concat_ws("_", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in few])
        per_day = (
            daily.join(classes, "product_sk", "left")
            .groupBy(*day, *few)
            .agg(F.sum("sales_quantity").alias("x"))
            .groupingSets([[*day, *keys] for keys in coarse], *day, *few)
            .agg(
                F.coalesce(F.nullif(named, F.lit("")), F.lit("all")).alias("moments_of"),
                F.sum("x").alias("x"),
            )
        )
        parts.append(per_day.groupBy("moments_of", "sales_month", *few).agg(*moments))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    given = [k for k in names if k in rows.columns]
    return rows.select("moments_of", "sales_month", *given, "sx", "sxx", "n", "active_days")


def fact_inventory_snapshot(
    beginning: DataFrame, ending: DataFrame, products: DataFrame, stores: DataFrame
) -> DataFrame:
    """Both stock counts in one table, joined to the dimensions once."""

    def leg(counted: DataFrame, date_column: str, kind: str) -> DataFrame:
        return counted.select(
            "store",
            "brand",
            "inventory_id",
            F.col(date_column).alias("snapshot_date"),
            F.lit(kind).alias("snapshot_type"),
            F.col("on_hand").alias("quantity_on_hand"),
            F.col("price").alias("snapshot_price"),
        )

    both = leg(beginning, "start_date", BEGINNING).unionByName(leg(ending, "end_date", ENDING))
    return (
        both.join(products.select("product_sk", "brand"), "brand", "left")
        .join(stores.select("store_sk", F.col("store_number").alias("store")), "store", "left")
        .select(
            "product_sk",
            "store_sk",
            "inventory_id",
            "snapshot_date",
            "snapshot_type",
            "quantity_on_hand",
            "snapshot_price",
            (F.col("quantity_on_hand") * F.col("snapshot_price")).alias("total_inventory_value"),
        )
    )


def dim_date(sales: DataFrame) -> DataFrame:
    """Every day between the first and the last sale. Sunday is day 0; ISO weeks."""
    day = F.col("date_key")
    weekday = F.dayofweek(day) - 1
    return (
        sales.agg(F.min("sales_date").alias("first"), F.max("sales_date").alias("last"))
        .filter("first IS NOT NULL")
        .select(F.explode(F.sequence("first", "last")).alias("date_key"))
        .select(
            "date_key",
            F.year(day).alias("year"),
            F.quarter(day).alias("quarter"),
            F.month(day).alias("month"),
            F.rpad(F.date_format(day, "MMMM"), NAME_WIDTH, " ").alias("month_name"),
            F.weekofyear(day).alias("week_of_year"),
            weekday.alias("day_of_week"),
            F.rpad(F.date_format(day, "EEEE"), NAME_WIDTH, " ").alias("day_name"),
            weekday.isin(0, 6).alias("is_weekend"),
        )
    )


def with_date_labels(dates: DataFrame) -> DataFrame:
    day = F.col("date_key")
    return dates.select(
        "*",
        F.date_format(day, "MMM").alias("month_name_short"),
        F.month(day).alias("month_sort"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        F.concat(F.lit("Q"), F.quarter(day)).alias("quarter_label"),
    )


def with_abc_labels(products: DataFrame) -> DataFrame:
    return products.select(
        "*",
        abc_display().alias("abc_class_display"),
        abc_sort().alias("abc_class_sort"),
        abc_priority_group().alias("abc_priority_group"),
    )
