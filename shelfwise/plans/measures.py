"""Report measures, evaluated from base sums at whatever grain is asked for.

Measures are not additive: a ratio, a dead-stock value or a reorder point of a store
is not the sum of those of its products. ``evaluate`` therefore aggregates the facts
to the grain and derives the measures there. NULL means "no rows", which differs from 0.

Filters and grain reach both facts through product, store and date; vendors reach
sales only. The 90-day window ends on the last calendar day of the context.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import DEAD_STOCK_WINDOW_DAYS, DSI_DAYS, Replenishment
from shelfwise.functions.casting import ratio, rounded, safe_divide
from shelfwise.functions.labels import (
    UNCLASSIFIED,
    abc_display,
    alert_code,
    alert_label,
    alert_sort,
    dead_stock_flag,
    inventory_status,
    lifecycle_status,
    none_or_zero,
    risk_priority,
    stock_record_status,
)
from shelfwise.plans.marts import BEGINNING, ENDING, moments_of, sales_month
from shelfwise.plans.warehouse import Warehouse
from shelfwise.session import cut_lineage

PRODUCT, STORE, CLASS, MONTH = "product_sk", "store_sk", "abc_class_display", "year_month"
LEVEL = "level_of"

# Measure name -> output type, in catalogue order.
SUMS = {
    "total_revenue": "decimal(28,2)",
    "total_sales_qty": "decimal(28,2)",
    "total_cogs": "decimal(28,4)",
    "beginning_inventory_value": "decimal(28,4)",
    "ending_inventory_value": "decimal(28,4)",
    "current_stock_qty": "decimal(28,2)",
    "total_snapshot_records": "bigint",
    "out_of_stock_records": "bigint",
    "beginning_rows": "bigint",
    "ending_rows": "bigint",
    "ending_out_of_stock_rows": "bigint",
    "sales_qty_last_90_days": "decimal(28,2)",
    "sellable_ending_value": "decimal(28,4)",
}
DEAD = ["dead_stock_value", "dead_stock_sku_count", "unclassified_dead_stock_value"]
UNCLASSIFIED_SUMS = ["unclassified_inventory_value"]
BY_FLAG = {"unclassified_dead_stock_value", *UNCLASSIFIED_SUMS}
DAILY = [
    "avg_daily_sales_qty",
    "stddev_daily_sales_qty",
    "safety_stock_qty",
    "reorder_point_qty",
]
ALERT = ["reorder_alert", "reorder_alert_sort"]
RATIOS = [
    "average_inventory_value",
    "inventory_turnover",
    "dsi_days",
    "stockout_rate",
    "stockout_rate_carried",
    "dead_stock_pct",
]
STOCK_VS_ROP = ["days_of_stock_remaining", "stock_vs_rop_gap"]
STATUS = [
    "dead_stock_flag",
    "inventory_status",
    "stock_record_status",
    "sku_lifecycle_status",
    "risk_priority_sort",
]
SKU_COUNTS = ["reorder_sku_count", "unclassified_sku_count"]
ALL = [
    *SUMS,
    *DEAD,
    *UNCLASSIFIED_SUMS,
    *DAILY,
    *ALERT,
    *RATIOS,
    *STOCK_VS_ROP,
    *STATUS,
    *SKU_COUNTS,
]

# What each derived measure is computed from.
NEEDS = {
    "average_inventory_value": ["beginning_inventory_value", "ending_inventory_value"],
    "inventory_turnover": ["total_cogs", "average_inventory_value"],
    "dsi_days": ["inventory_turnover"],
    "stockout_rate": ["ending_rows", "ending_out_of_stock_rows"],
    "stockout_rate_carried": ["ending_rows", "ending_out_of_stock_rows"],
    "dead_stock_pct": ["dead_stock_value", "ending_inventory_value"],
    "reorder_alert": ["reorder_point_qty"],
    "reorder_alert_sort": ["reorder_alert"],
    "days_of_stock_remaining": ["current_stock_qty", "avg_daily_sales_qty"],
    "stock_vs_rop_gap": ["current_stock_qty", "reorder_point_qty"],
    "dead_stock_flag": ["current_stock_qty", "dead_stock_value"],
    "inventory_status": ["current_stock_qty", "sales_qty_last_90_days"],
    "stock_record_status": ["ending_rows", "sales_qty_last_90_days"],
    "sku_lifecycle_status": ["beginning_rows", "ending_rows"],
    "risk_priority_sort": ["inventory_status", "stock_record_status"],
}


@dataclass(frozen=True)
class Slice:
    """Slicers; an empty one does not filter."""

    years: tuple[int, ...] = ()
    months: tuple[int, ...] = ()
    stores: tuple[int, ...] = ()
    abc_classes: tuple[str, ...] = ()
    brands: tuple[int, ...] = ()
    vendors: tuple[int, ...] = ()

    @property
    def has_dates(self) -> bool:
        return bool(self.years or self.months)

    def dates(self, day: Column) -> Column:
        wanted = F.lit(True)
        if self.years:
            wanted &= F.year(day).isin(*self.years)
        if self.months:
            wanted &= F.month(day).isin(*self.months)
        return wanted


def _closure(names: list[str]) -> set[str]:
    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += NEEDS.get(name, [])
    return wanted


def stack(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per key from parts with different columns, each unique on the keys.

    Same result as full outer joins on null-safe keys, with one small shuffle.
    """
    if len(parts) == 1:
        return parts[0]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


class Context:
    """Facts and calendar of a warehouse under a slice, at a grain.

    ``by_product`` is for measures that look products up on the way: see ``laid_out``.
    """

    def __init__(self, warehouse: Warehouse, grain: list[str], where: Slice, by_product: bool = False):
        unknown = set(grain) - {PRODUCT, STORE, CLASS, MONTH}
        if unknown:
            raise ValueError(f"unknown grain {sorted(unknown)}")
        self.w = warehouse
        self.grain = grain
        self.where = where
        self.by_product = by_product
        self.by_month = MONTH in grain
        self.by_class = CLASS in grain

    @cached_property
    def products(self) -> DataFrame:
        """Opened when first asked for: stock by store needs no classes, which need all sales."""
        return self.w.table("dim_product").select(
            PRODUCT, "brand", "abc_class", abc_display().alias(CLASS)
        )

    # -- calendar ---------------------------------------------------------------

    def calendar(self) -> DataFrame:
        days = self.w.table("dim_date").select("date_key").filter(self.where.dates(F.col("date_key")))
        if self.by_month:
            days = days.withColumn(MONTH, F.date_format("date_key", "yyyy-MM"))
        return days

    def calendar_days(self) -> DataFrame:
        """Calendar days of each date context, whatever was sold on them."""
        keys = [MONTH] if self.by_month else []
        return self.calendar().groupBy(*keys).agg(F.count(F.lit(1)).alias("calendar_days"))

    def window_end(self) -> Column:
        """Last day of the context, as a scalar subquery."""
        return self.calendar().agg(F.max("date_key")).scalar()

    # -- facts ------------------------------------------------------------------

    def _in_stores(self, fact: DataFrame) -> DataFrame:
        if not self.where.stores:
            return fact
        stores = self.w.table("dim_store").filter(F.col("store_number").isin(*self.where.stores))
        return fact.join(stores.select(STORE), STORE, "left_semi")

    def _sliced(self, fact: DataFrame) -> DataFrame:
        """Product and store slicers, as semi joins before anything is aggregated."""
        fact = self._in_stores(fact)
        if self.where.abc_classes or self.where.brands:
            picked = self.picked_products().select(PRODUCT)
            # a brand is one product, so the list of brands bounds them: facts need no shuffle to meet them
            fact = fact.join(F.broadcast(picked) if self.where.brands else picked, PRODUCT, "left_semi")
        return fact

    def picked_products(self) -> DataFrame:
        picked = self.products
        if self.where.abc_classes:
            picked = picked.filter(F.col(CLASS).isin(*self.where.abc_classes))
        if self.where.brands:
            picked = picked.filter(F.col("brand").isin(*self.where.brands))
        return picked

    def laid_out(self, fact: DataFrame) -> DataFrame:
        """A fact shuffled by product alone, as narrow as it is stored: groups by product and any other
        key, what is known of the product, and other facts laid out like this need no further shuffle.

        A product has a row per store and day at most, or per position, so none is too hot; of
        single sales, which vendors ask for, it can have any number, and these stay as they are.
        """
        return fact.repartition(PRODUCT) if self.by_product and not self.where.vendors else fact

    def all_sales(self) -> DataFrame:
        """Sales under the slicers other than dates, by day unless vendors are asked for."""
        fact = self.w.table("fact_sales" if self.where.vendors else "daily_sales")
        if self.where.vendors:
            vendors = self.w.table("dim_vendor").filter(
                F.col("vendor_number").isin(*self.where.vendors)
            )
            fact = fact.join(vendors.select("vendor_sk"), "vendor_sk", "left_semi")
        return self._sliced(fact)

    def sales(self) -> DataFrame:
        fact = self.all_sales()
        if self.where.has_dates:
            fact = fact.filter(self.where.dates(F.col("sales_date")))
            # on the partition column as well, so that the scan skips other months
            if self.where.years:
                fact = fact.filter((F.col("sales_month") / 100).cast("int").isin(*self.where.years))
            if self.where.months:
                fact = fact.filter((F.col("sales_month") % 100).isin(*self.where.months))
        if self.by_month:
            fact = fact.withColumn(MONTH, F.date_format("sales_date", "yyyy-MM"))
        return fact

    def moments(self, keys: list[str]) -> DataFrame | None:
        """Stored daily moments by ``keys``, one row per month of the context, for products in
        stores one per day.

        None where only the days tell: moments add up over months, so a slicer has to choose
        among the keys' own values. Vendors are in the single sales only.
        """
        finest = [k for k in (PRODUCT, STORE, CLASS) if k in keys and not (k == CLASS and PRODUCT in keys)]
        by_class = self.where.abc_classes and CLASS in finest
        if (
            self.where.vendors
            or (self.where.stores and STORE not in finest)
            or (self.where.brands and PRODUCT not in finest)
            or (self.where.abc_classes and not by_class and PRODUCT not in finest)
        ):
            return None
        if STORE in finest and PRODUCT in finest:
            return self._days_as_moments(CLASS in keys)
        kept = "product_moments" if PRODUCT in finest else "summed_moments"
        months = self.w.table(kept).filter(F.col("moments_of") == moments_of(finest))
        if PRODUCT in finest:
            months = self.laid_out(months)
        if by_class:
            months = months.filter(F.col(CLASS).isin(*self.where.abc_classes))
            months = self._in_stores(months)
        else:
            months = self._sliced(months)
        first_day = F.to_date((F.col("sales_month") * 100 + 1).cast("string"), "yyyyMMdd")
        if self.where.has_dates:
            months = months.filter(self.where.dates(first_day))
        if self.by_month:
            months = months.withColumn(MONTH, F.date_format(first_day, "yyyy-MM"))
        if CLASS in keys and CLASS not in finest:
            months = months.drop(CLASS).join(self.products.select(PRODUCT, CLASS), PRODUCT, "left")
        return months

    def _days_as_moments(self, with_class: bool) -> DataFrame:
        """The moments of single days of a product in a store: the daily sales have one row for
        each, and months would have about as many."""
        x = F.col("sales_quantity")
        days = self.laid_out(self.sales()).withColumns(
            {
                "sx": x,
                "sxx": x * x,
                "n": x.isNotNull().cast("bigint"),
                "active_days": F.col("sales_date").isNotNull().cast("bigint"),
            }
        )
        return days.join(self.products.select(PRODUCT, CLASS), PRODUCT, "left") if with_class else days

    def window_sales(self) -> DataFrame:
        """Sales of the 90 days up to the end of each date context.

        By month, the sales are first added up by day and what the measures need, then each day
        is matched to the few months whose window covers it.
        """
        fact = self.all_sales()
        if not self.by_month:
            end = self.window_end()
            first = F.date_sub(end, DEAD_STOCK_WINDOW_DAYS - 1)
            return self.laid_out(
                fact.filter(
                    (F.col("sales_month") >= sales_month(first))
                    & (F.col("sales_date") >= first)
                    & (F.col("sales_date") <= end)
                )
            )
        covered = (
            self.calendar()
            .groupBy(MONTH)
            .agg(F.max("date_key").alias("end"))
            .select(
                MONTH,
                F.explode(
                    F.sequence(F.date_sub("end", DEAD_STOCK_WINDOW_DAYS - 1), F.col("end"))
                ).alias("sales_date"),
            )
        )
        keys = [k for k in self.grain if k not in (MONTH, CLASS)]
        keys = list(dict.fromkeys([*keys, PRODUCT, "sales_date"]))
        per_day = self.laid_out(fact).groupBy(*keys).agg(F.sum("sales_quantity").alias("sales_quantity"))
        return per_day.join(covered, "sales_date")

    def snapshot(self) -> DataFrame:
        fact = self._sliced(self.w.table("fact_inventory_snapshot"))
        if self.where.has_dates or self.by_month:
            days = self.calendar().withColumnRenamed("date_key", "snapshot_date")
            fact = fact.join(days, "snapshot_date", "inner" if self.where.has_dates else "left")
        return fact

    # -- aggregation --------------------------------------------------------------

    def keys(self, *extra: str) -> list[str]:
        return [*self.grain, *[e for e in extra if e not in self.grain]]

    def sums(self, sources: list[tuple[DataFrame, dict[str, Column]]], *extra: str) -> DataFrame:
        """Sums of row values from several facts, by the grain and ``extra`` keys.

        The facts are put under one another and grouped once, so they share a single
        shuffle and each task combines its rows before it. The class of a product is
        looked up after the rows are reduced to products.
        """
        keys = self.keys(*extra)
        names = [n for _, values in sources for n in values]
        totals = [F.sum(n).alias(n) for n in names]
        fine = keys
        if self.by_class:
            fine = list(dict.fromkeys([k for k in keys if k != CLASS] + [PRODUCT]))
        rows = [
            fact.select(*fine, *[v.alias(n) for n, v in values.items()])
            for fact, values in sources
        ]
        reduced = (
            reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
            .groupBy(*fine)
            .agg(*totals)
        )
        if not self.by_class:
            return reduced
        named = reduced.join(self.products.select(PRODUCT, CLASS), PRODUCT, "left")
        if PRODUCT in keys:
            return named.select(*keys, *names)
        return named.groupBy(*keys).agg(*totals)


def _sales_values(wanted: set[str]) -> dict[str, Column]:
    columns = {
        "total_revenue": F.col("sales_dollars"),
        "total_sales_qty": F.col("sales_quantity"),
        "total_cogs": F.col("estimated_cogs"),
    }
    return {n: c for n, c in columns.items() if n in wanted}


def _snapshot_values(wanted: set[str]) -> dict[str, Column]:
    ending, beginning = F.col("snapshot_type") == ENDING, F.col("snapshot_type") == BEGINNING
    value, on_hand = F.col("total_inventory_value"), F.col("quantity_on_hand")
    one = F.lit(1).cast("bigint")
    columns = {
        "beginning_inventory_value": F.when(beginning, value),
        "ending_inventory_value": F.when(ending, value),
        "current_stock_qty": F.when(ending, on_hand),
        "total_snapshot_records": one,
        "out_of_stock_records": F.when(on_hand <= 0, one),
        "beginning_rows": F.when(beginning, one),
        "ending_rows": F.when(ending, one),
        "ending_out_of_stock_rows": F.when(ending & (on_hand <= 0), one),
        "sellable_ending_value": F.when(ending & (on_hand > 0), value),
    }
    return {n: c for n, c in columns.items() if n in wanted}


def _sources(ctx: Context, wanted: set[str]) -> list[tuple[DataFrame, dict[str, Column]]]:
    """The facts to read for the wanted sums, each with its row values.

    Without a date in grain or slice, the window is a part of the sales that are read
    anyway; if nothing else of them is wanted, only its partitions are read.
    """
    sources = []
    sales, stock = _sales_values(wanted), _snapshot_values(wanted)
    window = "sales_qty_last_90_days"
    if window in wanted:
        if sales and not ctx.by_month and not ctx.where.has_dates:
            day, end = F.col("sales_date"), ctx.window_end()
            inside = (day > F.date_sub(end, DEAD_STOCK_WINDOW_DAYS)) & (day <= end)
            sales[window] = F.when(inside, F.col("sales_quantity"))
        else:
            sources.append((ctx.window_sales(), {window: F.col("sales_quantity")}))
    if sales:
        sources.append((ctx.laid_out(ctx.sales()), sales))
    if stock:
        sources.append((ctx.laid_out(ctx.snapshot()), stock))
    return sources


def _day_moments(ctx: Context, keys: list[str], *extra: str) -> DataFrame:
    """The moments of a context that months cannot tell: first one row per key and day, then
    sums per key. A hot product is spread over its days in the first shuffle and reduced to one
    row per task in the second."""
    per_day = ctx.sums([(ctx.sales(), {"x": F.col("sales_quantity")})], *extra, "sales_date")
    x = F.col("x")
    return per_day.groupBy(*keys).agg(
        F.sum("x").cast("double").alias("sx"),
        F.sum(x * x).cast("double").alias("sxx"),
        F.count("x").alias("n"),
        F.count("sales_date").alias("active_days"),
    )


def daily_statistics(ctx: Context, params: Replenishment, *extra: str) -> DataFrame:
    """Average and deviation of the daily quantity, safety stock and reorder point.

    From the stored moments of the months where these tell, else from the days.
    """
    keys = ctx.keys(*extra)
    months = ctx.moments(keys)
    if months is None:
        per_key = _day_moments(ctx, keys, *extra)
    else:
        # exact sums become doubles once they are complete, as those over days do
        per_key = months.groupBy(*keys).agg(
            F.sum("sx").cast("double").alias("sx"),
            F.sum("sxx").cast("double").alias("sxx"),
            F.sum("n").alias("n"),
            F.sum("active_days").alias("active_days"),
        )
    if ctx.by_month:
        per_key = per_key.join(ctx.calendar_days(), MONTH)
        calendar_days = F.col("calendar_days")
    else:
        calendar_days = ctx.calendar_days().scalar()
    return per_key.select(*keys, *_statistics(calendar_days, params))


def _statistics(calendar_days: Column, params: Replenishment) -> list[Column]:
    """The daily measures from ``sx, sxx, n, active_days``, sums over the days of a key."""
    sx, sxx, n = F.col("sx"), F.col("sxx"), F.col("n").cast("double")
    spread_over = calendar_days.cast("double") if params.deviation == "as_written" else n
    mean = F.try_divide(sx, n)
    variance = F.try_divide(sxx - F.lit(2.0) * mean * sx + spread_over * mean * mean, spread_over)
    average = safe_divide(sx, F.col("active_days"))
    deviation = F.sqrt(F.greatest(variance, F.lit(0.0)))
    safety = F.lit(params.z) * deviation * F.sqrt(F.lit(float(params.lead_time_days)))
    return [
        average.alias("avg_daily_sales_qty"),
        deviation.alias("stddev_daily_sales_qty"),
        safety.alias("safety_stock_qty"),
        F.round(average * F.lit(float(params.lead_time_days)) + safety, 0).alias("reorder_point_qty"),
    ]


def lowest_store_stock(ctx: Context, *extra: str) -> DataFrame:
    """Lowest closing stock over the stores that hold any stock record.

    The alert grows with the stock, so the most urgent store is the one with the
    lowest stock, and no store has to be visited one by one.
    """
    on_hand = F.when(F.col("snapshot_type") == ENDING, F.col("quantity_on_hand"))
    counted = ctx.snapshot()
    if ctx.by_class or PRODUCT in ctx.keys(*extra):
        # stock has few rows for a product in a store, so that partial sums would not shrink it; by
        # month the products meet others that are shuffled by month as well, unless those are not
        counted = ctx.laid_out(counted) if ctx.by_month else counted.repartition(PRODUCT)
    per_store = ctx.sums([(counted, {"stock": on_hand})], *extra, STORE)
    return per_store.groupBy(*ctx.keys(*extra)).agg(
        F.min("stock").alias("lowest_stock"), (F.count(F.lit(1)) > 0).alias("has_snapshot")
    )


def _alert(lowest: str = "lowest_stock") -> Column:
    """NULL where no store holds a stock record at all."""
    return F.when(F.col("has_snapshot"), alert_code(F.col(lowest), F.col("reorder_point_qty")))


def product_alerts(ctx: Context, params: Replenishment) -> DataFrame:
    """Reorder alert code per grain key and known product."""
    parts = [daily_statistics(ctx, params, PRODUCT), lowest_store_stock(ctx, PRODUCT)]
    return (
        stack(parts, ctx.keys(PRODUCT))
        .filter(F.col(PRODUCT).isNotNull())
        .withColumn("alert_code", _alert())
    )


def _dead_stock(ctx: Context, base: DataFrame) -> dict[str, Column]:
    """Aggregates over products: dead ones sold nothing in the window."""
    dead = none_or_zero(F.col("sales_qty_last_90_days")) & F.col(PRODUCT).isNotNull()
    unclassified = F.col("is_unclassified")
    return {
        "dead_stock_value": F.sum(F.when(dead, F.col("sellable_ending_value"))),
        "dead_stock_sku_count": F.count_if(dead & (F.col("current_stock_qty") > 0)),
        "unclassified_dead_stock_value": F.sum(
            F.when(dead & unclassified, F.col("sellable_ending_value"))
        ),
        "unclassified_inventory_value": F.sum(
            F.when(unclassified & F.col(PRODUCT).isNotNull(), F.col("ending_inventory_value"))
        ),
    }


def _base(ctx: Context, wanted: set[str]) -> list[DataFrame]:
    """Additive sums at the grain; through one row per product where dead stock asks."""
    over_products = wanted & {*DEAD, *UNCLASSIFIED_SUMS}
    needed = set(wanted)
    if over_products:
        needed |= {
            "sales_qty_last_90_days",
            "sellable_ending_value",
            "current_stock_qty",
            "ending_inventory_value",
        }
    sources = _sources(ctx, needed)
    if not sources:
        return []
    if not over_products:
        return [ctx.sums(sources)]
    per_product = ctx.sums(sources, PRODUCT)
    if over_products & BY_FLAG:
        flags = ctx.products.select(PRODUCT, (F.col(CLASS) == UNCLASSIFIED).alias("is_unclassified"))
        per_product = per_product.join(flags, PRODUCT, "left")
    aggregates = {
        n: c for n, c in _dead_stock(ctx, per_product).items() if n in over_products
    }
    aggregates |= {n: F.sum(n) for n in SUMS if n in needed}
    return [
        per_product.groupBy(*ctx.grain).agg(*[c.alias(n) for n, c in aggregates.items()])
    ]


def _reorder_sku_count(ctx: Context, params: Replenishment) -> DataFrame:
    return (
        product_alerts(ctx, params)
        .groupBy(*ctx.grain)
        .agg(F.count_if(F.col("alert_code") == 2).alias("reorder_sku_count"))
    )


def _with_unclassified_count(ctx: Context, rows: DataFrame) -> DataFrame:
    """Store and date do not reach the product list, so they repeat its count."""
    keys = [k for k in ctx.grain if k in (PRODUCT, CLASS)]
    name = "unclassified_sku_count"
    counts = ctx.picked_products().groupBy(*keys).agg(
        F.count_if(F.col(CLASS) == UNCLASSIFIED).alias(name)
    )
    if not keys:
        return rows.withColumn(name, counts.scalar())
    if keys == ctx.grain:
        return stack([rows, counts], keys)
    return rows.join(counts, keys, "left")


def _derived(wanted: set[str]) -> list[tuple[str, Column]]:
    """Measures computed from others of the same row, each after what it needs."""
    c = F.col
    zero = F.lit(0).cast("decimal(28,4)")
    beg, end = c("beginning_inventory_value"), c("ending_inventory_value")
    average = F.when(
        beg.isNotNull() | end.isNotNull(),
        (F.coalesce(beg, zero) + F.coalesce(end, zero)).cast("double") / 2,
    )
    code = c("alert_code")
    stock, sold = c("current_stock_qty"), c("sales_qty_last_90_days")
    stockout = safe_divide(c("ending_out_of_stock_rows"), c("ending_rows"))
    catalogue = [
        ("average_inventory_value", average),
        ("inventory_turnover", safe_divide(c("total_cogs"), c("average_inventory_value"))),
        ("dsi_days", safe_divide(F.lit(DSI_DAYS), c("inventory_turnover"))),
        ("stockout_rate", stockout),
        ("stockout_rate_carried", stockout),
        ("dead_stock_pct", safe_divide(c("dead_stock_value"), end)),
        ("reorder_alert", alert_label(code)),
        ("reorder_alert_sort", alert_sort(c("reorder_alert"))),
        ("days_of_stock_remaining", safe_divide(stock, c("avg_daily_sales_qty"))),
        (
            "stock_vs_rop_gap",
            F.when(
                stock.isNotNull() | c("reorder_point_qty").isNotNull(),
                F.coalesce(stock.cast("double"), F.lit(0.0))
                - F.coalesce(c("reorder_point_qty"), F.lit(0.0)),
            ),
        ),
        ("dead_stock_flag", dead_stock_flag(stock, c("dead_stock_value"))),
        ("inventory_status", inventory_status(stock, sold)),
        ("stock_record_status", stock_record_status(c("ending_rows"), sold)),
        ("sku_lifecycle_status", lifecycle_status(c("beginning_rows"), c("ending_rows"))),
        (
            "risk_priority_sort",
            risk_priority(c("inventory_status"), c("stock_record_status")),
        ),
    ]
    return [(n, x) for n, x in catalogue if n in wanted]


_DOUBLES = {*DAILY, *RATIOS, *STOCK_VS_ROP}


def _output(name: str) -> Column:
    if name in SUMS:
        return F.col(name).cast(SUMS[name])
    if name in ("dead_stock_value", "unclassified_dead_stock_value", *UNCLASSIFIED_SUMS):
        return F.col(name).cast("decimal(28,4)").alias(name)
    if name in _DOUBLES:
        return rounded(F.col(name)).alias(name)
    return F.col(name)


def evaluate(
    warehouse: Warehouse,
    grain: list[str],
    names: list[str],
    where: Slice = Slice(),
    params: Replenishment | None = None,
) -> DataFrame:
    """The named measures at ``grain``, a list of PRODUCT, STORE, CLASS and MONTH.

    A row exists where any fact has one; facts without a known product or store have a row
    with a NULL key, so that rows add up to the total.
    """
    params = params or warehouse.settings.replenishment
    wanted = _closure(names)
    if wanted == {"unclassified_sku_count"}:
        wanted.add("total_revenue")  # some fact has to say which rows exist
    if wanted & set(ALERT) and STORE in grain:
        wanted |= {"current_stock_qty", "total_snapshot_records"}  # its own lowest stock
    ctx = Context(warehouse, grain, where, by_product=bool(wanted & BY_FLAG))
    parts = _base(ctx, wanted)
    if wanted & set(DAILY):
        parts.append(daily_statistics(ctx, params))
    if wanted & set(ALERT) and STORE not in grain:
        parts.append(lowest_store_stock(ctx))
    # rows by product have the alert of their product already
    own_alert = PRODUCT in grain and bool(wanted & set(ALERT))
    if "reorder_sku_count" in wanted and not own_alert:
        parts.append(_reorder_sku_count(ctx, params))
    rows = stack(parts, grain)
    if "unclassified_sku_count" in wanted:
        rows = _with_unclassified_count(ctx, rows)
    if wanted & set(ALERT):
        if STORE in grain:
            has_any = F.col("total_snapshot_records") > 0
            rows = rows.withColumns(
                {"lowest_stock": F.col("current_stock_qty"), "has_snapshot": has_any}
            )
        rows = rows.withColumn("alert_code", _alert())
    if "reorder_sku_count" in wanted and own_alert:
        reordered = F.col(PRODUCT).isNotNull() & (F.col("alert_code") == 2)
        rows = rows.withColumn("reorder_sku_count", F.when(reordered, F.lit(1).cast("bigint")))
    for name, column in _derived(wanted):
        rows = rows.withColumn(name, column)
    for name in ("dead_stock_sku_count", *SKU_COUNTS):
        if name in rows.columns and name in names:
            rows = rows.withColumn(name, F.nullif(F.col(name), F.lit(0)))
    return rows.select(*grain, *[_output(n).alias(n) for n in names])


def evaluate_levels(
    warehouse: Warehouse,
    names: list[str],
    where: Slice = Slice(),
    params: Replenishment | None = None,
) -> DataFrame:
    """Stock and reorder measures of classes, products and positions.

    ``LEVEL`` is CLASS, PRODUCT or STORE (a product in a store); keys finer than the level are
    NULL. None of these measures adds up, but the sums below them do: products and positions come from
    one pass over the facts, shuffled by product only. There quantities are added up by day at both
    levels at once, a second grouping turns days into moments, and in a third each store hands its
    stock to its product, which keeps the lowest. The few rows of classes share no key with them;
    they are evaluated by themselves, which reads the facts again, and written.
    """
    params = params or warehouse.settings.replenishment
    wanted = _closure(names)
    if unknown := wanted - {*DAILY, *ALERT, *STOCK_VS_ROP, "current_stock_qty"}:
        raise ValueError(f"not a measure of stock and reorder points: {sorted(unknown)}")
    ctx = Context(warehouse, [], where, by_product=True)
    snapshot = F.lit(1).cast("bigint").alias("records")
    ending = F.when(F.col("snapshot_type") == ENDING, F.col("quantity_on_hand")).alias("stock")
    day, keys = "sales_date", [PRODUCT, STORE]
    sold = ctx.laid_out(ctx.sales()).select(*keys, day, F.col("sales_quantity").alias("x"), F.lit(1).alias("sold"))
    counted = ctx.laid_out(ctx.snapshot()).select(*keys, ending, snapshot)
    rows = sold.unionByName(counted, allowMissingColumns=True)
    # the product stays a column of its own, so that its rows stay where they are
    levels_of = F.array(
        F.struct(F.lit(True).alias("of_store"), F.col(STORE).alias("level_store")),
        F.struct(F.lit(False).alias("of_store"), F.lit(None).cast(rows.schema[STORE].dataType).alias("level_store")),
    )
    added = ("x", "sold", "stock", "records")
    by_day = (
        rows.select(PRODUCT, day, *added, F.inline(levels_of))
        .withColumnRenamed("level_store", STORE)
        .groupBy("of_store", *keys, day)
        .agg(*[F.sum(c).alias(c) for c in added])
    )
    x, of_store = F.col("x"), F.col("of_store")
    per_key = by_day.groupBy("of_store", *keys).agg(
        F.sum("x").cast("double").alias("sx"),
        F.sum(x * x).cast("double").alias("sxx"),
        F.count("x").alias("n"),
        F.count(day).alias("active_days"),
        F.sum("stock").alias("current_stock_qty"),
        F.sum("records").alias("records"),
        F.sum("sold").alias("sold"),
    )
    # without any sales rows there are no daily figures, not even a deviation of 0
    statistics = zip(DAILY, _statistics(ctx.calendar_days().scalar(), params), strict=True)
    measured = per_key.select(
        "of_store",
        *keys,
        "current_stock_qty",
        "records",
        *[F.when(F.col("sold") > 0, c).alias(n) for n, c in statistics],
    )
    own = [c for c in measured.columns if c not in ("of_store", *keys)]
    none = [F.lit(None).cast(measured.schema[c].dataType).alias(c) for c in own]
    stock = measured.schema["current_stock_qty"].dataType
    held = F.when(F.col("records") > 0, F.col("current_stock_qty"))
    has_any = F.coalesce(F.col("records") > 0, F.lit(False))
    as_it_is = F.struct(
        of_store.alias("in_store"),
        F.col(STORE).alias("level_store"),
        *own,
        F.lit(None).cast(stock).alias("lowest_stock"),
        F.lit(False).alias("has_snapshot"),
    )
    # what a store tells its product
    handed = F.struct(
        F.lit(False).alias("in_store"),
        F.lit(None).cast(measured.schema[STORE].dataType).alias("level_store"),
        *none,
        held.alias("lowest_stock"),
        has_any.alias("has_snapshot"),
    )
    said = F.when(of_store, F.array(as_it_is, handed)).otherwise(F.array(as_it_is))
    told = measured.select(PRODUCT, F.inline(said)).withColumnRenamed("level_store", STORE)
    levels = told.groupBy("in_store", *keys).agg(
        *[F.max(c).alias(c) for c in own],
        F.min("lowest_stock").alias("lowest_stock"),
        F.bool_or("has_snapshot").alias("has_snapshot"),
    )
    in_store = F.col("in_store")
    levels = levels.withColumns(
        {
            "lowest_stock": F.when(in_store, F.col("current_stock_qty")).otherwise(F.col("lowest_stock")),
            "has_snapshot": F.when(in_store, F.col("records") > 0).otherwise(F.col("has_snapshot")),
        }
    ).withColumn("alert_code", _alert())
    for name, column in _derived(wanted):
        levels = levels.withColumn(name, column)
    no_class = F.lit(None).cast("string").alias(CLASS)
    shown = [F.when(in_store, STORE).otherwise(PRODUCT).alias(LEVEL), no_class, *keys]
    of_products = levels.select(*shown, *[_output(n).alias(n) for n in names])
    no_keys = [F.lit(None).cast(of_products.schema[k].dataType).alias(k) for k in keys]
    classes = evaluate(warehouse, [CLASS], names, where, params)
    written = cut_lineage(classes.select(F.lit(CLASS).alias(LEVEL), CLASS, *no_keys, *names), "class-level")
    return of_products.unionByName(ctx.laid_out(written))


def turnover_ytd(warehouse: Warehouse, where: Slice = Slice()) -> DataFrame:
    """Turnover of the year up to each month; the window runs over the months of a year.

    Date slicers choose the months that are shown. The year to date replaces them: it counts
    from January whichever months are shown.
    """
    undated = replace(where, years=(), months=())
    ctx = Context(warehouse, [MONTH], undated)
    wanted = {"total_cogs", "beginning_inventory_value", "ending_inventory_value"}
    months = ctx.calendar().select(MONTH).distinct()
    parts = [
        months,
        ctx.sums(_sources(ctx, wanted)),
    ]
    to_date = (
        Window.partitionBy(F.substring(MONTH, 1, 4))
        .orderBy(MONTH)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = stack(parts, [MONTH]).filter(F.col(MONTH).isNotNull())
    for name in sorted(wanted):
        rows = rows.withColumn(name, F.sum(name).over(to_date).cast("decimal(28,4)"))
    rows = rows.filter(where.dates(F.to_date(F.concat(MONTH, F.lit("-01")))))
    zero = F.lit(0).cast("decimal(28,4)")
    beg, end = F.col("beginning_inventory_value"), F.col("ending_inventory_value")
    average = F.when(
        beg.isNotNull() | end.isNotNull(),
        (F.coalesce(beg, zero) + F.coalesce(end, zero)).cast("double") / 2,
    )
    return rows.select(
        MONTH,
        F.col("total_cogs").alias("cogs_ytd"),
        ratio(F.col("total_cogs"), average).alias("inventory_turnover_ytd"),
    )
