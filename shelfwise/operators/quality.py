"""Data-quality checks on the raw layer and row reconciliation between layers."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import PRICE_TOLERANCE, REPORT_TOP_N, Period
from shelfwise.functions.casting import cleaned

# Columns that must be filled, per raw table.
REQUIRED: dict[str, list[str]] = {
    "raw_sales": ["inventory_id", "sales_date", "sales_quantity", "sales_dollars", "vendor_no"],
    "raw_purchases": [
        "inventory_id",
        "po_date",
        "receiving_date",
        "quantity",
        "dollars",
        "purchase_price",
        "vendor_number",
    ],
    "raw_beg_inventory": ["inventory_id", "on_hand", "price", "start_date"],
    "raw_end_inventory": ["inventory_id", "on_hand", "price", "end_date"],
    "raw_purchase_prices": ["brand", "price", "purchase_price", "vendor_number"],
    "raw_invoice_purchases": ["vendor_number", "invoice_date", "dollars"],
}
BLANK_IS_MISSING = {("raw_purchase_prices", "price"), ("raw_purchase_prices", "purchase_price")}
_NUMBER = "decimal(18,4)"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _number(name: str) -> Column:
    """Numeric reading of raw text; what cannot be read is counted by ``junk_counts``."""
    return cleaned(name).try_cast(_NUMBER)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in tables.items()
    ]
    return _union(counted).orderBy("table_name")


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """Total rows and missing values of the required columns, in one pass."""

    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(missing(table, c)).alias(f"null_{c}") for c in REQUIRED[table]],
    )


def missing(table: str, name: str) -> Column:
    blank = (table, name) in BLANK_IS_MISSING
    return F.col(name).isNull() | (F.col(name) == "") if blank else F.col(name).isNull()


def business_checks() -> dict[str, dict[str, Column]]:
    tolerance = F.lit(PRICE_TOLERANCE).cast(_NUMBER)
    # Check names as reported.
    return {
        "raw_sales": {
            "raw_sales - non-positive qty": _number("sales_quantity") <= 0,
            "raw_sales - negative dollars": _number("sales_dollars") < 0,
            "raw_sales - price calc mismatch": F.abs(
                _number("sales_dollars") - _number("sales_quantity") * _number("sales_price")
            )
            > tolerance,
        },
        "raw_beg_inventory": {
            "raw_beg_inventory - negative on_hand": _number("on_hand") < 0,
        },
        "raw_end_inventory": {
            "raw_end_inventory - negative on_hand": _number("on_hand") < 0,
        },
        "raw_purchase_prices": {
            "raw_purchase_prices - zero or null price": F.coalesce(
                _number("price"), F.lit(0).cast(_NUMBER)
            )
            == 0,
            "raw_purchase_prices - price vs purchase_price differ": _number("price")
            != _number("purchase_price"),
        },
        "raw_purchases": {
            "raw_purchases - dollar calc mismatch": F.abs(
                _number("dollars") - _number("purchase_price") * _number("quantity")
            )
            > tolerance,
        },
    }


def business_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """Failing rows per check. Each table is scanned once, however many checks it has."""
    parts = []
    for table, checks in business_checks().items():
        if table not in tables:
            continue
        counted = tables[table].agg(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("check_name"), F.count_if(failed).alias("fail_count")
                    )
                    for name, failed in checks.items()
                ]
            ).alias("checks")
        )
        parts.append(counted.select(F.inline("checks")))
    return _union(parts).orderBy("check_name")


def business_rule(tables: dict[str, DataFrame], check: str) -> DataFrame:
    for table, checks in business_checks().items():
        if check in checks:
            return tables[table].agg(
                F.lit(check).alias("check_name"), F.count_if(checks[check]).alias("fail_count")
            )
    raise KeyError(check)


def date_ranges(tables: dict[str, DataFrame], period: Period) -> DataFrame:
    """First and last date, and rows outside the allowed range, of three extracts."""
    parts = []
    for table, (day, outside) in dated(period).items():
        parts.append(
            tables[table].agg(
                F.lit(table).alias("table_name"),
                F.min(day).alias("min_date"),
                F.max(day).alias("max_date"),
                F.count_if(outside).alias("out_of_range"),
            )
        )
    return _union(parts)


def dated(period: Period) -> dict[str, tuple[Column, Column]]:
    """Per extract with a checked date: the date, and whether it is outside the allowed range."""
    # The checked column and the first allowed day of each extract.
    checked: list[tuple[str, str, dt.date]] = [
        ("raw_sales", "sales_date", period.start),
        ("raw_purchases", "po_date", period.purchases_start),
        ("raw_invoice_purchases", "invoice_date", period.purchases_start),
    ]
    out = {}
    for table, column, first in checked:
        day = cleaned(column).try_cast("date")
        out[table] = (day, (day < F.lit(first)) | (day > F.lit(period.end)))
    return out


def duplicates(df: DataFrame, keys: list[str], top: int | None = REPORT_TOP_N) -> DataFrame:
    """Key groups that occur more than once, most frequent first."""
    repeated = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("dup_count"))
        .filter("dup_count > 1")
        .orderBy(F.desc("dup_count"), *[F.asc_nulls_last(k) for k in keys])
    )
    return repeated.limit(top) if top else repeated


def orphan_count(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct child keys without a parent. Reduced to distinct keys before the join,
    so a key that fills a third of the rows is one row when it is shuffled."""
    return (
        child.select(key)
        .filter(F.col(key).isNotNull())
        .distinct()
        .join(parent.select(key).distinct(), key, "left_anti")
        .agg(F.count(F.lit(1)).alias(name))
    )


def vendor_whitespace(df: DataFrame, top: int | None = REPORT_TOP_N) -> DataFrame:
    """Vendor names with leading or trailing blanks, longest first."""
    raw_len, trimmed_len = F.length("vendor_name"), F.length(F.trim("vendor_name"))
    names = (
        df.select("vendor_name")
        .filter(raw_len != trimmed_len)
        .distinct()
        .select("vendor_name", raw_len.alias("raw_len"), trimmed_len.alias("trimmed_len"))
        .orderBy(F.desc("raw_len"), "vendor_name")
    )
    return names.limit(top) if top else names


def reconcile(raw: dict[str, DataFrame], staged: dict[str, DataFrame]) -> DataFrame:
    """Rows per staging table against its raw table."""
    left = row_counts({n.replace("raw_", "stg_"): df for n, df in raw.items()})
    right = row_counts(staged)
    delta = F.col("row_count") - F.col("raw_row_count")
    return (
        right.join(left.withColumnRenamed("row_count", "raw_row_count"), "table_name", "left")
        .select(
            "table_name",
            "row_count",
            "raw_row_count",
            delta.alias("delta"),
            F.coalesce(delta == 0, F.lit(False)).alias("ok"),
        )
        .orderBy("table_name")
    )


def snapshot_probe(
    snapshot: DataFrame,
    dim_store: DataFrame,
    dim_product: DataFrame,
    store: int | None = None,
    brand: int | None = None,
) -> DataFrame:
    """Rows and units by snapshot type, for one store and brand or for each pair."""
    stores = dim_store.select("store_sk", "store_number")
    products = dim_product.select("product_sk", "brand")
    if store is not None:
        stores = stores.filter(F.col("store_number") == store)
    if brand is not None:
        products = products.filter(F.col("brand") == brand)
    per_pair = snapshot.groupBy("product_sk", "store_sk", "snapshot_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity_on_hand").alias("qty")
    )
    return (
        per_pair.join(stores, "store_sk")
        .join(products, "product_sk")
        .select("store_number", "brand", "snapshot_type", "n", "qty")
    )
