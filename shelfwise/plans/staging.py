"""Raw text to typed tables, one projection per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import Period
from shelfwise.functions.casting import (
    COUNT_OR_PRICE,
    DATE,
    KEY,
    MONEY,
    carried_over,
    defensive_cast,
    gross_margin_pct,
    is_junk,
    zero_to_null,
)

TRIMMED = "trimmed"
TEXT = "text"

# Staged name -> (raw name, target type), in column order.
STAGED: dict[str, dict[str, tuple[str, str]]] = {
    "stg_sales": {
        "inventory_id": ("inventory_id", TEXT),
        "store": ("store", KEY),
        "brand": ("brand", KEY),
        "description": ("description", TEXT),
        "size": ("size", TEXT),
        "volume_ml": ("volume", COUNT_OR_PRICE),
        "classification": ("classification", "int"),
        "sales_quantity": ("sales_quantity", COUNT_OR_PRICE),
        "sales_dollars": ("sales_dollars", MONEY),
        "sales_price": ("sales_price", COUNT_OR_PRICE),
        "excise_tax": ("excise_tax", COUNT_OR_PRICE),
        "sales_date": ("sales_date", DATE),
        "vendor_number": ("vendor_no", KEY),
        "vendor_name": ("vendor_name", TRIMMED),
    },
    "stg_purchases": {
        "inventory_id": ("inventory_id", TEXT),
        "store": ("store", KEY),
        "brand": ("brand", KEY),
        "description": ("description", TEXT),
        "size": ("size", TEXT),
        "classification": ("classification", "int"),
        "vendor_number": ("vendor_number", KEY),
        "vendor_name": ("vendor_name", TRIMMED),
        "purchase_price": ("purchase_price", COUNT_OR_PRICE),
        "quantity": ("quantity", COUNT_OR_PRICE),
        "dollars": ("dollars", MONEY),
        "po_number": ("po_number", KEY),
        "po_date": ("po_date", DATE),
        "receiving_date": ("receiving_date", DATE),
        "invoice_date": ("invoice_date", DATE),
        "pay_date": ("pay_date", DATE),
    },
    "stg_beg_inventory": {
        "inventory_id": ("inventory_id", TEXT),
        "store": ("store", KEY),
        "city": ("city", TEXT),
        "brand": ("brand", KEY),
        "description": ("description", TEXT),
        "size": ("size", TEXT),
        "on_hand": ("on_hand", COUNT_OR_PRICE),
        "price": ("price", COUNT_OR_PRICE),
        "start_date": ("start_date", DATE),
    },
    "stg_end_inventory": {
        "inventory_id": ("inventory_id", TEXT),
        "store": ("store", KEY),
        "city": ("city", TEXT),
        "brand": ("brand", KEY),
        "description": ("description", TEXT),
        "size": ("size", TEXT),
        "on_hand": ("on_hand", COUNT_OR_PRICE),
        "price": ("price", COUNT_OR_PRICE),
        "end_date": ("end_date", DATE),
    },
    "stg_purchase_prices": {
        "brand": ("brand", KEY),
        "description": ("description", TEXT),
        "size": ("size", TEXT),
        "volume_ml": ("volume", COUNT_OR_PRICE),
        "classification": ("classification", "int"),
        "retail_price": ("price", COUNT_OR_PRICE),
        "purchase_price": ("purchase_price", COUNT_OR_PRICE),
        "vendor_number": ("vendor_number", KEY),
        "vendor_name": ("vendor_name", TRIMMED),
    },
    "stg_invoice_purchases": {
        "vendor_number": ("vendor_number", KEY),
        "vendor_name": ("vendor_name", TRIMMED),
        "invoice_date": ("invoice_date", DATE),
        "po_number": ("po_number", KEY),
        "po_date": ("po_date", DATE),
        "pay_date": ("pay_date", DATE),
        "quantity": ("quantity", COUNT_OR_PRICE),
        "dollars": ("dollars", MONEY),
        "freight": ("freight", COUNT_OR_PRICE),
        "approval": ("approval", TEXT),
    },
}
STAGED_FROM = {name: name.replace("stg_", "raw_") for name in STAGED}
LOAD_STAMP = "stg_loaded_at"


def _staged_column(raw: str, kind: str, strict: bool) -> Column:
    if kind == TEXT:
        return F.col(raw)
    if kind == TRIMMED:
        return F.trim(F.col(raw))
    return defensive_cast(raw, kind, strict)


def staged_columns(raw: DataFrame, table: str, names: list[str], strict: bool = True) -> DataFrame:
    """Some columns of the typed table, from raw rows that need not have the others."""
    return raw.select(*[_staged_column(*STAGED[table][n], strict).alias(n) for n in names])


def stage(raw: DataFrame, table: str, period: Period, strict: bool = True) -> DataFrame:
    """The typed table. Narrow: one scan, no shuffle. Junk fails the job when ``strict``."""
    staged = staged_columns(raw, table, list(STAGED[table]), strict)
    if table == "stg_purchase_prices":
        retail, cost = F.col("retail_price"), F.col("purchase_price")
        staged = staged.withColumns(
            {
                "retail_price": zero_to_null(retail),
                "purchase_price": zero_to_null(cost),
                "gross_margin_pct": gross_margin_pct(retail, cost),
            }
        )
    if table == "stg_invoice_purchases":
        staged = staged.withColumn(
            "is_carryover_invoice", carried_over(F.col("invoice_date"), period.end)
        )
    return staged


def stamped(staged: DataFrame) -> DataFrame:
    """With the load time, which stored tables carry and comparisons leave out."""
    return staged.withColumn(LOAD_STAMP, F.current_timestamp())


def _junk(table: str) -> Column:
    """The raw columns of ``table`` whose value cannot be cast."""
    typed = [(r, k) for r, k in STAGED[table].values() if k not in (TEXT, TRIMMED)]
    return F.filter(
        F.array(*[F.when(is_junk(r, k), F.lit(r)) for r, k in typed]), lambda c: c.isNotNull()
    )


def quarantine(raw: DataFrame, table: str) -> DataFrame:
    """Raw rows holding a value that cannot be cast, with the offending columns."""
    return raw.withColumn("junk_columns", _junk(table)).filter(F.size("junk_columns") > 0)


def clean(raw: DataFrame, table: str) -> DataFrame:
    """The raw rows that ``quarantine`` leaves."""
    return raw.filter(F.size(_junk(table)) == 0)


def junk_counts(raw: dict[str, DataFrame]) -> DataFrame:
    """Rows that cannot be cast, per raw table and column, in one pass per table."""
    parts = []
    for table, source in STAGED_FROM.items():
        typed = [(r, k) for r, k in STAGED[table].values() if k not in (TEXT, TRIMMED)]
        counted = raw[source].agg(
            F.array(
                *[
                    F.struct(
                        F.lit(source).alias("table_name"),
                        F.lit(r).alias("column_name"),
                        F.count_if(is_junk(r, k)).alias("junk_rows"),
                    )
                    for r, k in typed
                ]
            ).alias("columns")
        )
        parts.append(counted.select(F.inline("columns")))
    return reduce(DataFrame.unionByName, parts)
