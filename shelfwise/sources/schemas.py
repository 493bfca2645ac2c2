"""Contracts of the raw tables: every column is text until staging casts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the six extracts, in file order.
RAW_COLUMNS: dict[str, list[str]] = {
    "raw_sales": (
        "inventory_id store brand description size sales_quantity sales_dollars sales_price "
        "sales_date volume classification excise_tax vendor_no vendor_name"
    ).split(),
    "raw_purchases": (
        "inventory_id store brand description size vendor_number vendor_name po_number po_date "
        "receiving_date invoice_date pay_date purchase_price quantity dollars classification"
    ).split(),
    "raw_beg_inventory": (
        "inventory_id store city brand description size on_hand price start_date"
    ).split(),
    "raw_end_inventory": (
        "inventory_id store city brand description size on_hand price end_date"
    ).split(),
    "raw_purchase_prices": (
        "brand description price size volume classification purchase_price vendor_number "
        "vendor_name"
    ).split(),
    "raw_invoice_purchases": (
        "vendor_number vendor_name invoice_date po_number po_date pay_date quantity dollars "
        "freight approval"
    ).split(),
}
RAW_TABLES = tuple(RAW_COLUMNS)


def text_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS[table]])


def contract_report(spark: SparkSession, found: dict[str, DataFrame]) -> DataFrame:
    """Missing, extra and wrongly typed columns per raw table; no rows when all is well."""
    rows = []
    for table, expected in RAW_COLUMNS.items():
        types = dict(found[table].dtypes) if table in found else {}
        rows += [(table, c, "missing") for c in expected if c not in types]
        rows += [(table, c, "extra") for c in types if c not in expected]
        rows += [(table, c, "not text") for c in expected if types.get(c, "string") != "string"]
    return spark.createDataFrame(rows, "table_name string, column_name string, problem string")


def column_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Table, column, type and position, with the number of filled values per column.

    One pass per table; the schema part alone comes from the catalog.
    """
    parts = []
    for table, df in sorted(tables.items()):
        filled = df.agg(
            F.array(
                *[
                    F.struct(
                        F.lit(table).alias("table_name"),
                        F.lit(name).alias("column_name"),
                        F.lit(kind).alias("data_type"),
                        F.lit(position).alias("ordinal_position"),
                        F.count(F.col(f"`{name}`")).alias("filled_rows"),
                    )
                    for position, (name, kind) in enumerate(df.dtypes, start=1)
                ]
            ).alias("columns")
        )
        parts.append(filled.select(F.inline("columns")))
    audit = parts[0]
    for part in parts[1:]:
        audit = audit.unionByName(part)
    return audit.orderBy("table_name", "ordinal_position")
