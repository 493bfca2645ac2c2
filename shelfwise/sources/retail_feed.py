"""The six raw extracts, derived from the order tables (region ... lineitem).

Every order line is a purchase line and a sales line; a returned line is a sale of negative
quantity and dollars. The opening and the closing stock count cover every line, by line
status. A SKU (brand) is a part in one of its pack sizes, numbered like the order lines.

No row is left out. Where the extracts have to disagree with each other, as real ones do, a
value is empty instead: the price list gives no brand for promotional parts, invoices of
suppliers in debt carry no vendor number, large promotional packs are sold and counted without
a brand, one store writes no inventory numbers, and open lines have no receiving date.

Each extract is described once, as expressions that mean the same to any SQL engine;
the Spark side assembles them with the DataFrame API.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.config import Period

# Stock counts are taken on the first and the last day of the period.
PERIOD = Period(dt.date(1995, 2, 1), dt.date(2001, 9, 30))
PACK_SIZES = 7

PACK = "CAST(l_partkey * 10 + l_linenumber AS STRING)"
BRAND = f"CASE WHEN p_type = 'PROMO' AND p_size > 45 THEN NULL ELSE {PACK} END"
STORE = "CAST(n_nationkey + 1 AS STRING)"
INVENTORY_ID = f"{STORE} || '_' || NULLIF(n_name, 'NATION_7') || '_' || {PACK}"
DESCRIPTION = "p_name || ' x' || CAST(l_linenumber AS STRING)"
SIZE = "CAST(p_size * 25 * l_linenumber AS STRING) || 'mL'"
CITY = "NULLIF(n_name, 'NATION_7')"
CLASSIFICATION = "CASE WHEN p_size > 25 THEN '2' ELSE '1' END"
PACK_PRICE = (
    "CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(l_linenumber AS DECIMAL(2,0)) "
    "AS DECIMAL(10,2))"
)
PACK_COST = (
    f"CAST({PACK_PRICE} * CAST(50 + p_size AS DECIMAL(3,0)) * CAST(0.01 AS DECIMAL(3,2)) "
    "AS DECIMAL(10,2))"
)
QUANTITY = "CAST(l_quantity AS DECIMAL(10,2))"
SIGNED = "CASE WHEN l_returnflag = 'R' THEN -{0} ELSE {0} END"
# goods returned or accepted lie in stock; unexplained lines at full price are shrinkage
COUNTED = (
    f"CASE WHEN l_returnflag <> 'N' THEN {QUANTITY} WHEN l_discount = 0 THEN -{QUANTITY} "
    "ELSE CAST(0 AS DECIMAL(10,2)) END"
)

SALES = {
    "inventory_id": INVENTORY_ID,
    "store": STORE,
    "brand": BRAND,
    "description": DESCRIPTION,
    "size": SIZE,
    "sales_quantity": f"CAST({SIGNED.format(QUANTITY)} AS STRING)",
    "sales_dollars": (
        f"CAST({SIGNED.format('CAST(l_extendedprice AS DECIMAL(12,2))')} AS STRING)"
    ),
    "sales_price": (
        "CAST(CAST(FLOOR(ROUND(l_extendedprice * 100) / l_quantity) AS DECIMAL(12,0)) "
        "* CAST(0.01 AS DECIMAL(3,2)) AS STRING)"
    ),
    "sales_date": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "volume": (
        "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Unknown' WHEN l_tax = 0 THEN '' "
        "ELSE CAST(p_size * 25 * l_linenumber AS STRING) END"
    ),
    "classification": CLASSIFICATION,
    "excise_tax": "CAST(CAST(l_tax * 10 AS DECIMAL(10,2)) AS STRING)",
    "vendor_no": "CAST(l_suppkey AS STRING)",
    "vendor_name": "rpad(s_name, 18 + s_nationkey, ' ')",
}
PURCHASES = {
    "inventory_id": INVENTORY_ID,
    "store": STORE,
    "brand": BRAND,
    "description": DESCRIPTION,
    "size": SIZE,
    "vendor_number": "CAST(l_suppkey AS STRING)",
    "vendor_name": "s_name",
    "po_number": "CAST(l_orderkey AS STRING)",
    "po_date": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "receiving_date": (
        "CASE WHEN l_linestatus = 'F' THEN CAST(CAST(l_shipdate AS DATE) AS STRING) END"
    ),
    "invoice_date": "CAST(CAST(CAST(l_shipdate AS DATE) + INTERVAL 7 DAY AS DATE) AS STRING)",
    "pay_date": "CAST(CAST(CAST(l_shipdate AS DATE) + INTERVAL 35 DAY AS DATE) AS STRING)",
    "purchase_price": f"CAST({PACK_COST} AS STRING)",
    "quantity": f"CAST({QUANTITY} AS STRING)",
    "dollars": (
        f"CAST(CAST({PACK_COST} * CAST(l_quantity AS DECIMAL(4,0)) + CASE WHEN l_discount = 0 "
        "AND l_tax = 0 THEN 1 ELSE 0 END AS DECIMAL(12,2)) AS STRING)"
    ),
    "classification": CLASSIFICATION,
}
INVENTORY = {
    "inventory_id": INVENTORY_ID,
    "store": STORE,
    "city": CITY,
    "brand": BRAND,
    "description": DESCRIPTION,
    "size": SIZE,
    "on_hand": "CAST(CAST(counted AS DECIMAL(18,2)) AS STRING)",
    "price": f"CAST({PACK_PRICE} AS STRING)",
}
PRICES = {
    "brand": f"CASE WHEN p_type <> 'PROMO' THEN {PACK} END",
    "description": DESCRIPTION,
    "price": f"CASE WHEN p_size = 1 THEN '0' ELSE CAST({PACK_PRICE} AS STRING) END",
    "size": SIZE,
    "volume": "CAST(p_size * 25 * l_linenumber AS STRING)",
    "classification": CLASSIFICATION,
    "purchase_price": f"CAST({PACK_COST} AS STRING)",
    "vendor_number": "CAST(first_supplier AS STRING)",
    "vendor_name": "s_name",
}
BILLED_AS = "CASE WHEN s_acctbal >= 0 THEN vendor_number END"
INVOICES = {
    "vendor_number": "vendor_number",
    "vendor_name": "MAX(vendor_name)",
    "invoice_date": "MAX(invoice_date)",
    "po_number": "po_number",
    "po_date": "MIN(po_date)",
    "pay_date": "MAX(pay_date)",
    "quantity": "CAST(SUM(CAST(quantity AS DECIMAL(10,2))) AS STRING)",
    "dollars": "CAST(SUM(CAST(dollars AS DECIMAL(12,2))) AS STRING)",
    "freight": (
        "CAST(CAST(SUM(CAST(quantity AS DECIMAL(10,2))) * CAST(0.5 AS DECIMAL(2,1)) "
        "AS DECIMAL(18,2)) AS STRING)"
    ),
    "approval": "CASE WHEN SUM(CAST(dollars AS DECIMAL(12,2))) > 100000 THEN 'Approver' END",
}
COUNT_STATUS = {"raw_beg_inventory": "F", "raw_end_inventory": "O"}


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


LINE_COLUMNS = (
    "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate o_orderdate o_orderpriority p_name p_size p_type "
    "p_retailprice s_name s_nationkey source_name n_nationkey n_name"
).split()


def _at_source(lines: DataFrame) -> DataFrame:
    """Lines as seen by the store they were delivered to."""
    return lines.drop("n_nationkey", "n_name").withColumns(
        {"n_nationkey": F.col("s_nationkey"), "n_name": F.col("source_name")}
    )


def _counted(lines: DataFrame, status: str) -> DataFrame:
    return _at_source(lines).filter(F.col("l_linestatus") == status)


def _with_days(df: DataFrame, column: str) -> DataFrame:
    """The extracts tell days only."""
    return df.withColumn(column, F.col(column).cast("date"))


@dataclass(frozen=True)
class RetailFeed:
    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Every order line with its order, part and supplier, the store of the customer's
        nation and the source of the supplier's. Written once; all extracts but the price
        list read it.

        Lines are shuffled for their orders and for their parts, as narrow as they can be: days
        stand for times, and nations, which are few, come last, so that their names do not travel
        and that the planner knows the size of the suppliers, which it does not of a join. Behind
        the parts, the lines of a part lie together, so that groups by product shrink before they
        are shuffled."""
        nation = self._table("nation").select("n_nationkey", "n_name")
        source = nation.select(
            F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source_name")
        )
        customers = self._table("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
        orders = self._table("orders").join(customers, F.expr("o_custkey = c_custkey"))
        return (
            _with_days(self._table("lineitem"), "l_shipdate")
            .join(_with_days(orders, "o_orderdate"), F.expr("l_orderkey = o_orderkey"))
            .join(self._table("part"), F.expr("l_partkey = p_partkey"))
            .join(self._table("supplier"), F.expr("l_suppkey = s_suppkey"))
            .join(source, "s_nationkey")
            .join(nation, "n_nationkey")
            .select(*LINE_COLUMNS)
        )

    def sales(self, lines: DataFrame) -> DataFrame:
        """Every line, at the store of the customer's nation."""
        return _project(lines, SALES)

    def purchases(self, lines: DataFrame) -> DataFrame:
        """Every line, delivered to the store of the supplier's nation."""
        return _project(_at_source(lines), PURCHASES)

    def counted_places(self, lines: DataFrame, table: str) -> DataFrame:
        """Store and city of every line in a stock count. Its positions have no others, but have to
        be added up first."""
        return _project(_counted(lines, COUNT_STATUS[table]), {c: INVENTORY[c] for c in ("store", "city")})

    def _stock_count(self, lines: DataFrame, status: str, date_column: str, day: dt.date) -> DataFrame:
        """What else describes a position follows from its part and store. Lines are laid out by
        part: those of a part lie together already and pack well so."""
        keys = ["n_nationkey", "l_partkey", "l_linenumber"]
        described = ["n_name", "p_name", "p_size", "p_type", "p_retailprice"]
        positions = (
            _counted(lines, status)
            .repartition("l_partkey")
            .groupBy(*keys, *described)
            .agg(F.sum(F.expr(COUNTED)).alias("counted"))
        )
        return _project(positions, {**INVENTORY, date_column: f"'{day}'"})

    def beg_inventory(self, lines: DataFrame) -> DataFrame:
        status = COUNT_STATUS["raw_beg_inventory"]
        return self._stock_count(lines, status, "start_date", PERIOD.start)

    def end_inventory(self, lines: DataFrame) -> DataFrame:
        status = COUNT_STATUS["raw_end_inventory"]
        return self._stock_count(lines, status, "end_date", PERIOD.end)

    def purchase_prices(self, lines: DataFrame) -> DataFrame:
        """Each part in each pack size; its vendor is the first that shipped it.

        Vendors are found for all pack sizes of a part at once, so that parts meet one row each and
        become packs behind the join."""
        sizes = range(1, PACK_SIZES + 1)
        shipped = F.col("l_suppkey")
        vendors = lines.groupBy("l_partkey").agg(
            *[F.min(F.when(F.col("l_linenumber") == k, shipped)).alias(f"first_{k}") for k in sizes]
        )
        by_size = F.array(*[F.col(f"first_{k}") for k in sizes])
        packs = (
            self._table("part")
            .join(vendors, F.expr("p_partkey = l_partkey"), "left")
            .select(
                *["p_name", "p_size", "p_type", "p_retailprice", F.col("p_partkey").alias("l_partkey")],
                F.posexplode(by_size).alias("place", "first_supplier"),
            )
            .withColumn("l_linenumber", F.col("place") + 1)
        )
        return _project(
            packs.join(self._table("supplier"), F.expr("first_supplier = s_suppkey"), "left"), PRICES
        )

    def invoice_purchases(self, purchases: DataFrame) -> DataFrame:
        """One invoice per vendor and order; together for vendors that may not be named."""
        balance = self._table("supplier").select(
            F.col("s_suppkey").cast("string").alias("vendor_number"), "s_acctbal"
        )
        keys = ["vendor_number", "po_number"]
        return (
            purchases.join(balance, "vendor_number")
            .withColumn("vendor_number", F.expr(BILLED_AS))
            # the maximum of a text sorts its input, and lines of an order seldom share a vendor:
            # they are sorted once, behind the shuffle
            .repartition(*keys)
            .groupBy(*keys)
            .agg(*[F.expr(sql).alias(c) for c, sql in INVOICES.items() if c not in keys])
            .select(*INVOICES)
        )
