"""Business labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.config import DEAD_STOCK_ALERT_RATE, LOW_STOCK_FACTOR, STOCKOUT_ALERT_RATE

# Labels shown in the reports, in order of their sort number.
ABC_CLASSES = ("A", "B", "C")
UNCLASSIFIED = "Unclassified"
PRIORITY_GROUPS = ("A - Critical", "B - Important", "C - Long Tail", "Review - Unclassified")
ALERTS = ("Out of Stock", "Reorder Now", "Low Stock", "OK")
NOT_CARRIED = "Not Carried"
OUT_OF_STOCK_ACTIVE = "Out of Stock (Active SKU)"
DISCONTINUED = "Discontinued"
DEAD_STOCK = "Dead Stock"
ACTIVE = "Active"
HEALTHY = "Healthy"
NO_SNAPSHOT_HAS_SALES = "No Snapshot, Has Sales"
NO_RECORD = "No Record"
HAS_SNAPSHOT = "Has Snapshot"
STABLE = "Stable"
DELISTED = "Sold Out / Delisted"
NEW = "New Introduction"
NO_INVENTORY_RECORD = "No Inventory Record (DSD?)"
QUADRANTS = ("Critical", "Replenishment Issue", "Assortment Issue", "Healthy")


def _by_class(values) -> Column:
    abc = F.col("abc_class")
    picked = F.when(abc == ABC_CLASSES[0], values[0])
    for label, value in zip(ABC_CLASSES[1:], values[1:]):
        picked = picked.when(abc == label, value)
    return picked.otherwise(values[len(ABC_CLASSES)])


def abc_display() -> Column:
    return F.coalesce(F.col("abc_class"), F.lit(UNCLASSIFIED))


def abc_sort() -> Column:
    return _by_class([1, 2, 3, 4])


def abc_priority_group() -> Column:
    return _by_class([F.lit(g) for g in PRIORITY_GROUPS])


def none_or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)) == 0


def alert_code(stock: Column, rop: Column) -> Column:
    """1 out of stock, 2 reorder, 3 low, 4 fine; 4 too when either side is unknown."""
    return (
        F.when(stock.isNull() | rop.isNull(), 4)
        .when(stock <= 0, 1)
        .when(stock.cast("double") <= rop, 2)
        .when(stock.cast("double") <= rop * F.lit(float(LOW_STOCK_FACTOR)), 3)
        .otherwise(4)
        .cast("int")
    )


def alert_label(code: Column) -> Column:
    labelled = F.when(code == 1, ALERTS[0])
    for number, label in enumerate(ALERTS[1:], start=2):
        labelled = labelled.when(code == number, label)
    return labelled


def alert_sort(label: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(a) for a in ALERTS]), label)
    return F.when(position > 0, position.cast("int")).otherwise(F.lit(5))


def dead_stock_flag(stock: Column, dead_value: Column) -> Column:
    """NULL where nothing is recorded, so that an empty shelf is not called active."""
    return F.when(stock.isNotNull(), F.when(dead_value > 0, DEAD_STOCK).otherwise(ACTIVE))


def inventory_status(stock: Column, sold90: Column) -> Column:
    return (
        F.when(stock.isNull(), NOT_CARRIED)
        .when((stock == 0) & (sold90 > 0), OUT_OF_STOCK_ACTIVE)
        .when((stock == 0) & none_or_zero(sold90), DISCONTINUED)
        .when((stock > 0) & none_or_zero(sold90), DEAD_STOCK)
        .otherwise(HEALTHY)
    )


def stock_record_status(ending_rows: Column, sold90: Column) -> Column:
    return (
        F.when(ending_rows.isNull() & sold90.isNotNull(), NO_SNAPSHOT_HAS_SALES)
        .when(ending_rows.isNull(), NO_RECORD)
        .otherwise(HAS_SNAPSHOT)
    )


def lifecycle_status(beginning_rows: Column, ending_rows: Column) -> Column:
    beg, end = beginning_rows > 0, ending_rows > 0
    return (
        F.when(beg & end, STABLE)
        .when(beg & ending_rows.isNull(), DELISTED)
        .when(beginning_rows.isNull() & end, NEW)
        .otherwise(NO_INVENTORY_RECORD)
    )


def risk_priority(status: Column, record_status: Column) -> Column:
    return (
        F.when(status == DEAD_STOCK, 1)
        .when(record_status == NO_SNAPSHOT_HAS_SALES, 2)
        .when(status == OUT_OF_STOCK_ACTIVE, 3)
        .when(status == NOT_CARRIED, 4)
        .when(status == HEALTHY, 5)
        .otherwise(99)
    )


def risk_quadrant(stockout_rate: Column, dead_pct: Column) -> Column:
    short = F.coalesce(stockout_rate > STOCKOUT_ALERT_RATE, F.lit(False))
    dead = F.coalesce(dead_pct > DEAD_STOCK_ALERT_RATE, F.lit(False))
    return (
        F.when(short & dead, QUADRANTS[0])
        .when(short, QUADRANTS[1])
        .when(dead, QUADRANTS[2])
        .otherwise(QUADRANTS[3])
    )
