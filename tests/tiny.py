"""A warehouse small enough to check by hand: calendar 2016, stores 1-3, brands 10-60."""

from shelfwise.config import CALENDAR_2016
from shelfwise.plans.warehouse import Warehouse

# store, brand, date, quantity, price
SALES = [
    ("1", "10", "2016-01-01", "4", "10"),
    ("1", "10", "2016-12-31", "2", "10"),
    ("2", "10", "2016-10-02", "5", "10"),  # one day before the 90-day window
    ("2", "10", "2016-10-03", "1", "10"),  # its first day
    ("1", "20", "2016-06-01", "3", "5"),
    ("1", "30", "2016-12-01", "7", "2"),  # sold here, no stock record
    ("3", "50", "2016-12-20", "1", "4"),  # not on the price list
]
# store, city, brand, on hand, price
BEGINNING = [("1", "ALPHA", "10", "8", "10"), ("2", None, "20", "6", "5")]
ENDING = [
    ("1", "ALPHA", "10", "0", "10"),
    ("2", None, "10", "9", "10"),
    ("1", "ALPHA", "20", "12", "5"),
    ("2", None, "40", "-2", "1"),
    ("2", None, "60", "5", "3"),  # a product nobody knows
    ("2", None, "20", "0", "5"),
]
# brand, retail, cost
PRICES = [("10", "10", "6"), ("20", "5", "0"), ("30", "2", "1"), ("40", "1", "0.5")]


def raw_tables(raw):
    def stock(table, rows, date_column, day):
        return raw(
            table,
            [
                {
                    "inventory_id": f"{s}_{c}_{b}",
                    "store": s,
                    "city": c,
                    "brand": b,
                    "on_hand": q,
                    "price": p,
                    date_column: day,
                }
                for s, c, b, q, p in rows
            ],
        )

    return {
        "raw_sales": raw(
            "raw_sales",
            [
                {
                    "inventory_id": f"{s}_X_{b}",
                    "store": s,
                    "brand": b,
                    "description": f"item {b}",
                    "sales_date": d,
                    "sales_quantity": q,
                    "sales_price": p,
                    "sales_dollars": str(int(q) * int(p)),
                    "vendor_no": "7",
                    "vendor_name": "ACME  ",
                }
                for s, b, d, q, p in SALES
            ],
        ),
        "raw_purchases": raw("raw_purchases", [{"vendor_number": "7", "vendor_name": "ACME"}]),
        "raw_invoice_purchases": raw(
            "raw_invoice_purchases", [{"vendor_number": "3", "vendor_name": "ZETA "}]
        ),
        "raw_beg_inventory": stock("raw_beg_inventory", BEGINNING, "start_date", "2016-01-01"),
        "raw_end_inventory": stock("raw_end_inventory", ENDING, "end_date", "2016-12-31"),
        "raw_purchase_prices": raw(
            "raw_purchase_prices",
            [{"brand": b, "price": r, "purchase_price": c} for b, r, c in PRICES],
        ),
    }


def warehouse(spark, raw, folder):
    return Warehouse.over_raw(spark, raw_tables(raw), CALENDAR_2016, folder)
