"""The same results in plain DuckDB SQL over the order tables, for checking.

Each query is a WITH chain: feed, staging, marts, then the query. The SQL says things
the plain way (full outer joins, single windows, a row per store for the alert), so it
does not repeat the shapes the Spark jobs use. Only the feed's column expressions,
which define the input, are shared.
"""

from __future__ import annotations

import re

from shelfwise.operators.quality import BLANK_IS_MISSING, REQUIRED
from shelfwise.plans import staging
from shelfwise.sources import retail_feed as feed
from shelfwise.sources.schemas import RAW_COLUMNS, RAW_TABLES


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def _stock_count(status: str, date_column: str, day) -> str:
    columns = {**feed.INVENTORY, date_column: f"'{day}'"}
    return f"""
SELECT {_columns(columns)}
FROM (SELECT s_nationkey, l_partkey, l_linenumber, SUM({feed.COUNTED}) AS counted
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      WHERE l_linestatus = '{status}' GROUP BY 1, 2, 3)
JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey"""


def _feed_ctes() -> dict[str, str]:
    period = feed.PERIOD
    return {
        "raw_sales": f"""
SELECT {_columns(feed.SALES)}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey""",
        "raw_purchases": f"""
SELECT {_columns(feed.PURCHASES)}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
        "raw_beg_inventory": _stock_count("F", "start_date", period.start),
        "raw_end_inventory": _stock_count("O", "end_date", period.end),
        "raw_purchase_prices": f"""
SELECT {_columns(feed.PRICES)}
FROM (SELECT part.*, p_partkey AS l_partkey, unnest(range(1, {feed.PACK_SIZES + 1})) AS l_linenumber
      FROM part)
LEFT JOIN (SELECT l_partkey AS k, CAST(l_linenumber AS BIGINT) AS n, MIN(l_suppkey) AS first_supplier
           FROM lineitem GROUP BY 1, 2) ON l_partkey = k AND l_linenumber = n
LEFT JOIN supplier ON first_supplier = s_suppkey""",
        "raw_invoice_purchases": f"""
SELECT {_columns(feed.INVOICES)}
FROM (SELECT * REPLACE ({feed.BILLED_AS} AS vendor_number)
      FROM raw_purchases JOIN supplier ON vendor_number = CAST(s_suppkey AS STRING))
GROUP BY vendor_number, po_number""",
    }


def _staged(table: str) -> str:
    columns = {}
    for name, (raw, kind) in staging.STAGED[table].items():
        if kind == staging.TEXT:
            columns[name] = raw
        elif kind == staging.TRIMMED:
            columns[name] = f"TRIM({raw})"
        else:
            columns[name] = f"CAST(NULLIF(NULLIF(TRIM({raw}), ''), 'Unknown') AS {kind})"
    source = staging.STAGED_FROM[table]
    if table == "stg_purchase_prices":
        columns["retail_price"] = f"NULLIF({columns['retail_price']}, 0)"
        columns["purchase_price"] = f"NULLIF({columns['purchase_price']}, 0)"
        return f"""
SELECT *, CAST(ROUND((retail_price - purchase_price) * 100 / retail_price, 2) AS DECIMAL(18,2))
  AS gross_margin_pct FROM (SELECT {_columns(columns)} FROM {source})"""
    if table == "stg_invoice_purchases":
        return f"""
SELECT *, COALESCE(invoice_date > DATE '{feed.PERIOD.end}', FALSE) AS is_carryover_invoice
FROM (SELECT {_columns(columns)} FROM {source})"""
    return f"SELECT {_columns(columns)} FROM {source}"


MART_CTES = {
    "vendor_names": " UNION ALL ".join(
        f"SELECT vendor_number AS k, vendor_name AS v FROM stg_{t}"
        for t in ("sales", "purchases", "purchase_prices", "invoice_purchases")
    ),
    "dim_vendor": """
SELECT DENSE_RANK() OVER (ORDER BY k) AS vendor_sk, k AS vendor_number,
  (SELECT MAX(n.v) FROM vendor_names n WHERE n.k = d.k) AS vendor_name
FROM (SELECT DISTINCT k FROM vendor_names WHERE k IS NOT NULL) d""",
    "store_cities": """
SELECT store AS k, city AS v FROM stg_end_inventory UNION ALL
SELECT store, city FROM stg_beg_inventory UNION ALL SELECT store, NULL FROM stg_sales""",
    "dim_store": """
SELECT DENSE_RANK() OVER (ORDER BY k) AS store_sk, k AS store_number,
  (SELECT MAX(n.v) FROM store_cities n WHERE n.k = d.k) AS city
FROM (SELECT DISTINCT k FROM store_cities WHERE k IS NOT NULL) d""",
    "listed_products": """
SELECT brand, COUNT(*) AS n, COUNT(description) AS has_description, COUNT(size) AS has_size,
  COUNT(volume_ml) AS has_volume, COUNT(classification) AS has_class, MAX(description) AS description,
  MAX(size) AS size, MAX(volume_ml) AS volume_ml, MAX(classification) AS classification,
  MAX(retail_price) AS retail, MAX(purchase_price) AS cost, MAX(gross_margin_pct) AS margin
FROM stg_purchase_prices GROUP BY brand""",
    "sold_products": """
SELECT brand, MAX(description) AS description, MAX(size) AS size, MAX(volume_ml) AS volume_ml,
  MAX(classification) AS classification FROM stg_sales GROUP BY brand HAVING brand IS NOT NULL""",
    "all_brands": "SELECT brand FROM listed_products UNION SELECT brand FROM sold_products",
    "product_base": """
SELECT ROW_NUMBER() OVER (ORDER BY b.brand NULLS LAST) AS product_sk, b.brand,
  GREATEST(l.description, CASE WHEN COALESCE(l.has_description < l.n, TRUE) THEN s.description END)
    AS description,
  GREATEST(l.size, CASE WHEN COALESCE(l.has_size < l.n, TRUE) THEN s.size END) AS size,
  GREATEST(l.volume_ml, CASE WHEN COALESCE(l.has_volume < l.n, TRUE) THEN s.volume_ml END) AS volume_ml,
  GREATEST(l.classification, CASE WHEN COALESCE(l.has_class < l.n, TRUE) THEN s.classification END)
    AS classification,
  l.retail AS default_retail_price, l.cost AS default_cost_price, l.margin AS default_gross_margin_pct
FROM all_brands b LEFT JOIN listed_products l ON b.brand IS NOT DISTINCT FROM l.brand
LEFT JOIN sold_products s ON b.brand = s.brand""",
    "fact_sales": """
SELECT p.product_sk, d.store_sk, v.vendor_sk, s.inventory_id, s.sales_date, s.sales_quantity,
  s.sales_price, s.sales_dollars, s.excise_tax,
  CAST(s.sales_quantity * COALESCE(p.default_cost_price, 0) AS DECIMAL(21,4)) AS estimated_cogs
FROM stg_sales s LEFT JOIN product_base p ON s.brand = p.brand
LEFT JOIN dim_store d ON s.store = d.store_number
LEFT JOIN dim_vendor v ON s.vendor_number = v.vendor_number""",
    "fact_inventory_snapshot": """
SELECT p.product_sk, d.store_sk, c.inventory_id, c.snapshot_date, c.snapshot_type,
  c.on_hand AS quantity_on_hand, c.price AS snapshot_price,
  CAST(c.on_hand * c.price AS DECIMAL(21,4)) AS total_inventory_value
FROM (SELECT store, brand, inventory_id, on_hand, price, start_date AS snapshot_date,
        'BEGINNING' AS snapshot_type FROM stg_beg_inventory
      UNION ALL SELECT store, brand, inventory_id, on_hand, price, end_date, 'ENDING'
      FROM stg_end_inventory) c
LEFT JOIN product_base p ON c.brand = p.brand LEFT JOIN dim_store d ON c.store = d.store_number""",
    "abc_revenue": """
SELECT product_sk, SUM(sales_dollars) AS total_sales_dollars,
  SUM(CAST(sales_dollars * 100 AS BIGINT)) AS cents
FROM fact_sales WHERE sales_dollars IS NOT NULL GROUP BY product_sk""",
    "abc_running": """
SELECT product_sk, total_sales_dollars, grand_total, cumulative_sales,
  CASE WHEN total_cents <> 0
    THEN CAST((2000000 * cum_cents + total_cents) // (2 * total_cents) AS DOUBLE) / 10000.0 END
    AS cumulative_pct
FROM (SELECT *, SUM(total_sales_dollars) OVER () AS grand_total, SUM(cents) OVER () AS total_cents,
        SUM(total_sales_dollars) OVER w AS cumulative_sales, SUM(cents) OVER w AS cum_cents
      FROM abc_revenue
      WINDOW w AS (ORDER BY total_sales_dollars DESC NULLS LAST, product_sk NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "abc_labels": """
SELECT product_sk, cumulative_pct, CASE WHEN cumulative_pct <= 80 THEN 'A'
  WHEN cumulative_pct <= 95 THEN 'B' ELSE 'C' END AS abc_class FROM abc_running""",
    "dim_product": """
SELECT b.*, l.abc_class FROM product_base b LEFT JOIN abc_labels l ON b.product_sk = l.product_sk""",
    "dim_date": """
SELECT d AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
  CAST(month(d) AS INTEGER) AS month, rpad(monthname(d), 9, ' ') AS month_name,
  CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(dayofweek(d) AS INTEGER) AS day_of_week,
  rpad(dayname(d), 9, ' ') AS day_name, dayofweek(d) IN (0, 6) AS is_weekend
FROM (SELECT CAST(unnest(generate_series((SELECT MIN(sales_date) FROM fact_sales)::TIMESTAMP,
  (SELECT MAX(sales_date) FROM fact_sales)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d)""",
    "end_inv": """
SELECT product_sk, store_sk, SUM(quantity_on_hand) AS end_qty FROM fact_inventory_snapshot
WHERE snapshot_type = 'ENDING' GROUP BY product_sk, store_sk""",
    "sold_pairs": "SELECT DISTINCT product_sk, store_sk FROM fact_sales",
}

CTES: dict[str, str] = {
    **_feed_ctes(),
    **{t: _staged(t) for t in staging.STAGED},
    **MART_CTES,
}


def with_ctes(query: str, extra: dict[str, str] | None = None) -> str:
    """``query`` with the chain of CTEs it needs in front, in order."""
    known = {**CTES, **(extra or {})}
    seen: set[str] = set()
    used: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", sql)):
            if word in known and word not in seen:
                seen.add(word)
                visit(known[word])
                used.append(word)

    visit(query)
    chain = ",\n".join(f"{name} AS MATERIALIZED ({known[name]})" for name in used)
    return _steady_rounding(f"WITH {chain}\n{query}" if chain else query)


def _steady_rounding(sql: str) -> str:
    """ROUND(x, 1|2|4) of doubles, done on nine decimals: DuckDB rounds a double after
    multiplying it, which moves values that lie a last bit below a half."""
    start = sql.find("ROUND(")
    if start < 0:
        return sql
    depth, end = 1, start + len("ROUND(")
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    inside = _steady_rounding(sql[start + len("ROUND(") : end - 1])
    value, _, digits = inside.rpartition(",")
    if digits.strip() in ("1", "2", "4"):
        done = f"CAST(round(CAST({value} AS DECIMAL(38,9)),{digits}) AS DOUBLE)"
    else:
        done = f"round({inside})"
    return sql[:start] + done + _steady_rounding(sql[end:])


# -- data quality -------------------------------------------------------------------


def _counts(tables, label="row_count") -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS {label} FROM {t}" for t in tables
    )


def _nulls(table: str) -> str:
    parts = ["COUNT(*) AS total_rows"]
    for c in REQUIRED[table]:
        test = f"{c} IS NULL"
        if (table, c) in BLANK_IS_MISSING:
            test += f" OR {c} = ''"
        parts.append(f"COUNT(*) FILTER (WHERE {test}) AS null_{c}")
    return f"SELECT {', '.join(parts)} FROM {table}"


def _n(c: str) -> str:
    return f"TRY_CAST(NULLIF(NULLIF(TRIM({c}), ''), 'Unknown') AS DECIMAL(18,4))"


BUSINESS_RULES = {
    "dq03a_sales_qty_nonpositive": (
        "raw_sales - non-positive qty",
        f"{_n('sales_quantity')} <= 0",
    ),
    "dq03b_sales_dollars_negative": (
        "raw_sales - negative dollars",
        f"{_n('sales_dollars')} < 0",
    ),
    "dq03c_sales_price_mismatch": (
        "raw_sales - price calc mismatch",
        f"ABS({_n('sales_dollars')} - {_n('sales_quantity')} * {_n('sales_price')}) > 0.02",
    ),
    "dq03d_beg_on_hand_negative": (
        "raw_beg_inventory - negative on_hand",
        f"{_n('on_hand')} < 0",
    ),
    "dq03e_end_on_hand_negative": (
        "raw_end_inventory - negative on_hand",
        f"{_n('on_hand')} < 0",
    ),
    "dq03f_price_zero_or_null": (
        "raw_purchase_prices - zero or null price",
        f"{_n('price')} IS NULL OR {_n('price')} = 0",
    ),
    "dq03g_price_vs_cost_differ": (
        "raw_purchase_prices - price vs purchase_price differ",
        f"{_n('price')} <> {_n('purchase_price')}",
    ),
    "dq03h_purchase_dollars_mismatch": (
        "raw_purchases - dollar calc mismatch",
        f"ABS({_n('dollars')} - {_n('purchase_price')} * {_n('quantity')}) > 0.02",
    ),
}


def _rule(key: str) -> str:
    name, failed = BUSINESS_RULES[key]
    table = name.split(" - ")[0]
    return (
        f"SELECT '{name}' AS check_name, COUNT(*) AS fail_count FROM {table} WHERE {failed}"
    )


def _range(table: str, column: str, first) -> str:
    day = f"CAST({column} AS DATE)"
    return (
        f"SELECT '{table}' AS table_name, MIN({day}) AS min_date, MAX({day}) AS max_date, "
        f"COUNT(*) FILTER (WHERE {day} < DATE '{first}' OR {day} > DATE '{feed.PERIOD.end}') "
        f"AS out_of_range FROM {table}"
    )


def _orphans(child: str, parent: str, key: str, name: str) -> str:
    return (
        f"SELECT COUNT(DISTINCT c.{key}) AS {name} FROM {child} c LEFT JOIN {parent} p "
        f"ON c.{key} = p.{key} WHERE p.{key} IS NULL"
    )


def _audit() -> str:
    rows = []
    for table in RAW_TABLES:
        for position, column in enumerate(RAW_COLUMNS[table], start=1):
            rows.append(
                f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
                f"'string' AS data_type, {position} AS ordinal_position, "
                f"COUNT({column}) AS filled_rows FROM {table}"
            )
    return " UNION ALL ".join(rows)


def quality_sql() -> dict[str, str]:
    p = feed.PERIOD
    q = {
        "src08_column_audit": _audit(),
        "dq01_row_counts": _counts(RAW_TABLES),
        "dq02a_null_sales": _nulls("raw_sales"),
        "dq02b_null_purchases": _nulls("raw_purchases"),
        "dq02c_null_beg_inventory": _nulls("raw_beg_inventory"),
        "dq02d_null_end_inventory": _nulls("raw_end_inventory"),
        "dq02e_null_prices": _nulls("raw_purchase_prices"),
        "dq02f_null_invoices": _nulls("raw_invoice_purchases"),
        **{k: _rule(k) for k in BUSINESS_RULES},
        "dq03_business_rules": " UNION ALL ".join(_rule(k) for k in BUSINESS_RULES),
        "dq04_date_ranges": " UNION ALL ".join(
            [
                _range("raw_sales", "sales_date", p.start),
                _range("raw_purchases", "po_date", p.purchases_start),
                _range("raw_invoice_purchases", "invoice_date", p.purchases_start),
            ]
        ),
        "dq11_junk_values": " UNION ALL ".join(
            f"SELECT '{source}' AS table_name, '{raw}' AS column_name, COUNT(*) FILTER (WHERE "
            f"NULLIF(NULLIF(TRIM({raw}), ''), 'Unknown') IS NOT NULL AND "
            f"TRY_CAST(NULLIF(NULLIF(TRIM({raw}), ''), 'Unknown') AS {kind}) IS NULL) AS junk_rows "
            f"FROM {source}"
            for table, source in staging.STAGED_FROM.items()
            for raw, kind in staging.STAGED[table].values()
            if kind not in (staging.TEXT, staging.TRIMMED)
        ),
        "dq05a_dup_sales": """
SELECT inventory_id, sales_date, sales_quantity, COUNT(*) AS dup_count FROM raw_sales
GROUP BY 1, 2, 3 HAVING COUNT(*) > 1 ORDER BY dup_count DESC, 1, 2, 3 LIMIT 20""",
        "dq05b_dup_prices": """
SELECT brand, description, size, COUNT(*) AS dup_count FROM raw_purchase_prices
GROUP BY 1, 2, 3 HAVING COUNT(*) > 1 ORDER BY dup_count DESC, 1, 2, 3 LIMIT 20""",
        "dq05_dup_order_lines": """
SELECT l_orderkey, l_linenumber, COUNT(*) AS dup_count FROM lineitem
GROUP BY 1, 2 HAVING COUNT(*) > 1""",
        "dq06a_sales_not_in_beg": _orphans(
            "raw_sales", "raw_beg_inventory", "inventory_id", "sales_not_in_beg_inv"
        ),
        "dq06b_sales_not_in_end": _orphans(
            "raw_sales", "raw_end_inventory", "inventory_id", "sales_not_in_end_inv"
        ),
        "dq06c_vendor_not_in_invoice": _orphans(
            "raw_purchases",
            "raw_invoice_purchases",
            "vendor_number",
            "purchase_vendor_not_in_invoice",
        ),
        "dq07_vendor_whitespace": """
SELECT vendor_name, CAST(LENGTH(vendor_name) AS INTEGER) AS raw_len,
  CAST(LENGTH(TRIM(vendor_name)) AS INTEGER) AS trimmed_len
FROM raw_sales WHERE LENGTH(vendor_name) <> LENGTH(TRIM(vendor_name))
GROUP BY vendor_name ORDER BY raw_len DESC, vendor_name LIMIT 20""",
        "dq08_staging_row_audit": " UNION ALL ".join(
            f"SELECT '{s}' AS table_name, n AS row_count, r AS raw_row_count, n - r AS delta, "
            f"n = r AS ok FROM (SELECT COUNT(*) AS n FROM {s}), (SELECT COUNT(*) AS r FROM {t})"
            for s, t in staging.STAGED_FROM.items()
        ),
        "dq09_mart_row_counts": _counts(
            ["fact_sales", "fact_inventory_snapshot", "dim_product", "dim_store", "dim_vendor"]
        ),
        "dq10_snapshot_probe": """
SELECT d.store_number, p.brand, f.snapshot_type, COUNT(*) AS n,
  CAST(SUM(f.quantity_on_hand) AS DECIMAL(20,2)) AS qty
FROM fact_inventory_snapshot f JOIN dim_store d ON f.store_sk = d.store_sk
JOIN dim_product p ON f.product_sk = p.product_sk GROUP BY 1, 2, 3""",
    }
    return {k: with_ctes(v) for k, v in q.items()}


def layer_sql() -> dict[str, str]:
    q = {f"stg{i:02d}_{t[4:]}": f"SELECT * FROM {t}" for i, t in enumerate(staging.STAGED, 1)}
    q |= {
        "dim01_vendor": "SELECT * FROM dim_vendor",
        "dim02_store": "SELECT * FROM dim_store",
        "dim03_product": "SELECT *, CAST(NULL AS VARCHAR) AS abc_class FROM product_base",
        "dim04_date": "SELECT * FROM dim_date",
        "dim05_date_labels": """
SELECT *, strftime(date_key, '%b') AS month_name_short, month AS month_sort,
  strftime(date_key, '%Y-%m') AS year_month, 'Q' || CAST(quarter AS VARCHAR) AS quarter_label
FROM dim_date""",
        "dim06_abc_labels": """
SELECT *, COALESCE(abc_class, 'Unclassified') AS abc_class_display,
  CASE abc_class WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END AS abc_class_sort,
  CASE abc_class WHEN 'A' THEN 'A - Critical' WHEN 'B' THEN 'B - Important'
    WHEN 'C' THEN 'C - Long Tail' ELSE 'Review - Unclassified' END AS abc_priority_group
FROM dim_product""",
        "fact01_sales": "SELECT * FROM fact_sales",
        "fact02_inventory_snapshot": "SELECT * FROM fact_inventory_snapshot",
        "fact03_daily_moments": "\nUNION ALL ".join(_moments(*keys) for keys in MOMENTS_OF),
        "abc01_product_revenue": """
SELECT product_sk, CAST(total_sales_dollars AS DECIMAL(22,2)) AS total_sales_dollars
FROM abc_revenue""",
        "abc02_running_total": """
SELECT product_sk, CAST(total_sales_dollars AS DECIMAL(22,2)) AS total_sales_dollars,
  CAST(grand_total AS DECIMAL(32,2)) AS grand_total,
  CAST(cumulative_sales AS DECIMAL(32,2)) AS cumulative_sales, cumulative_pct FROM abc_running""",
        "dim03_in_ranges": "SELECT * FROM product_base",
        "abc03_labels": "SELECT * FROM abc_labels",
        "abc04_backfill": "SELECT * FROM dim_product",
        "abc05_verify": """
SELECT abc_class, COUNT(*) AS sku_count,
  ROUND(CAST(COUNT(*) * 100 AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 2) AS sku_pct,
  CAST(SUM(default_retail_price) AS DECIMAL(21,2)) AS sample_value
FROM dim_product GROUP BY abc_class""",
        "kpi_a2_sales_totals": """
SELECT CAST(ROUND(SUM(sales_dollars), 0) AS DECIMAL(28,0)) AS total_sales_revenue,
  CAST(SUM(sales_quantity) AS DECIMAL(28,2)) AS total_sales_qty,
  MIN(sales_date) AS date_start, MAX(sales_date) AS date_end FROM fact_sales""",
        "kpi_a3_turnover_dsi": """
SELECT CAST(ROUND(c, 0) AS DECIMAL(28,0)) AS total_cogs,
  CAST(ROUND(b, 0) AS DECIMAL(28,0)) AS beg_inventory_value,
  CAST(ROUND(e, 0) AS DECIMAL(28,0)) AS end_inventory_value,
  CAST(ROUND(a, 0) AS DECIMAL(28,0)) AS avg_inventory_value,
  ROUND(CAST(c AS DOUBLE) / NULLIF(a, 0), 2) AS inventory_turnover,
  ROUND(365 / NULLIF(CAST(c AS DOUBLE) / NULLIF(a, 0), 0), 1) AS dsi_days
FROM (SELECT b, e, c, CAST(b + e AS DOUBLE) / 2 AS a FROM
  (SELECT SUM(total_inventory_value) AS b FROM fact_inventory_snapshot
   WHERE snapshot_type = 'BEGINNING'),
  (SELECT SUM(total_inventory_value) AS e FROM fact_inventory_snapshot
   WHERE snapshot_type = 'ENDING'),
  (SELECT SUM(estimated_cogs) AS c FROM fact_sales))""",
        "kpi_b1_stockout_rate": """
SELECT COUNT(*) AS total_sku_store_combos,
  COUNT(*) FILTER (WHERE end_qty = 0) AS stockout_count,
  ROUND(CAST(COUNT(*) FILTER (WHERE end_qty = 0) * 100 AS DOUBLE) / NULLIF(COUNT(*), 0), 2)
    AS stockout_rate_pct FROM end_inv""",
        "kpi_b2_dead_stock": """
SELECT COUNT(*) AS total_ending_positions, COUNT(*) FILTER (WHERE dead) AS dead_stock_count,
  ROUND(CAST(COUNT(*) FILTER (WHERE dead) * 100 AS DOUBLE) / NULLIF(COUNT(*), 0), 2)
    AS dead_stock_pct,
  CAST(ROUND(SUM(CASE WHEN dead THEN end_qty ELSE 0 END), 0) AS DECIMAL(28,0))
    AS dead_stock_total_units
FROM (SELECT e.end_qty, s.product_sk IS NULL AND e.end_qty > 0 AS dead
      FROM end_inv e LEFT JOIN sold_pairs s
        ON e.product_sk = s.product_sk AND e.store_sk = s.store_sk)""",
        "kpi_c1_abc_distribution": """
SELECT abc_class, COUNT(*) AS sku_count,
  ROUND(CAST(COUNT(*) * 100 AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 2) AS sku_pct,
  ROUND(CAST(SUM(default_gross_margin_pct) AS DOUBLE) / COUNT(default_gross_margin_pct), 2)
    AS avg_gross_margin_pct
FROM dim_product GROUP BY abc_class""",
        "kpi_c2_top_products": """
SELECT p.brand, p.description, p.abc_class,
  CAST(ROUND(SUM(f.sales_dollars), 0) AS DECIMAL(28,0)) AS total_revenue,
  CAST(SUM(f.sales_quantity) AS DECIMAL(28,2)) AS total_qty_sold,
  ROUND(CAST(SUM(f.sales_price) AS DOUBLE) / COUNT(f.sales_price), 2) AS avg_selling_price
FROM fact_sales f JOIN dim_product p ON f.product_sk = p.product_sk WHERE p.abc_class = 'A'
GROUP BY 1, 2, 3 ORDER BY total_revenue DESC, brand LIMIT 10""",
    }
    q["abc02_in_ranges"] = q["abc02_running_total"]
    return {k: with_ctes(v) for k, v in q.items()}


# -- measures -------------------------------------------------------------------------

_CLASS_OF = "CASE WHEN p.product_sk IS NOT NULL THEN COALESCE(p.abc_class, 'Unclassified') END"
_GROUP_OF = (
    "CASE WHEN p.product_sk IS NOT NULL THEN CASE p.abc_class WHEN 'A' THEN 'A - Critical' "
    "WHEN 'B' THEN 'B - Important' WHEN 'C' THEN 'C - Long Tail' ELSE 'Review - Unclassified' END END"
)
# grain -> key -> (expression on sales, expression on snapshots)
_MONTH_OF_STOCK = (
    "CASE WHEN f.snapshot_date IN (SELECT date_key FROM dim_date) "
    "THEN strftime(f.snapshot_date, '%Y-%m') END"
)
GRAINS = {
    "total": {},
    "store": {"store_sk": ("f.store_sk", "f.store_sk")},
    "class": {"abc_class_display": (_CLASS_OF, _CLASS_OF)},
    "month": {"year_month": ("strftime(f.sales_date, '%Y-%m')", _MONTH_OF_STOCK)},
    "product": {"product_sk": ("f.product_sk", "f.product_sk")},
    "product_store": {
        "product_sk": ("f.product_sk", "f.product_sk"),
        "store_sk": ("f.store_sk", "f.store_sk"),
    },
}


def _stat(name: str) -> str:
    """Daily statistics per key list ``{k}`` of the rows in ``name``."""
    return """
SELECT {k} CAST(sx AS DOUBLE) / NULLIF(active, 0) AS avg_daily,
  sqrt(greatest((sxx - 2.0 * (sx / n) * sx + d * (sx / n) * (sx / n)) / d, 0.0)) AS dev
FROM (SELECT {g} CAST(SUM(x) AS DOUBLE) AS sx, CAST(SUM(x * x) AS DOUBLE) AS sxx,
        CAST(COUNT(x) AS DOUBLE) AS n, COUNT(sales_date) AS active
      FROM {name} {group}) {join}""".replace("{name}", name)


def measure_ctes(
    grain: str, where_sales: str = "TRUE", where_stock: str = "TRUE", where_window: str = "TRUE"
) -> dict[str, str]:
    keys = GRAINS[grain]
    names = list(keys)
    by_month = grain == "month"
    lead = "".join(f"{k}, " for k in names)
    sales_keys = "".join(f"{s} AS {k}, " for k, (s, _) in keys.items())
    stock_keys = "".join(f"{i} AS {k}, " for k, (_, i) in keys.items())
    other_keys = "".join(f"{s} AS {k}, " for k, (s, _) in keys.items() if k != "year_month")

    def group(extra: str = "") -> str:
        cols = [*names, *([extra] if extra else [])]
        cols = list(dict.fromkeys(cols))
        return "GROUP BY " + ", ".join(cols) if cols else ""

    def on(a: str, b: str, *extra: str) -> str:
        tests = [f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in dict.fromkeys([*names, *extra])]
        return " AND ".join(tests) if tests else "TRUE"

    def select(extra: str) -> str:
        return "" if extra in names else f"{extra}, "

    days_join = "JOIN ctx USING (year_month)" if by_month else ", ctx"
    prod = select("product_sk")
    alert = (
        "CASE WHEN r.rop IS NULL OR s.stock IS NULL THEN 4 WHEN s.stock <= 0 THEN 1 "
        "WHEN s.stock <= r.rop THEN 2 WHEN CAST(s.stock AS DOUBLE) <= r.rop * 1.2::DOUBLE THEN 3 "
        "ELSE 4 END"
    )
    # adding 0 makes a negative zero a plain one
    rop = "ROUND(avg_daily * 7.0::DOUBLE + 1.65::DOUBLE * dev * sqrt(7.0::DOUBLE), 0) + 0.0::DOUBLE AS rop"
    uncl = "p.product_sk IS NOT NULL AND p.abc_class IS NULL"
    product_keys = [k for k in names if k in ("product_sk", "abc_class_display")]
    uncl_lead = "".join(
        f"{'p.product_sk' if k == 'product_sk' else _CLASS_OF} AS {k}, " for k in product_keys
    )
    uncl_group = f"GROUP BY {', '.join(str(i + 1) for i in range(len(product_keys)))}" if product_keys else ""
    spine_extra = (
        f"UNION SELECT {uncl_lead[:-2]} FROM dim_product p WHERE p.abc_class IS NULL"
        if product_keys and product_keys == names
        else ""
    )
    spine = (
        f"SELECT {lead[:-2]} FROM sal UNION SELECT {lead[:-2]} FROM inv "
        f"UNION SELECT {lead[:-2]} FROM win {spine_extra}"
        if names
        else "SELECT 1 AS one"
    )
    uncl_on = " AND ".join(f"k.{x} IS NOT DISTINCT FROM u.{x}" for x in product_keys) or "TRUE"
    return {
        "ctx": (
            "SELECT strftime(date_key, '%Y-%m') AS year_month, MAX(date_key) AS last_day, "
            "CAST(COUNT(*) AS DOUBLE) AS d FROM dim_date GROUP BY 1"
            if by_month
            else "SELECT MAX(date_key) AS last_day, CAST(COUNT(*) AS DOUBLE) AS d FROM dim_date"
        ),
        "srow": f"""
SELECT {sales_keys}{'' if 'product_sk' in names else 'f.product_sk, '}f.sales_date,
  f.sales_quantity AS q, f.sales_dollars AS v, f.estimated_cogs AS c
FROM fact_sales f LEFT JOIN dim_product p ON f.product_sk = p.product_sk
WHERE {where_sales}""",
        "irow": f"""
SELECT {stock_keys}{'' if 'product_sk' in names else 'f.product_sk, '}
  {'' if 'store_sk' in names else 'f.store_sk, '}f.snapshot_type AS t,
  f.quantity_on_hand AS q, f.total_inventory_value AS v, ({uncl}) AS uncl
FROM fact_inventory_snapshot f LEFT JOIN dim_product p ON f.product_sk = p.product_sk
WHERE {where_stock}""",
        "wrow": f"""
SELECT {'ctx.year_month, ' if by_month else ''}{other_keys}
  {'' if 'product_sk' in names else 'f.product_sk, '}f.sales_quantity AS q
FROM fact_sales f LEFT JOIN dim_product p ON f.product_sk = p.product_sk
JOIN ctx ON f.sales_date > ctx.last_day - INTERVAL 90 DAY AND f.sales_date <= ctx.last_day
WHERE {where_window}""",
        "sal": f"SELECT {lead} SUM(v) AS rev, SUM(q) AS qty, SUM(c) AS cogs FROM srow {group()}",
        "inv": f"""
SELECT {lead} SUM(v) FILTER (WHERE t = 'BEGINNING') AS beg, SUM(v) FILTER (WHERE t = 'ENDING') AS fin,
  SUM(q) FILTER (WHERE t = 'ENDING') AS stock, COUNT(*) AS recs,
  NULLIF(COUNT(*) FILTER (WHERE q <= 0), 0) AS oos,
  NULLIF(COUNT(*) FILTER (WHERE t = 'BEGINNING'), 0) AS begrows,
  NULLIF(COUNT(*) FILTER (WHERE t = 'ENDING'), 0) AS finrows,
  NULLIF(COUNT(*) FILTER (WHERE t = 'ENDING' AND q <= 0), 0) AS finoos,
  SUM(v) FILTER (WHERE t = 'ENDING' AND q > 0) AS sellable,
  SUM(v) FILTER (WHERE t = 'ENDING' AND uncl) AS unclval FROM irow {group()}""",
        "win": f"SELECT {lead} SUM(q) AS q90 FROM wrow {group()}",
        "pwin": f"SELECT {lead}{prod} SUM(q) AS q90 FROM wrow {group('product_sk')}",
        "pinv": f"""
SELECT {lead}{prod} SUM(v) FILTER (WHERE t = 'ENDING' AND q > 0) AS val,
  SUM(q) FILTER (WHERE t = 'ENDING') AS stock, bool_or(uncl) AS uncl
FROM irow WHERE product_sk IS NOT NULL {group('product_sk')}""",
        "dead": f"""
SELECT {''.join(f'i.{k}, ' for k in names)} SUM(i.val) AS deadval,
  NULLIF(COUNT(DISTINCT i.product_sk) FILTER (WHERE i.stock > 0), 0) AS deadn,
  SUM(i.val) FILTER (WHERE i.uncl) AS unclval
FROM pinv i LEFT JOIN pwin w ON {on('i', 'w', 'product_sk')}
WHERE COALESCE(w.q90, 0) = 0 {'GROUP BY ' + ', '.join(f'i.{k}' for k in names) if names else ''}""",
        "daily": f"SELECT {lead} sales_date, SUM(q) AS x FROM srow {group('sales_date')}",
        "stat": f"SELECT *, {rop} FROM ("
        + _stat("daily").format(k=lead, g=lead, group=group(), join=days_join)
        + ")",
        "stores": f"""
SELECT {lead}{select('store_sk')} SUM(q) FILTER (WHERE t = 'ENDING') AS stock
FROM irow {group('store_sk')}""",
        "alert": f"""
SELECT {''.join(f's.{k}, ' for k in names)} MIN({alert}) AS code
FROM stores s LEFT JOIN stat r ON {on('s', 'r')}
{'GROUP BY ' + ', '.join(f's.{k}' for k in names) if names else ''}""",
        "pdaily": f"""
SELECT {lead}{prod} sales_date, SUM(q) AS x FROM srow
GROUP BY {', '.join(dict.fromkeys([*names, 'product_sk', 'sales_date']))}""",
        "pstat": f"SELECT *, {rop} FROM ("
        + _stat("pdaily").format(
            k=f"{lead}{prod}", g=f"{lead}{prod}", group=group("product_sk"), join=days_join
        )
        + ")",
        "pstores": f"""
SELECT {lead}{prod}{select('store_sk')} SUM(q) FILTER (WHERE t = 'ENDING') AS stock
FROM irow WHERE product_sk IS NOT NULL
GROUP BY {', '.join(dict.fromkeys([*names, 'product_sk', 'store_sk']))}""",
        "palert": f"""
SELECT {''.join(f's.{k}, ' for k in names)}{'' if 'product_sk' in names else 's.product_sk, '}
  MIN({alert}) AS code, MAX(r.rop) AS rop
FROM pstores s LEFT JOIN pstat r ON {on('s', 'r', 'product_sk')}
GROUP BY {', '.join(f's.{k}' for k in dict.fromkeys([*names, 'product_sk']))}""",
        "reord": f"""
SELECT {lead} NULLIF(COUNT(*) FILTER (WHERE code = 2), 0) AS n FROM palert {group()}""",
        "unclsku": f"""
SELECT {uncl_lead} NULLIF(COUNT(*) FILTER (WHERE p.abc_class IS NULL), 0) AS n
FROM dim_product p {uncl_group}""",
        "spine": spine,
        "flat": f"""
SELECT {''.join(f'k.{x}, ' for x in names)}
  s.rev, s.qty, s.cogs, i.beg, i.fin, i.stock, i.recs, i.oos, i.begrows, i.finrows, i.finoos,
  i.sellable, i.unclval AS unclinv, w.q90, x.deadval, x.deadn, x.unclval AS uncldead,
  t.avg_daily, t.dev, 1.65::DOUBLE * t.dev * sqrt(7.0::DOUBLE) AS safety, t.rop, a.code,
  r.n AS reordn, u.n AS uncln
FROM spine k LEFT JOIN sal s ON {on('k', 's')} LEFT JOIN inv i ON {on('k', 'i')}
LEFT JOIN win w ON {on('k', 'w')} LEFT JOIN dead x ON {on('k', 'x')}
LEFT JOIN stat t ON {on('k', 't')} LEFT JOIN alert a ON {on('k', 'a')}
LEFT JOIN reord r ON {on('k', 'r')} LEFT JOIN unclsku u ON {uncl_on}""",
        "ratios": """
SELECT *, CASE WHEN beg IS NOT NULL OR fin IS NOT NULL
    THEN CAST(COALESCE(beg, 0) + COALESCE(fin, 0) AS DOUBLE) / 2 END AS avg_inv
FROM flat""",
        "m": f"""
SELECT {lead}
  CAST(rev AS DECIMAL(28,2)) AS total_revenue, CAST(qty AS DECIMAL(28,2)) AS total_sales_qty,
  CAST(cogs AS DECIMAL(28,4)) AS total_cogs,
  CAST(beg AS DECIMAL(28,4)) AS beginning_inventory_value,
  CAST(fin AS DECIMAL(28,4)) AS ending_inventory_value,
  CAST(stock AS DECIMAL(28,2)) AS current_stock_qty, recs AS total_snapshot_records,
  oos AS out_of_stock_records, begrows AS beginning_rows, finrows AS ending_rows,
  finoos AS ending_out_of_stock_rows, CAST(q90 AS DECIMAL(28,2)) AS sales_qty_last_90_days,
  CAST(sellable AS DECIMAL(28,4)) AS sellable_ending_value,
  CAST(deadval AS DECIMAL(28,4)) AS dead_stock_value, deadn AS dead_stock_sku_count,
  CAST(uncldead AS DECIMAL(28,4)) AS unclassified_dead_stock_value,
  CAST(unclinv AS DECIMAL(28,4)) AS unclassified_inventory_value,
  ROUND(avg_daily, 4) AS avg_daily_sales_qty, ROUND(dev, 4) AS stddev_daily_sales_qty,
  ROUND(safety, 4) AS safety_stock_qty, rop AS reorder_point_qty,
  CASE code WHEN 1 THEN 'Out of Stock' WHEN 2 THEN 'Reorder Now' WHEN 3 THEN 'Low Stock'
    WHEN 4 THEN 'OK' END AS reorder_alert, CAST(COALESCE(code, 5) AS INTEGER) AS reorder_alert_sort,
  ROUND(avg_inv, 4) AS average_inventory_value,
  ROUND(CAST(cogs AS DOUBLE) / NULLIF(avg_inv, 0), 4) AS inventory_turnover,
  ROUND(365.0::DOUBLE / NULLIF(CAST(cogs AS DOUBLE) / NULLIF(avg_inv, 0), 0), 4) AS dsi_days,
  ROUND(CAST(finoos AS DOUBLE) / finrows, 4) AS stockout_rate,
  ROUND(CAST(finoos AS DOUBLE) / finrows, 4) AS stockout_rate_carried,
  ROUND(CAST(deadval AS DOUBLE) / NULLIF(CAST(fin AS DOUBLE), 0), 4) AS dead_stock_pct,
  ROUND(CAST(stock AS DOUBLE) / NULLIF(avg_daily, 0), 4) AS days_of_stock_remaining,
  CASE WHEN stock IS NOT NULL OR rop IS NOT NULL
    THEN ROUND(CAST(COALESCE(stock, 0) AS DOUBLE) - COALESCE(rop, 0), 4) END AS stock_vs_rop_gap,
  CASE WHEN stock IS NULL THEN NULL WHEN deadval > 0 THEN 'Dead Stock' ELSE 'Active' END
    AS dead_stock_flag,
  istatus AS inventory_status, rstatus AS stock_record_status,
  CASE WHEN begrows > 0 AND finrows > 0 THEN 'Stable' WHEN begrows > 0 THEN 'Sold Out / Delisted'
    WHEN finrows > 0 THEN 'New Introduction' ELSE 'No Inventory Record (DSD?)' END
    AS sku_lifecycle_status,
  CAST(CASE WHEN istatus = 'Dead Stock' THEN 1 WHEN rstatus = 'No Snapshot, Has Sales' THEN 2
    WHEN istatus = 'Out of Stock (Active SKU)' THEN 3 WHEN istatus = 'Not Carried' THEN 4
    WHEN istatus = 'Healthy' THEN 5 ELSE 99 END AS INTEGER) AS risk_priority_sort,
  reordn AS reorder_sku_count, uncln AS unclassified_sku_count
FROM (SELECT *, CASE WHEN stock IS NULL THEN 'Not Carried'
    WHEN stock = 0 AND q90 > 0 THEN 'Out of Stock (Active SKU)'
    WHEN stock = 0 AND COALESCE(q90, 0) = 0 THEN 'Discontinued'
    WHEN stock > 0 AND COALESCE(q90, 0) = 0 THEN 'Dead Stock' ELSE 'Healthy' END AS istatus,
  CASE WHEN finrows IS NULL AND q90 IS NOT NULL THEN 'No Snapshot, Has Sales'
    WHEN finrows IS NULL THEN 'No Record' ELSE 'Has Snapshot' END AS rstatus FROM ratios)""",
    }


def measures_sql(grain: str, query: str = "SELECT * FROM m") -> str:
    return with_ctes(query, measure_ctes(grain))


YTD_SQL = """
SELECT year_month, CAST(cogs_ytd AS DECIMAL(28,4)) AS cogs_ytd,
  ROUND(CAST(cogs_ytd AS DOUBLE) / NULLIF(CASE WHEN b IS NOT NULL OR e IS NOT NULL
    THEN CAST(COALESCE(b, 0) + COALESCE(e, 0) AS DOUBLE) / 2 END, 0), 4) AS inventory_turnover_ytd
FROM (SELECT c.ym AS year_month,
  (SELECT SUM(f.estimated_cogs) FROM fact_sales f
    WHERE f.sales_date BETWEEN date_trunc('year', c.last_day) AND c.last_day) AS cogs_ytd,
  (SELECT SUM(i.total_inventory_value) FROM fact_inventory_snapshot i
    WHERE i.snapshot_type = 'BEGINNING' AND i.snapshot_date IN (SELECT date_key FROM dim_date)
    AND i.snapshot_date BETWEEN date_trunc('year', c.last_day) AND c.last_day) AS b,
  (SELECT SUM(i.total_inventory_value) FROM fact_inventory_snapshot i
    WHERE i.snapshot_type = 'ENDING' AND i.snapshot_date IN (SELECT date_key FROM dim_date)
    AND i.snapshot_date BETWEEN date_trunc('year', c.last_day) AND c.last_day) AS e
  FROM (SELECT strftime(date_key, '%Y-%m') AS ym, MAX(date_key) AS last_day FROM dim_date
        GROUP BY 1) c)"""


def report_sql() -> dict[str, str]:
    store = "(SELECT m.*, d.store_number FROM m LEFT JOIN dim_store d ON m.store_sk = d.store_sk)"
    pair = (
        f"(SELECT m.*, d.store_number, p.brand, {_CLASS_OF} AS cls, {_GROUP_OF} AS grp "
        "FROM m LEFT JOIN dim_product p ON m.product_sk = p.product_sk "
        "LEFT JOIN dim_store d ON m.store_sk = d.store_sk)"
    )
    product = (
        f"(SELECT m.*, p.brand, p.abc_class, {_GROUP_OF} AS grp "
        "FROM m LEFT JOIN dim_product p ON m.product_sk = p.product_sk)"
    )
    repl = (
        "current_stock_qty, avg_daily_sales_qty, safety_stock_qty, reorder_point_qty, "
        "reorder_alert, reorder_alert_sort, days_of_stock_remaining, stock_vs_rop_gap"
    )
    q = {
        "rpt01_exec_cards": measures_sql(
            "total",
            "SELECT inventory_turnover, dsi_days, stockout_rate, dead_stock_pct FROM m",
        ),
        "rpt02_monthly_trend": measures_sql(
            "month",
            "SELECT year_month, total_revenue, total_cogs FROM m WHERE total_revenue IS NOT NULL",
        ),
        "rpt03_stockout_by_store": measures_sql(
            "store",
            f"SELECT store_number, stockout_rate FROM {store} WHERE stockout_rate IS NOT NULL",
        ),
        "rpt04_dead_stock_by_abc": measures_sql(
            "class",
            "SELECT abc_class_display, dead_stock_value FROM m WHERE dead_stock_value IS NOT NULL",
        ),
        "rpt05_store_abc_matrix": with_ctes(MATRIX_SQL, MATRIX_CTES),
        "rpt06_risk_cards": measures_sql(
            "total", "SELECT dead_stock_value, dead_stock_sku_count, out_of_stock_records FROM m"
        ),
        "rpt07_store_risk_quadrant": measures_sql(
            "store",
            f"""SELECT store_number, stockout_rate, dead_stock_pct, ending_inventory_value,
CASE WHEN stockout_rate > 0.05 AND COALESCE(dead_stock_pct, 0) > 0.03 THEN 'Critical'
  WHEN stockout_rate > 0.05 THEN 'Replenishment Issue'
  WHEN dead_stock_pct > 0.03 THEN 'Assortment Issue' ELSE 'Healthy' END AS quadrant
FROM {store} WHERE ending_inventory_value IS NOT NULL""",
        ),
        "rpt08_dead_stock_by_store": measures_sql(
            "store",
            f"SELECT store_number, dead_stock_value FROM {store} WHERE dead_stock_value IS NOT NULL",
        ),
        "rpt09_risk_detail": measures_sql(
            "product_store",
            f"""SELECT store_number, brand, cls AS abc_class_display, current_stock_qty,
sales_qty_last_90_days, dead_stock_value, dead_stock_flag, inventory_status, stock_record_status,
sku_lifecycle_status, risk_priority_sort FROM {pair}""",
        ),
        "rpt09_riskiest_per_store": measures_sql(
            "product_store",
            f"""SELECT store_number, brand, cls AS abc_class_display, current_stock_qty,
sales_qty_last_90_days, dead_stock_value, dead_stock_flag, inventory_status, stock_record_status,
sku_lifecycle_status, risk_priority_sort FROM {pair}
QUALIFY ROW_NUMBER() OVER (PARTITION BY store_number ORDER BY risk_priority_sort NULLS FIRST,
  dead_stock_value DESC NULLS LAST, sales_qty_last_90_days DESC NULLS LAST, brand NULLS FIRST) <= 25""",
        ),
        "rpt10_replenish_cards": measures_sql(
            "total",
            "SELECT reorder_sku_count, avg_daily_sales_qty, ending_inventory_value FROM m",
        ),
        "rpt11_rop_gap": measures_sql(
            "product_store",
            f"""SELECT store_number, brand, current_stock_qty, reorder_point_qty, stock_vs_rop_gap
FROM {pair} WHERE stock_vs_rop_gap IS NOT NULL""",
        ),
        "rpt11_most_urgent": measures_sql(
            "product_store",
            f"""SELECT store_number, brand, current_stock_qty, reorder_point_qty, stock_vs_rop_gap
FROM {pair} WHERE stock_vs_rop_gap IS NOT NULL
ORDER BY stock_vs_rop_gap, store_number NULLS FIRST, brand NULLS FIRST LIMIT 200""",
        ),
        "rpt12_reorder_by_abc": measures_sql(
            "total",
            """SELECT COALESCE(p.abc_class, 'Unclassified') AS abc_class_display,
CAST(CASE p.abc_class WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END AS INTEGER)
  AS abc_class_sort,
CASE a.code WHEN 1 THEN 'Out of Stock' WHEN 2 THEN 'Reorder Now' WHEN 3 THEN 'Low Stock'
  ELSE 'OK' END AS reorder_alert, COUNT(*) AS sku_count
FROM palert a JOIN dim_product p ON a.product_sk = p.product_sk GROUP BY 1, 2, 3""",
        ),
        "rpt13_top_reorder": measures_sql(
            "total",
            """SELECT p.brand, a.rop AS reorder_point_qty FROM palert a
JOIN dim_product p ON a.product_sk = p.product_sk WHERE a.code = 2""",
        ),
        "rpt14_replenish_matrix": with_ctes(
            f"""SELECT 'group' AS level, CASE abc_class_display WHEN 'A' THEN 'A - Critical'
  WHEN 'B' THEN 'B - Important' WHEN 'C' THEN 'C - Long Tail'
  WHEN 'Unclassified' THEN 'Review - Unclassified' END AS abc_priority_group, CAST(NULL AS BIGINT) AS brand, CAST(NULL AS BIGINT) AS store_number, {repl}
FROM class_m WHERE total_sales_qty IS NOT NULL OR total_snapshot_records IS NOT NULL
UNION ALL SELECT 'brand', grp, brand, NULL, {repl}
FROM {product.replace('FROM m ', 'FROM product_m m ')}
WHERE total_sales_qty IS NOT NULL OR total_snapshot_records IS NOT NULL
UNION ALL SELECT 'store', grp, brand, store_number, {repl}
FROM {pair.replace('FROM m ', 'FROM product_store_m m ')}""",
            _nested("class") | _nested("product") | _nested("product_store"),
        ),
        "rpt15_sku_detail": measures_sql(
            "product",
            f"""SELECT brand, grp AS abc_priority_group, avg_daily_sales_qty, safety_stock_qty,
reorder_point_qty, current_stock_qty, reorder_alert FROM {product}
WHERE total_sales_qty IS NOT NULL OR total_snapshot_records IS NOT NULL""",
        ),
        "rpt16_filters": with_ctes(SLICED_SQL),
        "rpt16_stores_and_month": sliced_sql("month({d}) IN (12)", "d.store_number IN (3, 11)"),
        "rpt16_brands": sliced_sql("TRUE", "p.brand IN (11, 12, 21, 33, 47)"),
        "rpt16_classes_and_year": sliced_sql("year({d}) = 1999", "p.abc_class IN ('B', 'C')"),
        "rpt15_some_skus": measures_sql(
            "product",
            f"""SELECT brand, grp AS abc_priority_group, avg_daily_sales_qty, safety_stock_qty,
reorder_point_qty, current_stock_qty, reorder_alert FROM {product}
WHERE brand IN (11, 12, 21, 33, 47)
  AND (total_sales_qty IS NOT NULL OR total_snapshot_records IS NOT NULL)""",
        ),
        "rpt17_inventory_growth": with_ctes(
            """SELECT CAST(b AS DECIMAL(28,4)) AS beginning_inventory_value,
CAST(e AS DECIMAL(28,4)) AS ending_inventory_value, CAST(e - b AS DECIMAL(28,4)) AS inventory_growth,
ROUND(CAST((e - b) * 100 AS DOUBLE) / NULLIF(CAST(b AS DOUBLE), 0), 4) AS inventory_growth_pct
FROM (SELECT SUM(total_inventory_value) FILTER (WHERE snapshot_type = 'BEGINNING') AS b,
  SUM(total_inventory_value) FILTER (WHERE snapshot_type = 'ENDING') AS e
  FROM fact_inventory_snapshot)"""
        ),
        "rpt18_monthly_share": with_ctes(
            """SELECT year_month, CAST(v AS DECIMAL(28,2)) AS total_revenue,
ROUND(CAST(v AS DOUBLE) / CAST(SUM(v) OVER y AS DOUBLE), 4) AS share_of_year,
CAST(peak AS INTEGER) AS peak_rank, CAST(trough AS INTEGER) AS trough_rank,
ROUND(CAST(SUM(CASE WHEN peak <= 2 THEN v END) OVER y AS DOUBLE)
  / CAST(SUM(v) OVER y AS DOUBLE), 4) AS top_two_share
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY y ORDER BY v DESC, year_month) AS peak,
        ROW_NUMBER() OVER (PARTITION BY y ORDER BY v, year_month) AS trough
      FROM (SELECT strftime(sales_date, '%Y-%m') AS year_month, year(sales_date) AS y,
              SUM(sales_dollars) AS v FROM fact_sales WHERE sales_date IS NOT NULL GROUP BY 1, 2))
WINDOW y AS (PARTITION BY y)"""
        ),
        "rpt19_store_revenue_rank": measures_sql(
            "store",
            f"""SELECT ROW_NUMBER() OVER (ORDER BY total_revenue DESC, store_number) AS revenue_rank,
store_number, total_revenue FROM {store} WHERE total_revenue IS NOT NULL""",
        ),
        "rpt20_sku_week_run_rate": measures_sql(
            "product",
            f"""SELECT brand, total_revenue, ROUND(CAST(total_revenue AS DOUBLE) / {WEEKS}, 4)
  AS revenue_per_week, ROUND(CAST(total_sales_qty AS DOUBLE) / {WEEKS}, 4) AS qty_per_week,
ROUND(CAST(total_sales_qty AS DOUBLE) / {WEEKS} * 2, 4) AS reorder_trigger_qty
FROM {product} WHERE total_revenue IS NOT NULL""",
        ),
        "rpt21_bottom_c_class": measures_sql(
            "product",
            f"""SELECT brand, total_revenue, r AS velocity_rank FROM (
SELECT *, ROW_NUMBER() OVER (ORDER BY total_revenue, product_sk) AS r, COUNT(*) OVER () AS n
FROM {product} WHERE abc_class = 'C' AND total_revenue IS NOT NULL) c
WHERE r * 5 <= n AND NOT EXISTS (SELECT 1 FROM fact_sales f
  WHERE f.product_sk = c.product_sk AND f.sales_date
    BETWEEN date_trunc('quarter', DATE '{feed.PERIOD.end}') AND DATE '{feed.PERIOD.end}')""",
        ),
        "rpt22_dead_stock_clearance": with_ctes(
            f"""SELECT d.store_number, p.brand, {_CLASS_OF} AS abc_class_display,
CAST(e.end_qty AS DECIMAL(28,2)) AS dead_units,
CAST(CASE WHEN p.abc_class = 'C' THEN 1 WHEN p.abc_class IS NULL THEN 2 ELSE 3 END AS INTEGER)
  AS clearance_step,
CASE WHEN p.abc_class IN ('A', 'B') THEN o.n END AS selling_stores,
CASE WHEN p.abc_class IN ('A', 'B') THEN o.best END AS transfer_to_store
FROM end_inv e LEFT JOIN dim_product p ON e.product_sk = p.product_sk
LEFT JOIN dim_store d ON e.store_sk = d.store_sk
LEFT JOIN (SELECT product_sk, COUNT(*) AS n, FIRST(store_number ORDER BY qty DESC, store_number) AS best
  FROM (SELECT f.product_sk, s.store_number, SUM(f.sales_quantity) AS qty FROM fact_sales f
        JOIN dim_store s ON f.store_sk = s.store_sk GROUP BY 1, 2) GROUP BY product_sk) o
  ON e.product_sk = o.product_sk
WHERE e.end_qty > 0 AND NOT EXISTS (SELECT 1 FROM sold_pairs s
  WHERE s.product_sk = e.product_sk AND s.store_sk = e.store_sk)"""
        ),
    }
    return q


WEEKS = f"{((feed.PERIOD.end - feed.PERIOD.start).days + 1) / 7!r}::DOUBLE"


def _nested(grain: str) -> dict[str, str]:
    """The measures of a grain as one CTE named ``<grain>_m``."""
    chain = ", ".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in measure_ctes(grain).items())
    return {f"{grain}_m": f"WITH {chain} SELECT * FROM m"}


# both facts by product and store, before classes are looked up
MATRIX_CTES = {
    "matrix_rows": """
SELECT product_sk, store_sk, SUM(sales_dollars) AS rev, SUM(estimated_cogs) AS cogs, NULL AS beg, NULL AS fin,
  NULL AS oos, NULL AS n
FROM fact_sales GROUP BY 1, 2
UNION ALL
SELECT product_sk, store_sk, NULL, NULL,
  SUM(total_inventory_value) FILTER (WHERE snapshot_type = 'BEGINNING'),
  SUM(total_inventory_value) FILTER (WHERE snapshot_type = 'ENDING'),
  NULLIF(CAST(COUNT(*) FILTER (WHERE snapshot_type = 'ENDING' AND quantity_on_hand <= 0) AS BIGINT), 0),
  CAST(COUNT(*) FILTER (WHERE snapshot_type = 'ENDING') AS BIGINT)
FROM fact_inventory_snapshot GROUP BY 1, 2""",
    "matrix_classes": """
SELECT b.product_sk, COALESCE(l.abc_class, 'Unclassified') AS cls
FROM product_base b LEFT JOIN abc_labels l ON b.product_sk = l.product_sk""",
}
MATRIX_SQL = """
SELECT CASE gid WHEN 0 THEN 'class' WHEN 1 THEN 'store' ELSE 'total' END AS level, d.store_number,
  abc_class_display, CAST(rev AS DECIMAL(28,2)) AS total_revenue,
  CAST(fin AS DECIMAL(28,4)) AS ending_inventory_value,
  ROUND(CAST(cogs AS DOUBLE) / NULLIF(a, 0), 4) AS inventory_turnover,
  ROUND(365.0::DOUBLE / NULLIF(CAST(cogs AS DOUBLE) / NULLIF(a, 0), 0), 4) AS dsi_days,
  ROUND(CAST(oos AS DOUBLE) / NULLIF(n, 0), 4) AS stockout_rate
FROM (SELECT *, CASE WHEN beg IS NOT NULL OR fin IS NOT NULL
    THEN CAST(COALESCE(beg, 0) + COALESCE(fin, 0) AS DOUBLE) / 2 END AS a
  FROM (SELECT GROUPING(store_sk, cls) AS gid, store_sk, cls AS abc_class_display, SUM(rev) AS rev,
          SUM(cogs) AS cogs, SUM(beg) AS beg, SUM(fin) AS fin, SUM(oos) AS oos, SUM(n) AS n
        FROM (SELECT f.store_sk, p.cls, f.rev, f.cogs, f.beg, f.fin, f.oos, f.n
              FROM matrix_rows f LEFT JOIN matrix_classes p ON f.product_sk = p.product_sk)
        GROUP BY ROLLUP (store_sk, cls))) g
LEFT JOIN dim_store d ON g.store_sk = d.store_sk"""

CTES |= {
    "moment_days": """
SELECT f.sales_date, f.product_sk, f.store_sk, c.cls, f.q
FROM (SELECT sales_date, product_sk, store_sk, SUM(sales_quantity) AS q FROM fact_sales GROUP BY 1, 2, 3) f
LEFT JOIN (SELECT b.product_sk, COALESCE(l.abc_class, 'Unclassified') AS cls
  FROM product_base b LEFT JOIN abc_labels l ON b.product_sk = l.product_sk) c ON f.product_sk = c.product_sk""",
}


def _moments(*keys: str) -> str:
    """Daily moments by some of ``cls``, ``product_sk`` and ``store_sk``, in that order."""
    columns = {"cls": "abc_class_display", "product_sk": "product_sk", "store_sk": "store_sk"}
    kinds = {"cls": "VARCHAR", "product_sk": "BIGINT", "store_sk": "BIGINT"}
    shown = ", ".join(f"{k if k in keys else f'CAST(NULL AS {kinds[k]})'} AS {c}" for k, c in columns.items())
    by = ", ".join(["sales_date", *keys])
    over = ", ".join(["sales_month", *keys])
    return f"""SELECT '{"_".join(columns[k] for k in keys) or "all"}' AS moments_of, sales_month, {shown},
  CAST(SUM(x) AS DECIMAL(38,2)) AS sx, CAST(SUM(x * x) AS DECIMAL(38,4)) AS sxx, COUNT(x) AS n,
  COUNT(sales_date) AS active_days
FROM (SELECT CAST(year(sales_date) * 100 + month(sales_date) AS INTEGER) AS sales_month, {by},
        CAST(SUM(q) AS DECIMAL(18,2)) AS x FROM moment_days GROUP BY ALL) GROUP BY {over}"""


MOMENTS_OF = [(), ("store_sk",), ("cls",), ("cls", "store_sk"), ("product_sk",), ("product_sk", "store_sk")]

# the slicers of rpt16: one year, two months, one class
SLICED_SQL = """
SELECT d.store_number, CAST(s.rev AS DECIMAL(28,2)) AS total_revenue,
  CAST(s.qty AS DECIMAL(28,2)) AS total_sales_qty, CAST(i.fin AS DECIMAL(28,4)) AS ending_inventory_value,
  CAST(w.q AS DECIMAL(28,2)) AS sales_qty_last_90_days, CAST(x.v AS DECIMAL(28,4)) AS dead_stock_value,
  ROUND(CAST(s.qty AS DOUBLE) / NULLIF(s.days, 0), 4) AS avg_daily_sales_qty
FROM (SELECT store_sk FROM sliced_sales UNION SELECT store_sk FROM sliced_stock
      UNION SELECT store_sk FROM sliced_window) k
LEFT JOIN (SELECT store_sk, SUM(sales_dollars) AS rev, SUM(sales_quantity) AS qty,
             COUNT(DISTINCT sales_date) AS days FROM sliced_sales GROUP BY 1) s USING (store_sk)
LEFT JOIN (SELECT store_sk, SUM(total_inventory_value) FILTER (WHERE snapshot_type = 'ENDING') AS fin
           FROM sliced_stock GROUP BY 1) i USING (store_sk)
LEFT JOIN (SELECT store_sk, SUM(sales_quantity) AS q FROM sliced_window GROUP BY 1) w USING (store_sk)
LEFT JOIN (SELECT t.store_sk, SUM(t.total_inventory_value) AS v FROM sliced_stock t
           WHERE t.snapshot_type = 'ENDING' AND t.quantity_on_hand > 0
             AND COALESCE((SELECT SUM(w.sales_quantity) FROM sliced_window w
               WHERE w.store_sk = t.store_sk AND w.product_sk = t.product_sk), 0) = 0
           GROUP BY 1) x USING (store_sk)
LEFT JOIN dim_store d ON k.store_sk = d.store_sk"""
CTES |= {
    "sliced_sales": """
SELECT f.* FROM fact_sales f JOIN dim_product p ON f.product_sk = p.product_sk
WHERE year(f.sales_date) = 2001 AND month(f.sales_date) IN (8, 9) AND p.abc_class = 'A'""",
    "sliced_stock": """
SELECT f.* FROM fact_inventory_snapshot f JOIN dim_product p ON f.product_sk = p.product_sk
WHERE year(f.snapshot_date) = 2001 AND month(f.snapshot_date) IN (8, 9) AND p.abc_class = 'A'""",
    "sliced_window": """
SELECT f.* FROM fact_sales f JOIN dim_product p ON f.product_sk = p.product_sk
WHERE p.abc_class = 'A' AND f.sales_date > (SELECT MAX(date_key) FROM dim_date
    WHERE year(date_key) = 2001 AND month(date_key) IN (8, 9)) - INTERVAL 90 DAY
  AND f.sales_date <= (SELECT MAX(date_key) FROM dim_date
    WHERE year(date_key) = 2001 AND month(date_key) IN (8, 9))""",
}


def sliced_sql(dates: str, others: str) -> str:
    """The figures of rpt16 under conditions on ``{d}``, a date, and on p, a product, or d, a store."""
    joins = (
        "LEFT JOIN dim_product p ON f.product_sk = p.product_sk "
        "LEFT JOIN dim_store d ON f.store_sk = d.store_sk"
    )
    end = f"(SELECT MAX(date_key) FROM dim_date WHERE {dates.format(d='date_key')})"
    stock_dates = (
        "TRUE"
        if dates == "TRUE"
        else f"{dates.format(d='f.snapshot_date')} AND f.snapshot_date IN (SELECT date_key FROM dim_date)"
    )
    return with_ctes(
        SLICED_SQL,
        {
            "sliced_sales": f"SELECT f.* FROM fact_sales f {joins} "
            f"WHERE {dates.format(d='f.sales_date')} AND {others}",
            "sliced_stock": f"SELECT f.* FROM fact_inventory_snapshot f {joins} "
            f"WHERE {stock_dates} AND {others}",
            "sliced_window": f"SELECT f.* FROM fact_sales f {joins} WHERE {others} "
            f"AND f.sales_date > {end} - INTERVAL 90 DAY AND f.sales_date <= {end}",
        },
    )


def ytd_of_stores(stores: tuple[int, ...], months: tuple[int, ...]) -> str:
    """Year to date of some stores, shown for some months of each year."""
    of = f"(SELECT store_sk FROM dim_store WHERE store_number IN {stores})"
    sql = YTD_SQL.replace("WHERE f.sales_date", f"WHERE f.store_sk IN {of} AND f.sales_date")
    sql = sql.replace("WHERE i.snapshot_type", f"WHERE i.store_sk IN {of} AND i.snapshot_type")
    return with_ctes(f"SELECT * FROM ({sql}) WHERE CAST(right(year_month, 2) AS INTEGER) IN {months}")
