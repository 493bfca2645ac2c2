"""What is stored and shuffled on the way to a measure."""

import re
import shutil

import pytest
from pyspark.sql import functions as F

from shelfwise import catalog
from shelfwise.operators import abc
from shelfwise.operators.ordered import number_rows
from shelfwise.plans import kpis, marts, measures
from shelfwise.plans.measures import CLASS, PRODUCT, STORE, Context, Slice, evaluate, evaluate_levels
from shelfwise.plans.warehouse import Warehouse
from shelfwise.session import write_and_read
from shelfwise.sources.retail_feed import PERIOD, RetailFeed
from tests import tiny

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    for key, value in NO_BROADCAST.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(monkeypatch):
    names, plain = [], Warehouse._store

    def store(self, name, place):
        names.append(name)
        return plain(self, name, place)

    monkeypatch.setattr(Warehouse, "_store", store)
    return names


@pytest.fixture(scope="module")
def order_tables(spark, tmp_path_factory):
    """Four orders of three lines, one supplier in debt, one line returned."""
    folder = str(tmp_path_factory.mktemp("orders"))
    day = "TIMESTAMP'1996-01-05'"
    tables = {
        "nation": "SELECT CAST(id AS INT) AS n_nationkey, concat('NATION_', id) AS n_name FROM range(3)",
        "customer": "SELECT id AS c_custkey, CAST(id AS INT) AS c_nationkey FROM range(3)",
        "supplier": "SELECT id AS s_suppkey, concat('S', id) AS s_name, CAST(id AS INT) AS s_nationkey, "
        "CAST(id - 1 AS DOUBLE) AS s_acctbal FROM range(3)",
        "part": "SELECT id AS p_partkey, concat('part ', id) AS p_name, 'LARGE' AS p_type, "
        "CAST(10 AS INT) AS p_size, 100.0D AS p_retailprice FROM range(4)",
        "orders": f"SELECT id AS o_orderkey, id % 3 AS o_custkey, {day} AS o_orderdate, '5-LOW' AS o_orderpriority "
        "FROM range(4)",
        "lineitem": "SELECT id DIV 3 AS l_orderkey, id % 4 AS l_partkey, id % 3 AS l_suppkey, "
        "CAST(1 + id % 3 AS INT) AS l_linenumber, 2.0D AS l_quantity, 30.0D AS l_extendedprice, 0.0D AS l_discount, "
        "0.0D AS l_tax, IF(id = 5, 'R', 'N') AS l_returnflag, IF(id < 6, 'F', 'O') AS l_linestatus, "
        f"{day} + make_dt_interval(CAST(id AS INT)) AS l_shipdate FROM range(12)",
    }
    for name, sql in tables.items():
        spark.sql(sql).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_stock_by_store_reads_no_sales_mart(spark, order_tables, monkeypatch):
    names = stored(monkeypatch)
    w = Warehouse.over_feed(spark, order_tables)
    rows = evaluate(w, [STORE], ["total_snapshot_records"])
    assert sum(r[1] for r in rows.collect()) == 12
    assert not {"fact_sales", "abc_running_total", "dim_product"} & set(names)
    # texts of the feed are projected where they are read
    assert not [n for n in names if n.startswith("stg_") or n in ("raw_sales", "raw_purchases")]
    assert {"feed_lines", "raw_beg_inventory", "raw_end_inventory", "fact_inventory_snapshot"} <= set(names)
    assert w.table("stg_sales").count() == 12
    assert w.table("raw_invoice_purchases").count() == 12
    unnamed = w.table("stg_invoice_purchases").filter("vendor_number IS NULL").agg(F.sum("quantity"), F.max("vendor_name"))
    assert unnamed.first()[:] == (8, "S0")


def test_tables_over_views_are_kept_until_files_change(spark, order_tables, tmp_path, monkeypatch):
    feed = RetailFeed(spark, order_tables)

    def over():
        raw = {
            "feed_lines": lambda w: feed.lines(),
            "raw_sales": lambda w: feed.sales(w.table("feed_lines")),
            "raw_beg_inventory": lambda w: feed.beg_inventory(w.table("feed_lines")),
            "raw_end_inventory": lambda w: feed.end_inventory(w.table("feed_lines")),
        }
        views = ("raw_sales", "stg_sales", "stg_beg_inventory", "stg_end_inventory")
        return Warehouse(spark, raw, PERIOD, f"file:{tmp_path}/lake", views=views)

    assert over().table("dim_store").count() == 3
    names = stored(monkeypatch)
    assert over().table("dim_store").count() == 3 and names == []


def test_lines_are_shuffled_once_for_each_of_their_own_keys(spark, order_tables, no_broadcast):
    text = plan(RetailFeed(spark, order_tables).lines())
    found = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
    assert sorted(k for k in found if k.startswith("l_")) == ["l_orderkey", "l_partkey", "l_suppkey"]
    # a customer's nation meets the order, not the lines of it
    assert text.count("SortMergeJoin") == 6 and text.index("l_orderkey#") < text.index("o_custkey#")


def test_days_are_not_expanded_by_products(spark, raw, tmp_path):
    w = tiny.warehouse(spark, raw, str(tmp_path))
    text = plan(marts.daily_moments(w.table("daily_sales"), w.table("dim_product")))
    assert text.count("Expand") == 1
    expanded = text[text.index("Expand") :].partition("\n")[0]
    assert "product_sk" not in expanded
    assert text.count("Exchange hashpartitioning(sales_month#") >= 2
    assert len(re.findall(r"Exchange hashpartitioning\(\S+, product_sk", text)) == 2


def test_days_of_a_product_in_a_store_are_its_moments(spark, raw, tmp_path, monkeypatch):
    names = stored(monkeypatch)
    w = tiny.warehouse(spark, raw, str(tmp_path))
    rows = Context(w, [PRODUCT, STORE], Slice()).moments([PRODUCT, STORE]).collect()
    assert sorted((r.sx, r.sxx, r.n, r.active_days) for r in rows) == [
        (1, 1, 1, 1), (1, 1, 1, 1), (2, 4, 1, 1), (3, 9, 1, 1), (4, 16, 1, 1), (5, 25, 1, 1), (7, 49, 1, 1)
    ]
    assert "summed_moments" not in names and "daily_moments" not in names


def test_daily_sales_are_shuffled_once(spark, raw, tmp_path):
    w = tiny.warehouse(spark, raw, str(tmp_path))
    text = plan(marts.daily_sales(w.table("fact_sales")))
    assert text.count("Exchange") == 1 and "rangepartitioning(sales_month" in text


def test_daily_sales_need_no_stored_sales(spark, raw, tmp_path, monkeypatch):
    """Nor vendors, and their sums and classes are those of the single sales."""
    names = stored(monkeypatch)
    w = tiny.warehouse(spark, raw, str(tmp_path))
    days, running = w.table("daily_sales"), w.table("abc_running_total")
    w.table("dim_date")
    assert not {"fact_sales", "dim_vendor"} & set(names)
    sales = w.table("fact_sales")
    assert days.schema == marts.daily_sales(sales).select(days.columns).schema
    same = marts.daily_sales(sales).select(days.columns).exceptAll(days)
    assert days.count() == len(tiny.SALES) and same.isEmpty()
    assert days.agg(F.sum("estimated_cogs")).first()[0] == sales.agg(F.sum("estimated_cogs")).first()[0] == 79
    single = abc.with_running_total(abc.product_revenue(sales))
    assert running.schema == single.schema and single.exceptAll(running).isEmpty()


def test_moments_of_products_share_a_shuffle_and_are_kept_apart(spark, raw, tmp_path, monkeypatch):
    w = tiny.warehouse(spark, raw, str(tmp_path))
    text = plan(marts.daily_moments(w.table("daily_sales"), w.table("dim_product")))
    found = re.findall(r"Exchange hashpartitioning\(sales_month#\d+, product_sk#\d+L, \d+\)", text)
    assert len(found) == 2
    names = stored(monkeypatch)
    evaluate(w, [PRODUCT], ["avg_daily_sales_qty"])
    assert "product_moments" in names and "summed_moments" not in names
    names.clear()
    evaluate(w, [STORE], ["avg_daily_sales_qty"])
    assert names == ["summed_moments"]


def test_copies_are_packed_by_zstandard(spark, tmp_path):
    write_and_read(spark.range(10), str(tmp_path / "copy"))
    assert list((tmp_path / "copy").glob("*.zstd.parquet"))


def test_row_numbers_need_no_shuffle_of_rows(spark):
    numbered = number_rows(spark.range(100).withColumnRenamed("id", "k"), [F.asc("k")], "n", rows_per_range=10)
    assert "Window [row_number" not in plan(numbered) and plan(numbered).count("Exchange hashpartitioning(_range") == 1
    assert [r.n for r in numbered.orderBy("k").collect()] == list(range(1, 101))


def test_suppliers_are_known_by_their_own_size(spark, order_tables):
    """A join with their nations would be taken for the product of both, and the lines shuffled for it."""
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "20k")
    try:
        lines = RetailFeed(spark, order_tables).lines()
        assert "hashpartitioning(l_suppkey" not in plan(lines)
    finally:
        spark.conf.set(key, before)
    assert [lines.schema[c].dataType.simpleString() for c in ("l_shipdate", "o_orderdate")] == ["date", "date"]
    assert lines.count() == 12


def test_stock_counts_are_laid_out_by_part(spark, order_tables):
    feed = RetailFeed(spark, order_tables)
    counted = feed.beg_inventory(feed.lines())
    assert re.search(r"Exchange hashpartitioning\(l_partkey#\d+L, \d+\)", plan(counted))
    assert counted.count() == 6


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = kept(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    copy = write_and_read(spark.range(1000).repartition(3).groupBy("id").count(), str(tmp_path / "copy"))
    left = kept() - before
    assert not left and copy.count() == 1000
    assert spark.conf.get(setting) == "false"


def test_classes_wait_for_no_sales_mart(spark, raw, tmp_path, monkeypatch):
    names = stored(monkeypatch)
    w = tiny.warehouse(spark, raw, str(tmp_path))
    running = w.table("abc_running_total")
    w.table("dim_product")
    assert not {"daily_sales", "fact_sales", "dim_store"} & set(names)
    by_day = abc.with_running_total(abc.product_revenue(w.table("daily_sales")))
    assert running.schema == by_day.schema
    assert by_day.exceptAll(running).isEmpty() and running.exceptAll(by_day).isEmpty()


def hashed(df):
    """The keys of the shuffles in a plan, without the number of partitions."""
    found = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))
    return [tuple(re.sub(r"#\d+L?", "", k) for k in keys.split(", ")[:-1]) for keys in found]


def test_levels_meet_their_products_without_another_shuffle(spark, raw, tmp_path, no_broadcast):
    w = tiny.warehouse(spark, raw, str(tmp_path))
    levels = evaluate_levels(w, ["current_stock_qty", "reorder_point_qty", "reorder_alert"])
    assert hashed(levels) == [(PRODUCT,)] * 3  # sales, stock and what is known of classes
    brands = w.table("dim_product").select(PRODUCT, "brand")
    assert hashed(levels.join(brands, PRODUCT, "left")) == [(PRODUCT,)] * 4


@pytest.mark.parametrize("grain", [[PRODUCT, STORE], [CLASS]], ids=str)
def test_facts_are_shuffled_by_product_where_products_are_looked_up(spark, raw, tmp_path, grain):
    w = tiny.warehouse(spark, raw, str(tmp_path))
    keys = hashed(evaluate(w, grain, measures.ALL))
    assert {k for k in keys if PRODUCT in k} == {(PRODUCT,)}
    if grain == [PRODUCT, STORE]:
        assert set(keys) == {(PRODUCT,)}


def test_single_sales_are_not_laid_out(spark, raw, tmp_path):
    """A product can have any number of them."""
    w = tiny.warehouse(spark, raw, str(tmp_path))
    fact = w.table("fact_sales")
    assert Context(w, [PRODUCT], Slice(vendors=(7,)), by_product=True).laid_out(fact) is fact
    assert Context(w, [PRODUCT], Slice(), by_product=True).laid_out(fact) is not fact


def test_turnover_needs_no_stored_sales(spark, order_tables, monkeypatch):
    names = stored(monkeypatch)
    shown = catalog.queries()["kpi_a3_turnover_dsi"](spark, order_tables)
    assert shown.count() == 1 and not {"fact_sales", "dim_vendor"} & set(names)
    w = Warehouse.over_feed(spark, order_tables)
    single = kpis.turnover_dsi(w.table("fact_sales"), w.table("fact_inventory_snapshot"))
    assert single.schema == shown.schema and single.collect() == shown.collect()


def test_stores_wait_for_no_stock_count(spark, order_tables, tmp_path, monkeypatch):
    folder = f"{tmp_path}/orders"
    shutil.copytree(order_tables, folder)  # a warehouse of its own
    names = stored(monkeypatch)
    w = Warehouse.over_feed(spark, folder)
    stores = w.table("dim_store")
    assert names == ["dim_store", "feed_lines"]
    counted = marts.dim_store(w.table("stg_beg_inventory"), w.table("stg_end_inventory"), w.table("stg_sales"))
    assert stores.schema == counted.schema and sorted(stores.collect()) == sorted(counted.collect())


@pytest.mark.parametrize("grain", [[CLASS], [PRODUCT]], ids=str)
def test_lowest_stock_is_shuffled_by_product_once(spark, raw, tmp_path, grain, no_broadcast):
    w = tiny.warehouse(spark, raw, str(tmp_path))
    keys = hashed(measures.lowest_store_stock(Context(w, grain, Slice())))
    assert {k for k in keys if PRODUCT in k} == {(PRODUCT,)}
    assert len(keys) == (1 if grain == [PRODUCT] else 4)  # products, stores of a class, classes


def test_picked_brands_need_no_shuffle_of_the_facts(spark, raw, tmp_path, no_broadcast):
    w = tiny.warehouse(spark, raw, str(tmp_path))
    ctx = Context(w, [STORE], Slice(brands=(10, 30)))
    assert "Exchange hashpartitioning" not in plan(ctx.sales()) + plan(ctx.snapshot())
    assert ctx.sales().count() == 5 and ctx.snapshot().count() == 3
