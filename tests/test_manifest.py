"""Which layers are built anew when their input changes."""

from shelfwise.config import CALENDAR_2016
from shelfwise.plans.warehouse import Warehouse
from tests import tiny


def stored_raw(spark, raw, folder):
    out = {}
    for name, df in tiny.raw_tables(raw).items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
        out[name] = lambda path=f"{folder}/{name}": spark.read.parquet(path)
    return out


def built(monkeypatch):
    """The names of the tables that are stored from now on."""
    names, plain = [], Warehouse._store

    def store(self, name, place):
        names.append(name)
        return plain(self, name, place)

    monkeypatch.setattr(Warehouse, "_store", store)
    return names


def test_unchanged_layers_are_not_built_again(spark, raw, tmp_path, monkeypatch):
    tables = stored_raw(spark, raw, tmp_path / "in")
    first = Warehouse.over_raw(spark, tables, CALENDAR_2016, str(tmp_path / "lake"))
    rows = sorted(map(str, first.table("dim_store").collect()))
    names = built(monkeypatch)
    later = Warehouse.over_raw(spark, tables, CALENDAR_2016, str(tmp_path / "lake"))
    assert sorted(map(str, later.table("dim_store").collect())) == rows and names == []
    later.refresh()
    later.table("dim_store")
    assert names == []


def test_changed_input_under_the_same_path_is_seen(spark, raw, tmp_path, monkeypatch):
    tables = stored_raw(spark, raw, tmp_path / "in")
    w = Warehouse.over_raw(spark, tables, CALENDAR_2016, str(tmp_path / "lake"))
    before = w.table("dim_store").count()
    w.table("stg_invoice_purchases")
    names = built(monkeypatch)
    stock = tables["raw_end_inventory"]()
    more = stock.withColumn("store", (stock["store"].cast("int") + 70).cast("string"))
    more.write.mode("append").parquet(str(tmp_path / "in" / "raw_end_inventory"))
    assert w.has_changed()
    w.refresh()
    assert w.table("dim_store").count() == before + 2
    w.table("stg_invoice_purchases")
    # what does not depend on the changed table stays
    assert set(names) == {"stg_end_inventory", "dim_store"}
    assert not w.has_changed()
