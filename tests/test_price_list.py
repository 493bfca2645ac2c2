"""The price list of the feed, on rows of its own."""

from shelfwise.sources.retail_feed import RetailFeed


def test_every_pack_of_every_part_has_its_first_vendor(spark, tmp_path):
    """Also for parts that come twice, that nobody shipped, or that have no key."""
    part = "p_partkey long, p_name string, p_size int, p_type string, p_retailprice double"
    rows = [(1, "nut", 2, "STD", 3.0), (1, "nut", 2, "STD", 3.0), (2, "bolt", 1, "ECO", 4.0), (None, "gear", 3, "STD", 5.0)]
    spark.createDataFrame(rows, part).write.parquet(f"{tmp_path}/part.parquet")
    supplier = spark.createDataFrame([(7, "S7"), (8, "S8")], "s_suppkey long, s_name string")
    supplier.write.parquet(f"{tmp_path}/supplier.parquet")
    shipped = [(1, 1, 8), (1, 1, 7), (1, 3, 8), (1, 9, 7), (None, 2, 7), (1, None, 7), (1, 5, None), (1, 6, 99)]
    lines = spark.createDataFrame(shipped, "l_partkey long, l_linenumber int, l_suppkey long")
    got = RetailFeed(spark, str(tmp_path)).purchase_prices(lines).collect()
    assert len(got) == 4 * 7
    found = sorted((r.brand, r.vendor_number, r.vendor_name) for r in got if r.vendor_number)
    assert found == [("11", "7", "S7"), ("11", "7", "S7"), ("13", "8", "S8"), ("13", "8", "S8"), ("16", "99", None), ("16", "99", None)]
    assert {r.brand for r in got} == {None, *[str(p * 10 + k) for p in (1, 2) for k in range(1, 8)]}
    assert {r.description for r in got} == {f"{n} x{k}" for n in ("nut", "bolt", "gear") for k in range(1, 8)}
