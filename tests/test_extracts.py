import pytest

from shelfwise.sources import extracts, versions
from shelfwise.sources.extracts import (
    load_catalog,
    loaded_table,
    malformed_records,
    read_audit,
    read_extract,
    snake_case,
    write_preview,
)
from shelfwise.sources.schemas import column_audit, contract_report

CSV = (
    "﻿InventoryId,Store,onHand,PODate,Vendor No.\n"
    '1_A_1,1,,2016-01-02,"ACME, LLC  "\n'
    '1_A_2,"",NA,Unknown, 7 \n'
)


@pytest.mark.parametrize(
    "header, name",
    [
        ("InventoryId", "inventory_id"),
        ("PODate", "po_date"),
        ("onHand", "on_hand"),
        (" Vendor-No/Name ", "vendor_no_name"),
        ("Price ($)", "price_"),
        ("ABCDef", "abc_def"),
        ("VendorName2Use", "vendor_name2_use"),
    ],
)
def test_snake_case(header, name):
    assert snake_case(header) == name


@pytest.fixture(scope="module")
def csv_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "extract.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def test_read_extract(spark, csv_file):
    df = read_extract(spark, csv_file)
    assert df.columns == ["inventory_id", "store", "on_hand", "po_date", "vendor_no"]
    assert {k for _, k in df.dtypes} == {"string"}
    assert [tuple(r) for r in df.collect()] == [
        ("1_A_1", "1", None, "2016-01-02", "ACME, LLC  "),
        ("1_A_2", None, "NA", "Unknown", " 7 "),
    ]


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Store,Brand\n1,2\n")
    (tmp_path / "b.csv").write_text("Brand,Store\n2,1\n")
    with pytest.raises(Exception):
        read_extract(spark, str(tmp_path / "*.csv")).collect()


def test_catalog_goes_on_after_a_missing_file(spark, csv_file, tmp_path):
    target = str(tmp_path / "raw")
    files = {"raw_a": csv_file, "raw_b": str(tmp_path / "missing.csv"), "raw_c": csv_file}
    report = load_catalog(spark, files, target)
    assert report.rows_by_table == {"raw_a": 2, "raw_c": 2} and report.total_rows == 4
    assert [t for t, _ in report.errors] == ["raw_b"]
    assert report.errors_frame(spark).count() == 1
    assert loaded_table(spark, target, "raw_a").count() == 2
    # a second load replaces the table and adds to the audit
    load_catalog(spark, {"raw_a": csv_file}, target)
    assert loaded_table(spark, target, "raw_a").count() == 2
    audit = read_audit(spark, f"{target}/load_audit").collect()
    assert [r.table_name for r in audit] == ["raw_a", "raw_c", "raw_a"]
    assert all(r.rows_loaded == 2 and r.loaded_at is not None for r in audit)


def test_preview_keeps_the_first_rows_in_order(spark, tmp_path):
    source = tmp_path / "long.csv"
    source.write_text("Id\n" + "".join(f"{i}\n" for i in range(500)))
    write_preview(spark, str(source), str(tmp_path / "preview"))
    got = [r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "preview")).collect()]
    assert got == [str(i) for i in range(100)]


def test_contract_report(spark, raw):
    good = raw("raw_sales", [])
    problems = contract_report(
        spark, {"raw_sales": good.drop("volume").selectExpr("*", "1 AS surprise")}
    ).filter("table_name = 'raw_sales'")
    assert {(r.column_name, r.problem) for r in problems.collect()} == {
        ("volume", "missing"),
        ("surprise", "extra"),
    }


def test_column_audit(spark, raw):
    audit = column_audit({"raw_sales": raw("raw_sales", [{"brand": "1"}, {}])}).collect()
    assert [r.ordinal_position for r in audit] == list(range(1, 15))
    assert {r.column_name: r.filled_rows for r in audit if r.filled_rows} == {"brand": 1}


@pytest.fixture
def bad_csv(tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text('A,B,C\n1,x,y\n2,x,3,EXTRA\n3,y\n4,"two\nlines",z\n', encoding="utf-8")
    return str(path)


def test_malformed_records_are_reported_not_cut(spark, bad_csv, tmp_path):
    target = str(tmp_path / "raw")
    report = load_catalog(spark, {"t": bad_csv}, target, multi_line=True)
    assert report.errors == [("t", "2 malformed records")]
    rows = loaded_table(spark, target, "t").orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("1", "x", "y"), ("4", "two\nlines", "z")]
    texts = {r["malformed_record"] for r in malformed_records(spark, target, "t").collect()}
    assert texts == {"2,x,3,EXTRA", "3,y"}


def test_line_breaks_in_quotes_need_multi_line(spark, bad_csv, tmp_path):
    report = load_catalog(spark, {"t": bad_csv}, str(tmp_path / "raw"))
    assert report.errors == [("t", "4 malformed records")] and report.rows_by_table == {"t": 1}


def test_preview_keeps_the_text(spark, tmp_path):
    text = 'A,B\n"a ""q"" b",ACME   \n  x,"1,5"\n'
    (tmp_path / "in.csv").write_text(text, encoding="utf-8")
    write_preview(spark, str(tmp_path / "in.csv"), str(tmp_path / "preview"))
    part = next((tmp_path / "preview").glob("part-*.csv"))
    assert part.read_text(encoding="utf-8") == text


def test_a_load_killed_half_way_leaves_the_old_table(spark, csv_file, tmp_path, monkeypatch):
    target, longer = str(tmp_path / "raw"), tmp_path / "longer.csv"
    longer.write_text("InventoryId,Store,onHand,PODate,Vendor No.\n" + "1,2,3,4,5\n" * 7, encoding="utf-8")
    assert load_catalog(spark, {"t": csv_file}, target).rows_by_table == {"t": 2}

    def killed(self):
        raise RuntimeError("killed before the switch")

    with monkeypatch.context() as patched:
        patched.setattr(extracts.Replacement, "publish", killed)
        report = load_catalog(spark, {"t": str(longer)}, target)
    assert report.errors == [("t", "killed before the switch")] and not report.rows_by_table
    assert loaded_table(spark, target, "t").count() == 2
    # the next load replaces what the killed one has left
    reader = loaded_table(spark, target, "t")
    assert load_catalog(spark, {"t": str(longer)}, target).rows_by_table == {"t": 7}
    assert loaded_table(spark, target, "t").count() == 7
    assert reader.count() == 2  # planned before the switch, its files are still there


def test_old_versions_go(spark, tmp_path):
    table = str(tmp_path / "t")
    for n in range(1, 5):
        assert versions.replace_versioned(spark.range(n), table, keep=2) == n
    assert versions.versions(spark, table) == [3, 4]
    assert sorted(p.name for p in (tmp_path / "t").glob("version=*")) == ["version=000003", "version=000004"]
    assert versions.read_current(spark, table).count() == 4
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, str(tmp_path / "none"))


def test_the_text_is_read_once(spark, bad_csv, tmp_path, monkeypatch):
    calls = []
    plain = extracts.read_records
    monkeypatch.setattr(extracts, "read_records", lambda *a: calls.append(a) or plain(*a))
    report = load_catalog(spark, {"t": bad_csv, "u": bad_csv}, str(tmp_path / "raw"), True, at_once=2)
    assert len(calls) == 2 and report.rows_by_table == {"t": 2, "u": 2}
    assert [t for t, _ in report.errors] == ["t", "u"]


def test_a_file_of_bad_records_only(spark, tmp_path):
    (tmp_path / "x.csv").write_text("A,B\n1,2,3\n")
    report = load_catalog(spark, {"t": str(tmp_path / "x.csv")}, str(tmp_path / "raw"))
    assert report.rows_by_table == {"t": 0}
    found = loaded_table(spark, str(tmp_path / "raw"), "t")
    assert found.columns == ["a", "b"] and found.count() == 0
