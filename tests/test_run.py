import datetime as dt

from shelfwise.config import CALENDAR_2016
from shelfwise.run import run
from shelfwise.sources.schemas import RAW_COLUMNS
from tests import tiny


def _camel(name):
    return "".join(part.capitalize() for part in name.split("_"))


def test_from_csv_to_results(spark, raw, tmp_path):
    files = {}
    for table, df in tiny.raw_tables(raw).items():
        files[table] = str(tmp_path / f"{table}.csv")
        rows = [",".join("" if v is None else f'"{v}"' for v in r) for r in df.collect()]
        header = ",".join(_camel(c) for c in RAW_COLUMNS[table])
        with open(files[table], "w", encoding="utf-8-sig") as f:
            f.write("\n".join([header, *rows]) + "\n")
    target = str(tmp_path / "lake")
    report = run(spark, files, target, CALENDAR_2016, ("kpi_a2", "rpt06", "dq08"))
    assert report.errors == [] and report.total_rows == 7 + 1 + 1 + 2 + 6 + 4
    totals = spark.read.parquet(f"{target}/results/kpi_a2_sales_totals").first()
    assert totals.total_sales_revenue == 153 and totals.date_start == dt.date(2016, 1, 1)
    cards = spark.read.parquet(f"{target}/results/rpt06_risk_cards").first()
    assert cards.dead_stock_value == 60 and cards.dead_stock_sku_count == 1
    assert spark.read.parquet(f"{target}/results/dq08_staging_row_audit").filter("ok").count() == 6
    assert spark.read.parquet(f"{target}/raw/load_audit").count() == 6


def test_stops_when_an_extract_lacks_a_column(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text("Store\n1\n")
    report = run(spark, {"raw_sales": str(path)}, str(tmp_path / "lake"), CALENDAR_2016)
    assert ("raw_sales", "column brand missing") in report.errors
    assert ("raw_purchases", "column brand missing") in report.errors
