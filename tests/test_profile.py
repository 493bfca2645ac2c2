import pytest

from shelfwise import catalog, oracles
from shelfwise.config import CALENDAR_2016
from shelfwise.operators.profile import Profiles
from shelfwise.plans.warehouse import Warehouse
from shelfwise.sources.extracts import load_catalog, loaded_profile, loaded_table
from shelfwise.sources.schemas import RAW_COLUMNS, RAW_TABLES
from tests import tiny


@pytest.fixture(scope="module")
def loaded(spark, raw, tmp_path_factory):
    """The tiny extracts as CSV, with odd values and malformed records, loaded."""
    folder = tmp_path_factory.mktemp("profile")
    files = {}
    for table, columns in RAW_COLUMNS.items():
        rows = [list(r) for r in tiny.raw_tables(raw)[table].select(*columns).collect()]
        odd = {"sales_quantity": "-3", "sales_date": "1999-01-01", "on_hand": "-1", "price": "x", "po_date": "soon"}
        rows += [[odd.get(c) for c in columns], [None] * (len(columns) - 1) + ["last"]]
        text = [",".join(columns), *[",".join(f'"{v}"' if v is not None else "" for v in r) for r in rows]]
        files[table] = str(folder / f"{table}.csv")
        with open(files[table], "w", encoding="utf-8") as f:
            f.write("\n".join([*text, ",".join(["cut"] * (len(columns) + 2))]) + "\n")
    target = str(folder / "lake")
    report = load_catalog(spark, files, target, period=CALENDAR_2016)
    assert all(e.endswith("1 malformed records") for _, e in report.errors)
    return target


def test_observed_audits_equal_the_scanned_ones(spark, loaded, tmp_path):
    observed = {t: loaded_profile(spark, loaded, t, CALENDAR_2016) for t in RAW_TABLES}
    raw = {t: loaded_table(spark, loaded, t) for t in RAW_TABLES}
    w = Warehouse.over_raw(spark, raw, CALENDAR_2016, str(tmp_path))
    scanned = catalog.jobs()
    answered = catalog.audit_jobs(Profiles(spark, observed))
    assert set(oracles.BUSINESS_RULES) | {"src08_column_audit", "dq04_date_ranges"} <= set(answered)
    failures = 0
    for name, job in answered.items():
        got, want = job(w), scanned[name](w)
        assert got.dtypes == want.dtypes, name
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan, name
        failures += sum(r.fail_count for r in got.collect()) if name == "dq03_business_rules" else 0
    assert failures >= 4


def test_a_profile_belongs_to_its_version_and_period(spark, loaded, tmp_path):
    other = type(CALENDAR_2016)(CALENDAR_2016.start, CALENDAR_2016.start)
    assert loaded_profile(spark, loaded, "raw_sales", other) is None
    path = tmp_path / "short.csv"
    path.write_text("brand\n1\n")
    load_catalog(spark, {"raw_sales": str(path)}, str(tmp_path / "lake"), period=CALENDAR_2016)
    # without the columns of the contract there is nothing to audit
    assert loaded_profile(spark, str(tmp_path / "lake"), "raw_sales", CALENDAR_2016) is None


def test_an_empty_extract(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(",".join(RAW_COLUMNS["raw_sales"]) + "\n")
    load_catalog(spark, {"raw_sales": str(path)}, str(tmp_path / "lake"), period=CALENDAR_2016)
    seen = loaded_profile(spark, str(tmp_path / "lake"), "raw_sales", CALENDAR_2016)
    assert seen["rows"] == 0 and seen["first_day"] is None and seen["missing sales_date"] == 0
