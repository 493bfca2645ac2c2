"""The whole pipeline over CSV extracts, as one Spark application.

    spark-submit shelfwise/run.py --period 2016-01-01 2016-12-31 --target <shared folder> \\
        raw_sales=<csv> raw_purchases=<csv> raw_beg_inventory=<csv> raw_end_inventory=<csv> \\
        raw_purchase_prices=<csv> raw_invoice_purchases=<csv> [--only kpi_ rpt_ ...]

Loads the raw layer with its audit, builds staging and marts, and writes every query's
result below ``<target>/results``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from shelfwise import catalog  # noqa: E402
from shelfwise.config import Period  # noqa: E402
from shelfwise.plans import staging  # noqa: E402
from shelfwise.plans.warehouse import Warehouse  # noqa: E402
from shelfwise.operators.profile import Profiles  # noqa: E402
from shelfwise.sources.extracts import LoadReport, load_catalog, loaded_profile, loaded_table  # noqa: E402
from shelfwise.sources.schemas import RAW_TABLES, contract_report, text_schema  # noqa: E402


def run(
    spark: SparkSession,
    files: dict[str, str],
    target: str,
    period: Period,
    only: tuple[str, ...] = (),
    multi_line: bool = False,
    set_aside: bool = False,
) -> LoadReport:
    """Loads, builds and writes. Stops after the load when a raw table is missing or odd.

    A value that cannot be cast ends the run, unless ``set_aside`` is asked for: then rows with
    such values go to ``<target>/quarantine/<table>``, with the offending columns, and the run
    goes on with the others. Malformed records end the run unless they are set aside too.
    The audits of the raw layer are answered from what the load observed, without a scan.
    """
    report = load_catalog(spark, files, f"{target}/raw", multi_line, period=period)
    if set_aside:
        report.errors = [e for e in report.errors if not e[1].endswith("malformed records")]
    loaded = {t: loaded_table(spark, f"{target}/raw", t) for t in report.rows_by_table}
    problems = contract_report(spark, loaded).filter("problem <> 'extra'")
    report.errors += [
        (r.table_name, f"column {r.column_name} {r.problem}") for r in problems.collect()
    ]
    if report.errors:
        return report
    raw = {t: loaded[t].to(text_schema(t)) for t in RAW_TABLES}
    if set_aside:
        for staged, table in staging.STAGED_FROM.items():
            junk = staging.quarantine(raw[table], staged)
            junk.write.mode("overwrite").parquet(f"{target}/quarantine/{table}")
            raw[table] = staging.clean(raw[table], staged)
    warehouse = Warehouse.over_raw(spark, raw, period, target)
    jobs = catalog.jobs()
    if not set_aside:  # else the audit is of the rows that are left
        observed = {t: loaded_profile(spark, f"{target}/raw", t, period) for t in RAW_TABLES}
        if all(observed.values()):
            jobs |= catalog.audit_jobs(Profiles(spark, observed))
    for name, job in jobs.items():
        if not only or name.startswith(only):
            job(warehouse).write.mode("overwrite").parquet(f"{target}/results/{name}")
    return report


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("files", nargs="+", metavar="table=csv")
    parser.add_argument("--target", required=True)
    parser.add_argument("--period", nargs=2, type=dt.date.fromisoformat, required=True)
    parser.add_argument("--only", nargs="*", default=[], help="name prefixes of the queries")
    parser.add_argument("--multi-line", action="store_true", help="line breaks inside quotes")
    parser.add_argument("--set-aside", action="store_true", help="go on without bad rows")
    options = parser.parse_args(argv)
    spark = SparkSession.builder.appName("shelfwise").getOrCreate()
    report = run(
        spark,
        dict(f.split("=", 1) for f in options.files),
        options.target,
        Period(*options.period),
        tuple(options.only),
        options.multi_line,
        options.set_aside,
    )
    for table, rows in report.rows_by_table.items():
        print(f"{table}: {rows} rows")
    for table, error in report.errors:
        print(f"{table}: {error}")
    return 1 if report.errors else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
