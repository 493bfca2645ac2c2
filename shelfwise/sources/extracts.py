"""Reading CSV extracts as text, loading them into the raw layer, auditing the load."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.config import Period
from shelfwise.operators.profile import PROFILE_FILE, can_profile, observable
from shelfwise.sources.versions import (
    Replacement,
    current_path,
    read_current,
    read_manifest,
    replace_versioned,
    write_manifest,
)

PREVIEW_ROWS = 100
LOADS_AT_ONCE = 4
AUDIT_SCHEMA = "table_name string, rows_loaded bigint, source_file string, loaded_at timestamp"

# Word boundaries and separators of the header names.
_ACRONYM_WORD = re.compile(r"(?<=[A-Z])(?=[A-Z][a-z])")
_LOWER_UPPER = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SEPARATORS = re.compile(r"[\s\-/]+")
_DROPPED = re.compile(r"[^A-Za-z0-9_]")


def snake_case(header: str) -> str:
    """``PODate`` -> ``po_date``, ``onHand`` -> ``on_hand``, ``Vendor No.`` -> ``vendor_no``."""
    name = _ACRONYM_WORD.sub("_", header.strip())
    name = _LOWER_UPPER.sub("_", name)
    name = _SEPARATORS.sub("_", name)
    return _DROPPED.sub("", name).lower()


MALFORMED = "malformed_record"
KIND, GOOD, BAD = "kind", "good", "malformed"


def _csv(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        # an extract may be many files: one whose header differs fails, it is not misread
        .option("enforceSchema", False)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("nullValue", "")
        .option("emptyValue", "")
    )


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, headers in snake case, empty and quoted empty as NULL, and in
    ``MALFORMED`` the text of records that have more or fewer fields than the header.

    Words such as ``NA`` or ``Unknown`` and inner blanks stay as they are. Files are
    split between tasks unless ``multi_line`` asks for line breaks inside quotes.
    """
    header = _csv(spark, multi_line).option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, MALFORMED]])
    df = _csv(spark, multi_line).option("columnNameOfCorruptRecord", MALFORMED).schema(schema).csv(path)
    names = [snake_case(c.lstrip("\ufeff")) for c in header]
    df = df.toDF(*names, MALFORMED)
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names], MALFORMED)


def read_extract(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The well-formed records of an extract, without the ``MALFORMED`` column."""
    return read_records(spark, path, multi_line).filter(F.col(MALFORMED).isNull()).drop(MALFORMED)


def write_preview(
    spark: SparkSession,
    path: str,
    target: str,
    rows: int = PREVIEW_ROWS,
    multi_line: bool = False,
) -> None:
    """The first rows of an extract as one review CSV, in file order, their text unchanged.

    The limit stops the scan early, so this never reads the whole extract.
    """
    first = _csv(spark, multi_line).option("inferSchema", False).csv(path).limit(rows)
    (
        first.coalesce(1)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(target)
    )


@dataclass
class LoadReport:
    rows_by_table: dict[str, int] = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)

    @property
    def total_rows(self) -> int:
        return sum(self.rows_by_table.values())

    def errors_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.errors, "table_name string, error string")


def replace_table(df: DataFrame, path: str) -> int:
    """Replace a stored table, see ``versions``; returns its number of rows."""
    return replace_versioned(df, path)


def append_audit(spark: SparkSession, audit_path: str, table: str, rows: int, source: str) -> None:
    entry = spark.createDataFrame(
        [(table, rows, source)], "table_name string, rows_loaded bigint, source_file string"
    )
    entry.withColumn("loaded_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
        audit_path
    )


def read_audit(spark: SparkSession, audit_path: str) -> DataFrame:
    return (
        spark.read.schema(AUDIT_SCHEMA)
        .parquet(audit_path)
        .orderBy(F.desc("loaded_at"), "table_name")
    )


def load_table(
    spark: SparkSession,
    table: str,
    path: str,
    target: str,
    multi_line: bool = False,
    period: Period | None = None,
) -> tuple[int, int]:
    """Load one extract in one pass over its text; returns the rows that are good and malformed.

    Both kinds are written by the same job, apart by a partition column, and become visible
    together: ``<version>/kind=good`` is the table, ``kind=malformed`` has the text of the others.
    With a ``period`` the same job observes the audit of the good rows, see ``loaded_profile``.
    """
    seen = Observation()
    records = read_records(spark, path, multi_line)
    own = Replacement(spark, f"{target}/{table}")
    kind = F.when(F.col(MALFORMED).isNull(), GOOD).otherwise(BAD)
    is_good = F.col(MALFORMED).isNull()
    audit = observable(table, period, is_good) if period and can_profile(table, records.columns) else []
    (
        records.observe(seen, F.count_if(is_good).alias("good"), F.count(MALFORMED).alias("bad"), *audit)
        .withColumn(KIND, kind)
        .write.partitionBy(KIND)
        .parquet(own.path)
    )
    counts = seen.get
    if not counts["good"]:  # a table without rows still has its columns
        empty = records.filter(F.lit(False))
        empty.write.mode("overwrite").parquet(f"{own.path}/{KIND}={GOOD}")
    if audit:
        # kept before the version can be seen, so a finished version has its own profile
        profile = {k: v for k, v in counts.items() if k not in ("good", "bad")}
        write_manifest(spark, f"{own.path}/{PROFILE_FILE}", {"period": str(period), "seen": profile})
    own.publish()
    return counts["good"], counts["bad"]


def loaded_profile(spark: SparkSession, target: str, table: str, period: Period) -> dict | None:
    """What was observed while the current version was written; None if not for this period."""
    kept = read_manifest(spark, f"{current_path(spark, f'{target}/{table}')}/{PROFILE_FILE}")
    return kept["seen"] if kept and kept["period"] == str(period) else None


def loaded_table(spark: SparkSession, target: str, table: str) -> DataFrame:
    """The well-formed records of the current version, all columns as text."""
    return spark.read.parquet(f"{current_path(spark, f'{target}/{table}')}/{KIND}={GOOD}").drop(MALFORMED)


def malformed_records(spark: SparkSession, target: str, table: str) -> DataFrame:
    """The text of the current version's malformed records, with the columns that could be read."""
    everything = read_current(spark, f"{target}/{table}")
    return everything.filter(F.col(KIND) == BAD).drop(KIND)


def load_catalog(
    spark: SparkSession,
    files: dict[str, str],
    target: str,
    multi_line: bool = False,
    at_once: int = LOADS_AT_ONCE,
    period: Period | None = None,
) -> LoadReport:
    """Load each table from its file, replacing it; a bad file does not stop the rest.

    ``at_once`` tables load side by side: the driver's threads only wait for their jobs, and
    small tables fill the cores that a large one leaves. Malformed records are errors of the
    report; ``malformed_records`` has their text, the table the other records.
    """
    report = LoadReport()

    def load(table: str) -> tuple[int, int] | Exception:
        try:
            return load_table(spark, table, files[table], target, multi_line, period)
        except Exception as failure:  # noqa: BLE001 - recorded, the other tables still load
            return failure

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        results = dict(zip(files, pool.map(load, files), strict=True))
    # in the order asked for, whichever ended first
    for table, result in results.items():
        if isinstance(result, Exception):
            report.errors.append((table, str(result).splitlines()[0]))
            continue
        rows, bad = result
        append_audit(spark, f"{target}/load_audit", table, rows, files[table])
        report.rows_by_table[table] = rows
        if bad:
            report.errors.append((table, f"{bad} malformed records"))
    return report
