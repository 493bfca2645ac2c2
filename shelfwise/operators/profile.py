"""The audit of the raw layer from what was observed while it was written.

Row counts, missing values, business rules, date ranges and filled columns are all plain
aggregates over one table. Observed on the write that loads it, they cost no scan later; they are
kept beside the version they belong to, so a later application finds them too. Each report has
the columns, types and rows of its scanned form in ``quality`` and ``schemas``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.config import Period
from shelfwise.operators import quality
from shelfwise.sources.schemas import RAW_COLUMNS

PROFILE_FILE = "_profile.json"
ROWS, FIRST_DAY, LAST_DAY, OUTSIDE = "rows", "first_day", "last_day", "outside"


def _parts(table: str, period: Period) -> dict[str, tuple[str, Column]]:
    """Name to kind (``count``, ``min``, ``max``) and what is counted or compared."""
    parts = {ROWS: ("count", F.lit(True))}
    parts |= {f"filled {c}": ("count", F.col(c).isNotNull()) for c in RAW_COLUMNS[table]}
    parts |= {f"missing {c}": ("count", quality.missing(table, c)) for c in quality.REQUIRED[table]}
    parts |= {f"rule {n}": ("count", failed) for n, failed in quality.business_checks().get(table, {}).items()}
    if table in quality.dated(period):
        day, outside = quality.dated(period)[table]
        parts |= {FIRST_DAY: ("min", day), LAST_DAY: ("max", day), OUTSIDE: ("count", outside)}
    return parts


def observable(table: str, period: Period, among: Column) -> list[Column]:
    """The aggregates of ``table`` over its rows ``among`` those that pass by."""
    made = {
        "count": lambda c: F.count_if(among & c),
        "min": lambda c: F.min(F.when(among, c)).cast("string"),
        "max": lambda c: F.max(F.when(among, c)).cast("string"),
    }
    return [made[kind](c).alias(name) for name, (kind, c) in _parts(table, period).items()]


def can_profile(table: str, columns: list[str]) -> bool:
    return table in RAW_COLUMNS and set(RAW_COLUMNS[table]) <= set(columns)


class Profiles:
    """Reports over observed values, given per raw table; no job touches the tables."""

    def __init__(self, spark: SparkSession, observed: dict[str, dict]):
        self.spark = spark
        self.observed = observed

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def row_counts(self) -> DataFrame:
        rows = [(t, seen[ROWS]) for t, seen in sorted(self.observed.items())]
        return self._frame(rows, "table_name string, row_count bigint")

    def null_counts(self, table: str) -> DataFrame:
        names, seen = quality.REQUIRED[table], self.observed[table]
        schema = ", ".join(["total_rows bigint", *[f"null_{c} bigint" for c in names]])
        return self._frame([(seen[ROWS], *[seen[f"missing {c}"] for c in names])], schema)

    def _rules(self) -> list[tuple[str, int]]:
        found = [(k.removeprefix("rule "), n) for seen in self.observed.values() for k, n in seen.items() if k.startswith("rule ")]
        return sorted(found)

    def business_rules(self) -> DataFrame:
        return self._frame(self._rules(), "check_name string, fail_count bigint")

    def business_rule(self, check: str) -> DataFrame:
        return self._frame([r for r in self._rules() if r[0] == check], "check_name string, fail_count bigint")

    def date_ranges(self, period: Period) -> DataFrame:
        rows = [
            (t, self.observed[t][FIRST_DAY], self.observed[t][LAST_DAY], self.observed[t][OUTSIDE])
            for t in quality.dated(period)
        ]
        text = self._frame(rows, "table_name string, min_date string, max_date string, out_of_range bigint")
        return text.withColumns({c: F.col(c).cast("date") for c in ("min_date", "max_date")})

    def column_audit(self) -> DataFrame:
        rows = [
            (t, c, "string", place, seen[f"filled {c}"])
            for t, seen in sorted(self.observed.items())
            for place, c in enumerate(RAW_COLUMNS[t], start=1)
        ]
        kinds = "table_name string, column_name string, data_type string, ordinal_position int, filled_rows bigint"
        return self._frame(rows, kinds)
