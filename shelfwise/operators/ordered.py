"""Row numbers and running totals over a whole table without a single-task sort.

The table is written once and counted on the way, then cut into ranges of the order with
about ``ROWS_PER_RANGE`` rows each, and written again with the number of the range on each
row. Totals per range give each range its offset; the rest is a window inside the range, or for
row numbers the place at which a row was written in its sorted range, without another shuffle.
So the number of tasks grows with the table while the rows per task do not, and the written
copies keep retried tasks from seeing other range bounds. A table that fits one range
is sorted by one task as it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfwise.session import cut_lineage

ROWS_PER_RANGE = 1_000_000
_RANGE, _PLACE = "_range", "_place"
PLACES = 2**33 - 1  # the bits of monotonically_increasing_id that count within a partition


def _in_ranges(
    df: DataFrame, order: list[Column], rows_per_range: int, placed: bool = False
) -> DataFrame:
    """``df`` with the number of the range and, if ``placed``, the place in it from 0 on each row."""
    seen = Observation()
    copy = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows")), "counted")
    ranges = max(1, math.ceil(seen.get["rows"] / rows_per_range))
    ranged = copy.repartitionByRange(ranges, *order)
    added = {_RANGE: F.spark_partition_id()}
    if placed:
        ranged = ranged.sortWithinPartitions(*order)
        added[_PLACE] = F.monotonically_increasing_id().bitwiseAND(F.lit(PLACES))
    return cut_lineage(ranged.withColumns(added), "ranges")


def _with_offsets(ranged: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Adds ``<name>_before`` and ``<name>_overall`` for each total.

    The unpartitioned windows and the broadcast see one row per range, i.e. a
    ``ROWS_PER_RANGE``-th of the table.
    """
    per_range = ranged.groupBy(_RANGE).agg(*[c.alias(n) for n, c in totals.items()])
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.partitionBy()
    offsets = per_range.select(
        _RANGE,
        *[F.sum(n).over(before).alias(f"{n}_before") for n in totals],
        *[F.sum(n).over(overall).alias(f"{n}_overall") for n in totals],
    )
    return ranged.join(F.broadcast(offsets), _RANGE)


def number_rows(
    df: DataFrame,
    order: list[Column],
    name: str,
    total_name: str | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``name`` = 1..n in ``order``, which must be unique; ``total_name`` = n."""
    ranged = _in_ranges(df, order, rows_per_range, placed=True)
    placed = _with_offsets(ranged, {"n": F.count(F.lit(1))})
    number = F.coalesce(F.col("n_before"), F.lit(0)) + F.col(_PLACE) + 1
    columns = [number.cast("bigint").alias(name)]
    if total_name:
        columns.append(F.col("n_overall").alias(total_name))
    return placed.select(*columns, *df.columns)


def running_total(
    df: DataFrame,
    order: list[Column],
    value: str,
    total: str,
    grand_total: str,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Running sum of ``value`` in ``order`` (unique) and its grand total."""
    placed = _with_offsets(_in_ranges(df, order, rows_per_range), {"v": F.sum(value)})
    within = (
        Window.partitionBy(_RANGE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kind = df.select(F.sum(value).alias("s")).schema["s"].dataType
    return placed.select(
        *df.columns,
        F.col("v_overall").cast(kind).alias(grand_total),
        (F.coalesce(F.col("v_before"), F.lit(0)) + F.sum(value).over(within))
        .cast(kind)
        .alias(total),
    )
