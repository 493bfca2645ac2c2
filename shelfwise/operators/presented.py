"""How the rows of a detailed report are handed over: all in order, only the first, or as they come.

A total order sorts every row, which pays for a reader and not for a table that is stored, joined
or added up again. The first rows need no sort of all: each task keeps its own first rows and only
these are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rank"


@dataclass(frozen=True)
class Presentation:
    """``top`` first rows, of all or for each value of ``per``; without it all rows.

    ``in_order``: whether the rows that are handed over are sorted. ``top`` chooses by the order
    of the report in any case. A ``top`` of 0 gives no rows.
    """

    in_order: bool = True
    top: int | None = None
    per: tuple[str, ...] = ()

    def __post_init__(self):
        if self.top is not None and self.top < 0:
            raise ValueError(f"top is {self.top}")
        if self.per and self.top is None:
            raise ValueError("per says what top is counted by, so it needs top")

    def of(self, rows: DataFrame, order: list[Column]) -> DataFrame:
        """``rows`` in ``order``, which is unique on them, presented in this way."""
        if self.top is None:
            return rows.orderBy(*order) if self.in_order else rows
        if not self.per:
            # sort and limit become one operator, a heap in each task
            return rows.orderBy(*order).limit(self.top)
        rank = F.row_number().over(Window.partitionBy(*self.per).orderBy(*order))
        # tasks drop rows beyond the limit before the shuffle, so a hot value stays small
        first = rows.withColumn(_RANK, rank).filter(F.col(_RANK) <= self.top).drop(_RANK)
        return first.orderBy(*order) if self.in_order else first


ALL_IN_ORDER = Presentation()
