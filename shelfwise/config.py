"""Parameters of the pipeline. Nothing here depends on the data volume."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# Business assumptions that decide the results.
DSI_DAYS = 365
LEAD_TIME_DAYS = 7
SERVICE_LEVEL_Z = 1.65
LOW_STOCK_FACTOR = "1.2"
DEAD_STOCK_WINDOW_DAYS = 90
ABC_A_MAX_PCT = 80
ABC_B_MAX_PCT = 95
PRICE_TOLERANCE = "0.02"
STOCKOUT_ALERT_RATE = 0.05
DEAD_STOCK_ALERT_RATE = 0.03
REORDER_WEEKS = 2
REPORT_TOP_N = 20
BEST_SELLERS_N = 10


@dataclass(frozen=True)
class Period:
    """The reporting period. Purchases may start one year before it."""

    start: dt.date
    end: dt.date

    @property
    def purchases_start(self) -> dt.date:
        leap_day = (self.start.month, self.start.day) == (2, 29)
        return self.start.replace(year=self.start.year - 1, day=28 if leap_day else self.start.day)

    @property
    def weeks(self) -> float:
        return ((self.end - self.start).days + 1) / 7

    @property
    def last_quarter_start(self) -> dt.date:
        """First day of the calendar quarter in which the period ends."""
        return self.end.replace(month=(self.end.month - 1) // 3 * 3 + 1, day=1)


@dataclass(frozen=True)
class Replenishment:
    """Safety stock parameters; ``deviation`` is ``as_written`` or ``active_days``.

    ``as_written`` takes the mean over days with sales and the spread over all
    calendar days; ``active_days`` is the plain population deviation.
    """

    lead_time_days: int = LEAD_TIME_DAYS
    z: float = SERVICE_LEVEL_Z
    deviation: str = "as_written"


@dataclass(frozen=True)
class Settings:
    period: Period
    replenishment: Replenishment = field(default_factory=Replenishment)


CALENDAR_2016 = Period(dt.date(2016, 1, 1), dt.date(2016, 12, 31))
