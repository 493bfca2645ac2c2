"""Column expressions of the staging layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Target types. Keys are 64-bit so that a large catalogue fits.
KEY = "bigint"
COUNT_OR_PRICE = "decimal(10,2)"
MONEY = "decimal(12,2)"
DATE = "date"
# Fixed value: the placeholder the source systems write for a missing number.
UNKNOWN = "Unknown"


def cleaned(name: str) -> Column:
    """Trimmed text; blank and the placeholder become NULL."""
    return F.nullif(F.nullif(F.trim(F.col(name)), F.lit("")), F.lit(UNKNOWN))


def defensive_cast(name: str, target: str, strict: bool = True) -> Column:
    """Typed value of a text column. Other junk fails the job unless ``strict`` is off."""
    text = cleaned(name)
    return text.cast(target) if strict else text.try_cast(target)


def is_junk(name: str, target: str) -> Column:
    """True for text that is present but cannot be read as ``target``."""
    return cleaned(name).isNotNull() & cleaned(name).try_cast(target).isNull()


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast(COUNT_OR_PRICE))


def gross_margin_pct(retail: Column, cost: Column) -> Column:
    """Margin in percent of retail; NULL unless both prices are present and not zero."""
    retail, cost = zero_to_null(retail), zero_to_null(cost)
    return F.round((retail - cost) * 100 / retail, 2).cast("decimal(18,2)")


def carried_over(day: Column, period_end) -> Column:
    """Dated after the period; a missing date counts as not carried over."""
    return F.coalesce(day > F.lit(period_end), F.lit(False))


def safe_divide(x: Column, y: Column) -> Column:
    """Double quotient, NULL when the denominator is zero or missing."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def rounded(x: Column, digits: int = 4) -> Column:
    """Half-up rounding that is not thrown by the last bits of a double: 0.23375 may be
    held as 0.23374999999999999, so those bits are dropped first."""
    return F.round(x.cast("decimal(38,9)"), digits).cast("double")


def ratio(x: Column, y: Column, digits: int = 4) -> Column:
    return rounded(safe_divide(x, y), digits)
