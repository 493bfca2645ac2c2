import datetime as dt

from shelfwise.config import Period


def test_leap_day_period():
    assert Period(dt.date(2016, 2, 29), dt.date(2016, 12, 31)).purchases_start == dt.date(2015, 2, 28)


def test_quarter_and_weeks():
    period = Period(dt.date(2016, 1, 1), dt.date(2016, 12, 31))
    assert period.last_quarter_start == dt.date(2016, 10, 1) and period.weeks == 366 / 7
