"""Long reports in order, cut to their first rows, or as they come."""

import pytest
from pyspark.sql import functions as F

from shelfwise.operators.presented import Presentation
from shelfwise.plans import reports
from shelfwise.plans.warehouse import Warehouse
from tests.conftest import SMALL


def order():
    return [F.asc("k"), F.desc_nulls_last("v"), F.asc("id")]


@pytest.fixture(scope="module")
def rows(spark):
    # a third of the rows has one key; ties and NULLs in what is ordered by
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("k"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 13).alias("v"),
        "id",
    )


def in_python(rows):
    return sorted(rows.collect(), key=lambda r: (r.k, r.v is None, -(r.v or 0), r.id))


@pytest.fixture(scope="module")
def plan(spark):
    return lambda df: df._jdf.queryExecution().executedPlan().toString()


def test_all_in_order(rows):
    assert Presentation().of(rows, order()).collect() == in_python(rows)


def test_as_they_come(rows, plan):
    df = Presentation(in_order=False).of(rows, order())
    assert sorted(df.collect(), key=str) == sorted(rows.collect(), key=str)
    assert "Exchange" not in plan(df) and "Sort" not in plan(df)


@pytest.mark.parametrize("top", [0, 1, 20, 5000])
def test_first_of_all(rows, plan, top):
    df = Presentation(top=top).of(rows, order())
    assert df.collect() == in_python(rows)[:top]
    if 0 < top < 3000:  # else Spark knows that there is nothing to cut
        assert "TakeOrderedAndProject" in plan(df) and "rangepartitioning" not in plan(df)


@pytest.mark.parametrize("top", [0, 1, 4, 5000])
def test_first_per_key(rows, plan, top):
    df = Presentation(top=top, per=("k",)).of(rows, order())
    planned = plan(df)
    seen, expected = {}, []
    for r in in_python(rows):
        seen[r.k] = seen.get(r.k, 0) + 1
        if seen[r.k] <= top:
            expected.append(r)
    assert df.collect() == expected and df.columns == rows.columns
    if top in (1, 4):
        # rows beyond the limit go before the shuffle as well as after it
        assert planned.count("WindowGroupLimit") == 2
    unsorted = Presentation(top=top, per=("k",), in_order=False).of(rows, order())
    assert sorted(unsorted.collect(), key=str) == sorted(expected, key=str)


def test_no_rows(rows):
    for shown in (Presentation(), Presentation(top=3), Presentation(top=3, per=("k",))):
        assert shown.of(rows.limit(0), order()).collect() == []


def test_refused():
    with pytest.raises(ValueError, match="top is -1"):
        Presentation(top=-1)
    with pytest.raises(ValueError, match="needs top"):
        Presentation(per=("k",))


def test_reports_are_sorted_only_where_asked(spark, plan):
    w = Warehouse.over_feed(spark, SMALL)
    for report in (reports.risk_detail, reports.rop_gap, reports.replenish_matrix):
        whole = report(w)
        assert "rangepartitioning" in plan(whole)
        assert "rangepartitioning" not in plan(report(w, shown=Presentation(in_order=False)))
        first = report(w, shown=Presentation(top=30))
        assert "TakeOrderedAndProject" in plan(first)
        assert first.collect() == whole.take(30)
