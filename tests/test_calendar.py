"""The calendar as an effective-dated dimension: swap days, overrides, windows, years without data."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillsight.operators import features as FT
from tillsight.sources import dims


def days(spark, start, end):
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))


def test_national_day_2024(spark):
    """A worked Sunday before the holiday, seven days off, a worked Saturday after it."""
    got = {str(r.date): r for r in dims.calendar_from_dates(days(spark, "2024-09-28", "2024-10-13")).collect()}
    assert [d for d in sorted(got) if got[d].workday == 0] == ["2024-09-28"] + [f"2024-10-0{k}" for k in range(1, 8)] + ["2024-10-13"]
    assert (got["2024-09-29"].holiday_type, got["2024-09-29"].holiday_name, got["2024-09-29"].holiday_recess) == ("recess", "国庆节", 1)
    assert (got["2024-10-12"].weekend, got["2024-10-12"].workday, got["2024-10-12"].holiday_type) == (1, 1, "recess")
    assert all(got[f"2024-10-0{k}"].holiday_legal == 1 and got[f"2024-10-0{k}"].holiday_type == "holiday" for k in range(1, 8))
    assert got["2024-10-08"].holiday_name is None and got["2024-10-13"].holiday_legal == 0
    streak = FT.holiday_streak(dims.calendar_from_dates(days(spark, "2024-09-28", "2024-10-10")), "holiday_legal").collect()
    assert {r.holiday_streak for r in streak if r.holiday_legal == 1} == {7}


def test_year_range_2024(spark):
    got = {str(r.ds): r for r in dims.calendar_for_years(spark, 2024, 2024).collect()}
    assert len(got) == 366
    # in the window of the holiday the swap day counts as holiday, outside of it as recess
    assert got["2024-09-29"].holiday_recess == 2 and got["2024-10-12"].holiday_recess == 1 and got["2024-04-28"].holiday_recess == 1
    assert {got[d].holiday_name for d in ("2024-06-10", "2024-06-11")} == {"端午节"} and got["2024-09-17"].holiday_name == "中秋节"
    assert got["2024-04-04"].holiday_name == "清明节" and got["2024-02-07"].holiday_name == "春节"
    scores = {r.holiday_impact: r for r in FT.holiday_impact(dims.calendar_for_years(spark, 2024, 2024), "ds").collect()}
    assert set(scores) == {0, 1, 2, 3, 4}


def test_rules_are_effective_dated(spark):
    legal = lambda y: {(str(r.date), r.name) for r in dims.holiday_days(days(spark, f"{y}-01-01", f"{y}-12-31")).collect()
                       if r.kind == "legal" and r.date.year == y}
    assert len(legal(1997)) == 7 and len(legal(2001)) == 10 and len(legal(2010)) == 11 and len(legal(2025)) == 13
    assert ("2010-02-13", "春节") in legal(2010) and ("2016-02-07", "春节") not in legal(2016)
    assert not any(n in ("端午节", "中秋节", "清明节") for _, n in legal(2001))


def test_announced_days_override_rules(spark):
    table = spark.createDataFrame([("2024-05-01", "劳动节", "work"), ("2024-05-06", "劳动节", "off"), ("2024-05-06", "别的", "off")],
                                  "date string, name string, kind string")
    got = {str(r.date): r for r in dims.calendar_from_dates(days(spark, "2024-04-29", "2024-05-08"), days=table).collect()}
    assert got["2024-05-01"].holiday_legal == 0 and got["2024-05-01"].workday == 1
    assert got["2024-05-06"].holiday_legal == 1 and got["2024-05-06"].holiday_name == "别的" and got["2024-05-05"].holiday_legal == 0


@pytest.mark.parametrize("year", [1994, 2029, 2060])
def test_years_without_data_are_refused(spark, year):
    with pytest.raises(PySparkException, match=f"no date of the holiday .* in the year {year}"):
        dims.calendar_from_dates(days(spark, f"{year}-06-01", f"{year}-06-03")).collect()
    with pytest.raises(PySparkException, match=f"{year}"):
        dims.calendar_for_years(spark, year, year).collect()


def test_turn_of_the_year(spark):
    """The window of a holiday reaches into the year before; the last year with data needs no later one."""
    got = {str(r.ds): r for r in dims.calendar_years_from(days(spark, "2022-12-28", "2023-01-03")).collect()}
    assert got["2023-01-02"].holiday_legal == 1 and got["2023-01-03"].holiday_name == "元旦" and got["2022-12-30"].holiday_name == ""
    assert dims.calendar_for_years(spark, 2028, 2028).count() == 366
    spring = [dt.date.fromisoformat(d) for n, d in dims.HOLIDAY_ANCHORS if n == "春节"]
    assert all(350 <= (b - a).days <= 390 for a, b in zip(spring, spring[1:]))      # a lunar year
