import datetime as dt

from pyspark.sql import functions as F

from panelforge.functions.dates import calendar_parts, holiday_flags
from panelforge.operators.features import holiday_calendar, with_calendar, with_holiday_flags

HOLIDAYS_2024 = [
    "2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04",
    "2024-09-02", "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25",
]


def days_df(spark, *texts):
    return spark.createDataFrame([(dt.date.fromisoformat(t),) for t in texts], "target_date date")


def test_holidays_of_one_year(spark):
    out = holiday_calendar(days_df(spark, "2024-03-01"), "target_date").filter("year(day) = 2024")
    assert [str(r["day"]) for r in out.orderBy("day").collect()] == HOLIDAYS_2024


def test_observed_day_moves_and_may_cross_the_year(spark):
    out = holiday_calendar(days_df(spark, "2021-06-01", "2022-06-01"), "target_date")
    found = {str(r["day"]): r["holiday"] for r in out.collect()}
    assert found["2021-12-31"] == "new_years_day"  # Saturday 2022-01-01
    assert "2022-01-01" not in found
    assert found["2021-07-05"] == "independence_day"  # Sunday the 4th
    assert found["2022-12-26"] == "christmas_day"
    assert min(found) >= "2020" and max(found) >= "2023-12"


def _slow_holidays(year):
    """Holidays of a year by walking its days."""
    first, out = dt.date(year, 1, 1), set()
    seen = {}
    for i in range(366):
        d = first + dt.timedelta(i)
        if d.year != year:
            break
        seen[(d.month, d.weekday())] = seen.get((d.month, d.weekday()), 0) + 1
        nth = seen[(d.month, d.weekday())]
        if (d.month, d.weekday(), nth) in {(1, 0, 3), (2, 0, 3), (9, 0, 1), (10, 0, 2), (11, 3, 4)}:
            out.add(d)
        if d.month == 5 and d.weekday() == 0 and (d + dt.timedelta(7)).month == 6:
            out.add(d)
        if (d.month, d.day) in {(1, 1), (6, 19), (7, 4), (11, 11), (12, 25)}:
            out.add(d + dt.timedelta({5: -1, 6: 1}.get(d.weekday(), 0)))
    return out


def test_flags_agree_with_day_by_day_rules(spark):
    known = set().union(*[_slow_holidays(y) for y in range(1979, 2042)])
    start, end = dt.date(1980, 1, 1), dt.date(2040, 12, 31)
    days = spark.range((end - start).days + 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))
    rows = days.select("d", *[c.alias(n) for n, c in holiday_flags("d").items()]).collect()
    for r in rows:
        d = r["d"]
        near = {k: d + dt.timedelta(k) in known for k in (-3, -1, 0, 1, 3)}
        bridge = (d.weekday() == 4 and (near[3] or near[-1])) or (d.weekday() == 0 and (near[-3] or near[1]))
        assert (r[1], r[2], r[3], r[4]) == (int(near[0]), int(near[1]), int(near[-1]), int(bridge)), d


def test_thanksgiving_and_memorial_day_neighbours(spark):
    out = with_holiday_flags(days_df(spark, "2024-11-27", "2024-11-28", "2024-11-29", "2024-05-24", "2024-05-27"))
    got = {str(r[0]): tuple(r)[1:] for r in out.collect()}
    assert got["2024-11-27"] == (0, 1, 0, 0)
    assert got["2024-11-28"] == (1, 0, 0, 0)
    assert got["2024-11-29"] == (0, 0, 1, 1)
    assert got["2024-05-24"] == (0, 0, 0, 1)
    assert got["2024-05-27"][0] == 1


def test_empty_dates(spark):
    empty = spark.createDataFrame([], "target_date date")
    assert with_holiday_flags(empty).columns == [
        "target_date", "is_holiday", "is_day_before_holiday", "is_day_after_holiday", "is_bridge_day",
    ]
    assert holiday_calendar(empty, "target_date").count() == 0


def test_calendar_parts(spark):
    row = with_calendar(days_df(spark, "2024-12-29")).first()
    assert (row["target_dayofweek"], row["target_is_weekend"], row["target_month"], row["target_dayofyear"]) == (6, 1, 12, 364)
    assert abs(row["sin_dayofweek"] ** 2 + row["cos_dayofweek"] ** 2 - 1) < 1e-12
    assert list(calendar_parts(F.col("target_date"))) == [
        "target_dayofweek", "target_is_weekend", "target_month", "target_dayofyear",
    ]
