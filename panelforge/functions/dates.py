"""Date expressions: calendar parts of a day and observed federal holidays.

Whether a day is an observed holiday depends on its weekday, month and day of
month alone, and so do the flags of its neighbours.  Each flag is therefore a
lookup of one integer in a set of constants, which Spark compiles to a switch:
no dimension table, no join, no range of years to size.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MONDAY, TUESDAY, THURSDAY, FRIDAY, SATURDAY, SUNDAY = 0, 1, 3, 4, 5, 6

# Fixed values: (month, weekday, which one in the month); -1 is the last one.
FLOATING_HOLIDAYS = {
    "martin_luther_king_day": (1, MONDAY, 3),
    "washingtons_birthday": (2, MONDAY, 3),
    "memorial_day": (5, MONDAY, -1),
    "labor_day": (9, MONDAY, 1),
    "columbus_day": (10, MONDAY, 2),
    "thanksgiving_day": (11, THURSDAY, 4),
}
# Fixed values: (month, day); Saturday is observed on Friday, Sunday on Monday.
FIXED_HOLIDAYS = {
    "new_years_day": (1, 1),
    "juneteenth": (6, 19),
    "independence_day": (7, 4),
    "veterans_day": (11, 11),
    "christmas_day": (12, 25),
}


DayKey = tuple[int, int, int]  # weekday, month, day of month


def _moved(key: DayKey, days: int) -> DayKey:
    """The key of the day that lies ``days`` after a day with this key.

    No holiday lies within four days of the end of February, so any year serves.
    """
    weekday, month, day = key
    other = dt.date(2001, month, day) + dt.timedelta(days)
    return (weekday + days) % 7, other.month, other.day


def _floating_keys(month: int, weekday: int, nth: int) -> set[DayKey]:
    if nth > 0:
        days = range(7 * nth - 6, 7 * nth + 1)
    else:
        last = (dt.date(2001, month % 12 + 1, 1) - dt.timedelta(1)).day
        days = range(last - 6, last + 1)
    return {(weekday, month, day) for day in days}


def _observed_keys(month: int, day: int) -> set[DayKey]:
    on_the_day = {(weekday, month, day) for weekday in range(SATURDAY)}
    return on_the_day | {_moved((SATURDAY, month, day), -1), _moved((SUNDAY, month, day), 1)}


HOLIDAY_KEYS: dict[str, set[DayKey]] = {
    **{name: _floating_keys(*rule) for name, rule in FLOATING_HOLIDAYS.items()},
    **{name: _observed_keys(*rule) for name, rule in FIXED_HOLIDAYS.items()},
}
_HOLIDAYS = set().union(*HOLIDAY_KEYS.values())
_BRIDGES = {
    key
    for holiday in _HOLIDAYS
    for key in (
        _moved(holiday, -3),
        _moved(holiday, -1),
        _moved(holiday, 1),
        _moved(holiday, 3),
    )
    # Friday before a Monday or after a Thursday; Monday after a Friday or before a Tuesday.
    if (key[0], holiday[0]) in {(FRIDAY, MONDAY), (FRIDAY, THURSDAY), (MONDAY, FRIDAY), (MONDAY, TUESDAY)}
}
FLAG_KEYS: dict[str, set[DayKey]] = {
    "is_holiday": _HOLIDAYS,
    "is_day_before_holiday": {_moved(key, -1) for key in _HOLIDAYS},
    "is_day_after_holiday": {_moved(key, 1) for key in _HOLIDAYS},
    "is_bridge_day": _BRIDGES,
}


def _in_keys(day: str, keys: set[DayKey]) -> Column:
    numbers = ", ".join(str(w * 10000 + m * 100 + d) for w, m, d in sorted(keys))
    return F.expr(f"weekday({day}) * 10000 + month({day}) * 100 + dayofmonth({day}) in ({numbers})")


def is_federal_holiday(day: str) -> Column:
    """True on the observed date of one of the eleven federal holidays."""
    return _in_keys(day, _HOLIDAYS)


def federal_holiday_name(day: str) -> Column:
    """Name of the holiday observed on ``day``, NULL on other days."""
    return F.coalesce(*[F.when(_in_keys(day, keys), F.lit(name)) for name, keys in HOLIDAY_KEYS.items()])


def holiday_flags(day: str) -> dict[str, Column]:
    """The four 0/1 holiday indicators of a day."""
    return {name: _in_keys(day, keys).cast("int") for name, keys in FLAG_KEYS.items()}


def calendar_parts(day: Column) -> dict[str, Column]:
    """Weekday (Monday is 0), weekend flag, month and day of year of the target day."""
    weekday = F.weekday(day)
    return {
        "target_dayofweek": weekday,
        "target_is_weekend": (weekday >= SATURDAY).cast("int"),
        "target_month": F.month(day),
        "target_dayofyear": F.dayofyear(day),
    }


def cyclical_parts(day: Column) -> dict[str, Column]:
    """Position in the week and in the year as points on a circle."""
    week = 2 * math.pi * F.weekday(day) / 7.0
    year = 2 * math.pi * F.dayofyear(day) / 365.25
    return {
        "sin_dayofweek": F.sin(week),
        "cos_dayofweek": F.cos(week),
        "sin_dayofyear": F.sin(year),
        "cos_dayofyear": F.cos(year),
    }
