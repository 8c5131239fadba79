"""Season keys and the three calendars (365-slot, 366-slot, month-day text)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def slot_366(d: Column) -> Column:
    """Leap-calendar day 1..366; 29 February keeps slot 60 in every year."""
    doy = F.dayofyear(d)
    return doy + F.when(~is_leap(F.year(d)) & (doy >= 60), 1).otherwise(0)


def slot_365(d: Column) -> Column:
    """Non-leap-calendar day 1..365; 29 February shares slot 59 with 28 February."""
    doy = F.dayofyear(d)
    return doy - F.when(is_leap(F.year(d)) & (doy >= 60), 1).otherwise(0)


def month_day(d: Column) -> Column:
    return F.date_format(d, "MM-dd")


def circular_distance(a: Column, b: Column, period: int = 366) -> Column:
    gap = F.abs(a - b)
    return F.least(gap, F.lit(period) - gap)


def season_year(d: Column, last_month: int = 2) -> Column:
    """Start year of the season; months up to ``last_month`` belong to the year before."""
    return F.year(d) - F.when(F.month(d) <= last_month, 1).otherwise(0)


def season_label(start_year: Column) -> Column:
    return F.format_string("%d/%02d", start_year.cast("int"), ((start_year + 1) % 100).cast("int"))


def season_start(start_year: Column, month: int = 12) -> Column:
    return F.make_date(start_year, F.lit(month), F.lit(1))


def season_end(start_year: Column, month: int = 2) -> Column:
    return F.last_day(F.make_date(start_year + 1, F.lit(month), F.lit(1)))


def season_day_index(d: Column, start_month: int = 12, last_month: int = 2) -> Column:
    return F.datediff(d, season_start(season_year(d, last_month), start_month)) + 1


def season_length(start_year: Column, start_month: int = 12, last_month: int = 2) -> Column:
    return F.datediff(season_end(start_year, last_month), season_start(start_year, start_month)) + 1


def shift_to_season(d: Column, start_year: Column, first_month: int = 7) -> Column:
    """Same month and day in another season; the day is clamped to the month's length."""
    year = start_year + F.when(F.month(d) >= first_month, 0).otherwise(1)
    month_end = F.last_day(F.make_date(year, F.month(d), F.lit(1)))
    return F.make_date(year, F.month(d), F.least(F.dayofmonth(d), F.dayofmonth(month_end)))
