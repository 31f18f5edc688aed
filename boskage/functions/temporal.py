"""Dates and periods as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def midpoint(start: Column, end: Column) -> Column:
    """The middle of a period, to the microsecond."""
    us = micros(start) + F.floor((micros(end) - micros(start)) / 2).cast("long")
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_days(a: Column, b: Column) -> Column:
    """Absolute value of the floored difference a - b in days: the sign of a - b matters."""
    d = (micros(a) - micros(b)).cast("long")
    return F.abs(F.floor(d / F.lit(DAY_US))).cast("long")


def parse_or_null(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def parse_or_year(text: Column, year: Column, end: bool = False) -> Column:
    """A date text, or where it can't be read the first (or last) day of the year."""
    day = F.make_date(year.cast("int"), F.lit(12 if end else 1), F.lit(31 if end else 1))
    return F.coalesce(text.try_cast("date"), day)


def year_start(year: Column) -> Column:
    return F.make_date(year.cast("int"), F.lit(1), F.lit(1))


def year_end(year: Column) -> Column:
    return F.make_date(year.cast("int"), F.lit(12), F.lit(31))


def season(first_year: Column, second_year: Column) -> tuple[Column, Column]:
    """From September of the first year to May of the second."""
    return F.make_date(first_year, F.lit(9), F.lit(1)), F.make_date(second_year, F.lit(5), F.lit(1))


def shift_days(ts: Column, days: float) -> Column:
    return F.timestamp_micros(micros(ts) + F.lit(int(days * DAY_US))).cast("timestamp_ntz")


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (start <= high) & (end >= low)


def within_years(start: Column, end: Column, year: Column, buffer: int) -> Column:
    return (F.year(start) >= year - buffer) & (F.year(end) <= year + buffer)


def year_distance(start: Column, end: Column, year: Column) -> Column:
    return F.least(F.abs(year - F.year(start)), F.abs(F.year(end) - year))


def mean_gap_days(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Mean of the absolute differences of starts and of ends, in days."""
    return (F.abs(F.datediff(start_a, start_b)) + F.abs(F.datediff(end_a, end_b))) / 2.0


def add_noise(ts: Column, sigma_days: float, seed: int, key: Column) -> Column:
    """The day of a date moved by a normal number of days of a key and a seed, whatever the partitioning; the same key moves both ends alike."""
    from boskage.operators.experiments import normal

    return F.date_add(F.to_date(ts), F.floor(normal(key, seed) * sigma_days).cast("int"))
