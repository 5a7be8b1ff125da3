"""Dates and stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkquarry.functions import js
from sparkquarry.functions import values as v
from sparkquarry.functions.names import first_of


def stamp(at: Column) -> Column:
    """yyyy-mm-dd h:mm AM or PM."""
    return F.concat(F.date_format(at, "yyyy-MM-dd h:mm "), F.when(F.hour(at) >= 12, "PM").otherwise("AM"))


def batch_id(at: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.date_format(at, "yyyyMMdd-HHmmss"))


def months_before(day: Column, months: int) -> Column:
    """The same day of an earlier month; a day that it lacks runs over into the next one, as May 31 less 3 is March 3."""
    first = F.add_months(F.trunc(day, "month"), -months)
    return F.date_add(first, F.dayofmonth(day) - 1)


def hint(text: Column) -> Column:
    """The first written date, else the first recent year."""
    value = js.clean(text)
    return first_of(js.first(value, v.DATE_HINT), js.first(value, v.SIGNAL_NEW_YEAR))


def is_fresh(running: Column, published_ms: Column, now_ms: int, minutes: int = 75) -> Column:
    """Is a run that says it goes on still believed? A state without time isn't."""
    return F.coalesce(running & (F.lit(now_ms) - published_ms < minutes * 60_000), F.lit(False))


def shown_in(at: Column, zone: str) -> Column:
    """A UTC time (timestamp without zone) as it is shown in another zone: Mar 3, 2025, 4:05 p.m."""
    there = F.convert_timezone(F.lit("UTC"), F.lit(zone), at)
    return F.concat(F.date_format(there, "MMM d, yyyy, h:mm "), F.when(F.hour(there) >= 12, "p.m.").otherwise("a.m."))
