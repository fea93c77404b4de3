"""Columns for dates, verification windows and slices; all pure expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def season(date: Column | str) -> Column:
    """DJF, MAM, JJA or SON of a date (null stays null)."""
    m = F.month(col(date))
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isNotNull(), "SON")


def block_id(date: Column | str, days: int = 14) -> Column:
    """Number of the ``days``-day block since 1970, floored for earlier dates too."""
    return F.floor(F.unix_date(col(date)) / days)


def lead_day(target: Column | str, run: Column | str) -> Column:
    return F.datediff(col(target), col(run))


def at_hour(date: Column | str, hours: int) -> Column:
    """``hours`` after the start of a date, as a time without zone."""
    return F.to_timestamp_ntz(col(date).cast("string")) + F.expr(f"interval {hours} hours")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time without zone (the session is in UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def target_of(valid: Column | str) -> tuple[Column, Column]:
    """(target date, variable): hour 0 closes the maximum of the day before, hour 12 the minimum of the day; other hours are an error."""
    t = col(valid)
    hour = F.hour(t)
    bad = F.raise_error(F.concat(F.lit("not a verification hour: "), t.cast("string")))
    variable = F.when(hour == 0, "max").when(hour == 12, "min").otherwise(bad)
    return F.when(hour == 0, F.date_sub(t.cast("date"), 1)).otherwise(t.cast("date")), variable


def window(target: Column | str, variable: Column | str) -> tuple[Column, Column]:
    """[start, end) of the 18 hours that verify a target: from 12 for a maximum, from 0 for a minimum."""
    t = col(target)
    start = F.when(col(variable) == "max", at_hour(t, 12)).otherwise(at_hour(t, 0))
    return start, start + F.expr("interval 18 hours")


def synoptic_ends(start: Column | str) -> Column:
    """The ends of the three 6-hour periods that tile a window."""
    s = col(start)
    return F.array(*[s + F.expr(f"interval {h} hours") for h in (6, 12, 18)])


def days_between(lo: str, hi: str) -> Column:
    """All dates from ``lo`` to ``hi`` (ISO literals), both included."""
    return F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"))


def month_spans(lo: Column | str, hi: Column | str) -> Column:
    """Calendar months that touch [lo, hi], as structs clipped to it."""
    first = F.sequence(F.trunc(col(lo), "month"), F.trunc(col(hi), "month"), F.expr("interval 1 month"))
    return F.transform(first, lambda m: F.struct(F.greatest(m, col(lo)).alias("first"), F.least(F.last_day(m), col(hi)).alias("last")))


def day_of_year_wave(date: Column | str) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year."""
    angle = F.dayofyear(col(date)) * (2 * 3.141592653589793 / 365.25)
    return F.sin(angle), F.cos(angle)


def age_days(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / float(DAY_US)


def fahrenheit(celsius: Column | str) -> Column:
    return col(celsius) * 9.0 / 5.0 + 32.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km on a sphere of 6371 km; degrees in."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    dlat, dlon = b - a, F.radians(col(lon2)) - F.radians(col(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, in radians."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    d = F.radians(col(lon2)) - F.radians(col(lon1))
    return F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


def is_finite(x: Column | str) -> Column:
    """True only for a number: null, NaN and infinities are false."""
    c = col(x)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
