"""Dates: periods, windows, durations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _wall_clock(c: Column | str) -> Column:
    return _col(c).cast("timestamp_ntz")


def _moment(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def period(c: Column | str, unit: str = "year") -> Column:
    """Year as an integer, or the first day of the month or other unit."""
    return F.year(_col(c)) if unit == "year" else F.date_trunc(unit, _col(c)).cast("date")


def in_days(c: Column | str, start: str, end: str) -> Column:
    """From the start day to the end of the end day, both `YYYY-MM-DD`."""
    first, last = (datetime.strptime(d, "%Y-%m-%d") for d in (start, end))
    if first > last:
        raise ValueError("start is after end")
    return (_wall_clock(c) >= _moment(first)) & (_wall_clock(c) < _moment(last + timedelta(days=1)))


def in_last_days(c: Column | str, days: int, now: datetime) -> Column:
    return (_wall_clock(c) >= _moment(now - timedelta(days=days))) & (_wall_clock(c) <= _moment(now))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    first, last = (F.unix_micros(_col(c).cast("timestamp")) for c in (start, end))
    return (last - first) / 1e6
