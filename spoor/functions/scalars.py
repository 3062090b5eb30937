"""Scalar expressions over messages, times and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_name(frame: Column) -> Column:
    """A frame id without any leading slashes; missing is empty."""
    return F.coalesce(F.ltrim(frame, F.lit("/")), F.lit(""))


def stamp_seconds(sec: Column, nanosec: Column, log_ns: Column) -> Column:
    """The header's stamp if there is one, else the log time."""
    return F.coalesce(sec + nanosec / F.lit(1e9), log_ns / F.lit(1e9))


def naive_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone, whatever the session's zone is."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def is_finite(value: Column) -> Column:
    """Reads as a number that is neither NaN nor infinite; false for null."""
    number = value.try_cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False))


def shortened(text: Column, n: int) -> Column:
    """Unchanged up to ``n`` characters, else ``n`` of which the last three are dots (below 3 a negative cut)."""
    if n <= 0:
        raise ValueError("the preview length must be positive")
    head = F.left(text, F.lit(n - 3)) if n >= 3 else F.left(text, F.greatest(F.length(text) + F.lit(n - 3), F.lit(0)))
    return F.when(F.length(text) <= n, text).otherwise(F.concat(head, F.lit("...")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def file_time(path: Column) -> Column:
    """The number that a file's name is before its extension; null if it is none."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).try_cast("double")
