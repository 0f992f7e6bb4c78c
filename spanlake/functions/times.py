"""Time expressions. All of them are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalize_ts(value: Column) -> Column:
    """Seconds from seconds or nanoseconds: null and 0 give null, above 1e12 is read as nanoseconds."""
    value = value.cast("double")
    return F.when(value > 1e12, value / 1e9).when(value != 0, value)


def to_epoch(value: Column, is_timestamp: bool = True) -> Column:
    """Epoch seconds as double from a timestamp column, or from a number when ``is_timestamp`` is off.

    A timestamp without zone is read in the session zone, which is UTC.
    """
    return F.unix_micros(value.cast("timestamp")) / 1e6 if is_timestamp else value.cast("double")


def duration(start: Column, end: Column) -> Column:
    """``end - start``; null while the end is missing."""
    return end - start


def shard_label(seconds: Column, minutes: int) -> Column:
    """``yyyyMMdd_HHmm00`` start of the window that holds ``seconds``; windows restart at UTC midnight.

    ``F.window`` is anchored at the epoch, so widths that do not divide a day need this form.
    """
    width = minutes * 60
    second = F.floor(seconds)
    day = F.floor(second / 86400)
    minute = (F.floor((second - day * 86400) / width) * width / 60).cast("int")
    return F.concat(
        F.date_format(F.date_from_unix_date(day.cast("int")), "yyyyMMdd"),
        F.lit("_"),
        F.lpad(F.floor(minute / 60).cast("string"), 2, "0"),
        F.lpad((minute % 60).cast("string"), 2, "0"),
        F.lit("00"),
    )


def iso_duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two ISO texts; an unreadable side gives null and zone suffixes are ignored."""
    micros = F.timestamp_diff("MICROSECOND", start.try_cast("timestamp_ntz"), end.try_cast("timestamp_ntz"))
    return micros / 1000.0
