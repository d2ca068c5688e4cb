"""Timestamps and band names carried by file names and band descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two naming styles of the input files.
STAMP_PATTERN = r"M(\d{2})_D(\d{2})_(\d{4})_H(\d{2})"
BAND_PATTERN = r"M(\d{2})_D(\d{2})_(\d{4})_H(\d{2})_(\w+)"
DATE_PATTERN = r"(\d{8})(?:_(\d{2}))?"


def basename(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(path, "/"), -1)


def _to_time(year: Column, month: Column, day: Column, hour: Column) -> Column:
    # NTZ throughout: a session time zone must not shift or reject wall-clock hours.
    parts = [c.try_cast("int") for c in (year, month, day, hour)]
    return F.try_make_timestamp_ntz(*parts, F.lit(0), F.lit(0))


def file_time(path: Column | str) -> Column:
    """Time stamp in a file name, NULL when there is none (hour defaults to 00)."""
    name = basename(path)
    part = lambda p, i: F.regexp_extract(name, p, i)
    long_style = _to_time(*[part(STAMP_PATTERN, i) for i in (3, 1, 2, 4)])
    day, hour = part(DATE_PATTERN, 1), part(DATE_PATTERN, 2)
    short_style = _to_time(
        F.substring(day, 1, 4),
        F.substring(day, 5, 2),
        F.substring(day, 7, 2),
        F.when(hour == "", "00").otherwise(hour),
    )
    return F.when(name.rlike(STAMP_PATTERN), long_style).when(name.rlike(DATE_PATTERN), short_style)


def month_start(path: Column | str) -> Column:
    """First hour of the month named by the last two ``_`` parts of a file name, else NULL."""
    parts = F.split(F.regexp_replace(basename(path), r"\.tif$", ""), "_")
    year = F.try_element_at(parts, F.lit(-2))
    month = F.try_element_at(parts, F.lit(-1))
    ok = year.rlike(r"^\d{4}$") & month.rlike(r"^\d{1,2}$")
    return F.when(ok, _to_time(year, month, F.lit("1"), F.lit("0")))


def has_band_name(desc: Column | str) -> Column:
    desc = F.col(desc) if isinstance(desc, str) else desc
    return F.coalesce(desc.rlike(BAND_PATTERN), F.lit(False))


def band_name(desc: Column | str) -> Column:
    desc = F.col(desc) if isinstance(desc, str) else desc
    return F.when(has_band_name(desc), F.regexp_extract(desc, BAND_PATTERN, 5))


def band_time(desc: Column | str) -> Column:
    desc = F.col(desc) if isinstance(desc, str) else desc
    got = [F.regexp_extract(desc, BAND_PATTERN, i) for i in (3, 1, 2, 4)]
    return F.when(has_band_name(desc), _to_time(*got))
