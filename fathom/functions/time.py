"""Date/time scalar functions.

All functions return ``Column`` expressions that stay inside whole-stage codegen.
Timestamps are zone-less (``TIMESTAMP_NTZ``): the reference shifts clocks by a
fixed offset instead of using named zones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions._util import as_col

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

_UNIT_MICROS = {
    "microsecond": 1, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def parse_step(step: str) -> int:
    """'10 minutes' / '1 hour' / '2 min' -> microseconds."""
    n, unit = step.strip().split()
    unit = unit.lower().rstrip("s")
    unit = {"min": "minute", "sec": "second", "hr": "hour"}.get(unit, unit)
    return int(float(n) * _UNIT_MICROS[unit])


def _micros_since_epoch(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts)


def floor_time(ts, step: str) -> Column:
    """Floor a timestamp to a multiple of ``step`` since the epoch (stays NTZ)."""
    ts = as_col(ts)
    us = parse_step(step)
    off = F.pmod(_micros_since_epoch(ts), F.lit(us))
    return F.timestamp_add("MICROSECOND", -off, ts)


def round_time(ts, step: str) -> Column:
    """Round to the nearest multiple of ``step``; halves go up."""
    ts = as_col(ts)
    us = parse_step(step)
    return floor_time(F.timestamp_add("MICROSECOND", F.lit(us // 2), ts), step)


def shift_hours(ts, hours: float) -> Column:
    """Fixed clock shift (no DST), e.g. UTC -> local with ``-8``."""
    return F.timestamp_add("MICROSECOND", F.lit(int(hours * 3_600_000_000)), as_col(ts))


def shift_minutes(ts, minutes: float) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(int(minutes * 60_000_000)), as_col(ts))


def parse_ts(s, pattern: str) -> Column:
    """Parse a string with an explicit pattern; unparseable -> NULL (never raises).

    Year-first patterns also take ``T`` between date and time and ``/`` in the date. The clock
    reading is kept as written whatever the session's zone: it is parsed as UTC and counted
    from the epoch."""
    s = as_col(s)
    if pattern.startswith("yyyy-"):
        s = F.translate(s, "T/", " -")
    instant = F.try_to_timestamp(F.concat(s, F.lit(" Z")), F.lit(f"{pattern} X"))
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))


# Pattern names used by the reference's parsers (lubridate ymd_hms / ymd_hm / mdy_hm).
PATTERNS = {
    "ymd_hms": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "ymd_hm": "yyyyMMdd HHmm",
    "ymd_hm_dash": "yyyy-MM-dd HH:mm",
    "mdy_hm": "M/d/yyyy H:mm",
}


def parse_datetime(date_int, time_str, pattern: str = "yyyyMMdd HH:mm:ss[.SSSSSS]") -> Column:
    """Yyyymmdd integer + time-of-day string -> TIMESTAMP_NTZ."""
    s = F.concat_ws(" ", as_col(date_int).cast("string"), F.trim(as_col(time_str)))
    return parse_ts(s, pattern)


def zone_instant(ts, zone: str) -> Column:
    """The UTC instant (zone-less) of a clock reading that is declared to be local time of
    ``zone``. Declaring a zone leaves the reading itself as it is."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), as_col(ts))


def frac_hour(ts) -> Column:
    """Hour + minute/60."""
    ts = as_col(ts)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def year_month(ts) -> Column:
    """D10: 'yyyy-MM'."""
    return F.date_format(as_col(ts), "yyyy-MM")


def duration(a, b, unit: str = "minutes") -> Column:
    """B - a in seconds or minutes (double)."""
    secs = F.timestamp_diff("MICROSECOND", as_col(a), as_col(b)) / F.lit(1e6)
    return secs / F.lit(60.0) if unit.startswith("min") else secs


def month_start(ts) -> Column:
    """First day of the month as DATE."""
    return F.trunc(F.to_date(as_col(ts)), "month")
