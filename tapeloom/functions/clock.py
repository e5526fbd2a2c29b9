"""Session clocks, buckets and time conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The exchange day (local offset +05:30, open 09:15, close 15:30 and from
# 2026-08-03 15:40) as seconds.
OFFSET_S = 19_800
OPEN_S = 33_300
LEGACY_CLOSE_S = 55_800
CURRENT_CLOSE_S = 56_400
CLOSE_CHANGE = "2026-08-03"
_DAY_S = 86_400


def local_seconds(ts_us: Column) -> Column:
    """Local second of day (with fraction) of a UTC microsecond instant."""
    return F.pmod(ts_us + F.lit(OFFSET_S * 1_000_000), F.lit(_DAY_S * 1_000_000)) / 1e6


def local_date(ts_us: Column) -> Column:
    days = F.floor((ts_us + F.lit(OFFSET_S * 1_000_000)) / F.lit(_DAY_S * 1_000_000)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def close_seconds(date: Column) -> Column:
    """Close of the regular session in force on a date."""
    return F.when(date < F.lit(CLOSE_CHANGE).cast("date"), F.lit(LEGACY_CLOSE_S)).otherwise(
        F.lit(CURRENT_CLOSE_S)
    )


def session_length(date: Column) -> Column:
    return close_seconds(date) - F.lit(OPEN_S)


def in_session(ts_us: Column) -> Column:
    """Inside the dated regular session, both ends included."""
    s = local_seconds(ts_us)
    return (s >= OPEN_S) & (s <= close_seconds(local_date(ts_us)))


def half_hour_label(ts_us: Column) -> Column:
    """``HH:MM-HH:MM`` label of the local half hour."""
    start = F.floor(local_seconds(ts_us) / 1800).cast("long") * 30

    def hhmm(minutes: Column) -> Column:
        m = F.pmod(minutes, F.lit(1440))
        return F.concat(
            F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0")
        )

    return F.concat(hhmm(start), F.lit("-"), hhmm(start + 30))


def clock_bucket(ts_us: Column) -> Column:
    """Named part of the day on half-open edges, the last one closed; null outside."""
    s = local_seconds(ts_us)
    h = 3600
    return (
        F.when((s >= OPEN_S) & (s < 10 * h), "open")
        .when((s >= 10 * h) & (s < 12 * h), "morning")
        .when((s >= 12 * h) & (s < 14 * h), "midday")
        .when((s >= 14 * h) & (s < 15 * h), "late")
        .when((s >= 15 * h) & (s <= LEGACY_CLOSE_S), "close")
    )


def session_phase(ts_us: Column) -> dict[str, Column]:
    """Sine and cosine of the session phase, minutes from open and to close."""
    s = local_seconds(ts_us)
    length = session_length(local_date(ts_us))
    angle = 2.0 * 3.141592653589793 * (s - OPEN_S) / length
    return {
        "phase_sin": F.sin(angle),
        "phase_cos": F.cos(angle),
        "minutes_from_open": (s - OPEN_S) / 60.0,
        "minutes_to_close": (close_seconds(local_date(ts_us)) - s) / 60.0,
    }


def calendar_days(anchor_us: Column, expiry_us: Column) -> Column:
    """Local calendar days to expiry; null once expired."""
    return F.when(expiry_us >= anchor_us, F.datediff(local_date(expiry_us), local_date(anchor_us)))


def iso_to_ns(text: Column) -> Column:
    """UTC ISO-8601 text with up to nine fraction digits to integer nanoseconds."""
    whole = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d)", 1)
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0")
    sign = F.regexp_extract(text, r"([+-])\d\d:\d\d$", 1)
    hours = F.regexp_extract(text, r"[+-](\d\d):\d\d$", 1)
    minutes = F.regexp_extract(text, r"[+-]\d\d:(\d\d)$", 1)
    offset = F.when(
        sign != "",
        (hours.try_cast("long") * 3600 + minutes.try_cast("long") * 60)
        * F.when(sign == "-", -1).otherwise(1),
    ).otherwise(0)
    seconds = F.unix_timestamp(F.regexp_replace(whole, "T", " "), "yyyy-MM-dd HH:mm:ss")
    return (seconds - offset) * F.lit(1_000_000_000) + fraction.try_cast("long")
