"""Column functions over instants (UTC) and subjects' local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(ts: Column, tz: Column | str) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_day(ts: Column, tz: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def local_midnight(day: Column, tz: Column | str) -> Column:
    """The instant at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def night_date(ts: Column, tz: Column | str) -> Column:
    """The day on which a night that includes the instant ends: local time plus twelve hours."""
    return F.to_date(F.from_utc_timestamp(ts, tz) + F.expr("INTERVAL 12 HOURS"))


def seconds(start: Column, end: Column) -> Column:
    """Seconds between two instants with their fraction; null where either is null."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def bin_start(ts: Column, origin: Column, width_s: int) -> Column:
    """Start of the origin-anchored bucket of ``width_s`` seconds that holds ts."""
    n = F.floor((F.unix_micros(ts) - F.unix_micros(origin)) / F.lit(width_s * 1_000_000))
    return F.timestamp_micros(F.unix_micros(origin) + n * F.lit(width_s * 1_000_000))


def quantise(value: Column, scale: float | Column) -> Column:
    """Halves go up, also below zero: -2.5 becomes -2."""
    return F.floor(value * (scale if isinstance(scale, Column) else F.lit(scale)) + F.lit(0.5))


def percent_delta(now: Column, before: Column) -> Column:
    """Change in per cent of the earlier magnitude; null without both or where the earlier is zero."""
    return (now - before) / F.nullif(F.abs(before), F.lit(0.0)) * 100


def since_noon(ts: Column, tz: Column | str) -> Column:
    """Minutes since local noon, 0 to 1439, so that bedtimes around midnight average well."""
    t = F.from_utc_timestamp(ts, tz)
    return F.pmod(F.hour(t) * 60 + F.minute(t) - 720, F.lit(1440))


def push_date(s: Column) -> tuple[Column, Column]:
    """(instant, offset minutes) of 'YYYY-MM-DD HH:MM:SS ±HHMM'; null where it is not such a date."""
    at = F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss Z"))
    sign = F.when(F.regexp_extract(s, r" ([+-])\d{4}$", 1) == "-", -1).otherwise(1)
    mins = F.regexp_extract(s, r"(\d{2})\d{2}$", 1).try_cast("int") * 60 + F.regexp_extract(s, r"(\d{2})$", 1).try_cast("int")
    return at, F.when(at.isNotNull(), sign * mins).cast("smallint")


def iso_date(s: Column) -> tuple[Column, Column]:
    """(instant, offset minutes) of an ISO date with Z or ±HH:MM, up to six decimals, offset within 15 h."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})$"
    sign = F.when(F.regexp_extract(s, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    mins = F.coalesce(F.regexp_extract(s, r"[+-](\d{2}):\d{2}$", 1).try_cast("int") * 60 + F.regexp_extract(s, r"[+-]\d{2}:(\d{2})$", 1).try_cast("int"), F.lit(0)) * sign
    ok = s.rlike(shape) & (F.abs(mins) <= 900)
    return F.when(ok, s.try_cast("timestamp")), F.when(ok, mins).cast("smallint")


def trend_quality(delta: Column, lower_is_better: bool | None) -> Column:
    """flat under half a per cent; good or bad by direction; off for metrics without a direction."""
    if lower_is_better is None:
        return F.lit("off")
    up = delta < 0 if lower_is_better else delta > 0
    return F.when(delta.isNull(), "off").when(F.abs(delta) < 0.5, "flat").when(up, "good").otherwise("bad")


def freshness(last: Column, now: Column, failed: Column, pending: Column) -> Column:
    return F.when(failed > 0, "error").when(pending > 0, "syncing").when(last.isNull(), "never").when(seconds(last, now) < 26 * 3600, "fresh").otherwise("stale")


def iso_week(day: Column) -> Column:
    """The ISO week of a day as 2024-W05; its year is that of the week's Thursday."""
    thursday = F.date_add(F.trunc(day, "week"), 3)
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
