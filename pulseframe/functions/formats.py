"""Values as text: column functions over canonical units. Absent values are written as a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import lookup

ABSENT = "—"
#: How canonical units are written; '' for none. Others are written as they are.
SHOWN = {
    "kJ": "kcal",
    "count": "",
    "appleEffortScore": "",
    "count/min": "/min",
    "km/hr": "km/h",
    "degC": "°C",
    "dBASPL": "dB",
    "mcg": "µg",
    "hr": "h",
    "mL/min·kg": "mL/min/kg",
    "kcal/hr·kg": "kcal/h/kg",
}
KJ_PER_KCAL = 4.184


def _or_absent(v: Column, text: Column) -> Column:
    return F.when(v.isNull() | F.isnan(v.cast("double")), ABSENT).otherwise(text)


def _padded(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _whole(v: Column) -> Column:
    """Rounded with halves up."""
    return F.floor(v + 0.5).cast("long")


def number(v: Column, digits: int = 1) -> Column:
    """With thousands apart and a fixed number of decimals."""
    return _or_absent(v, F.format_number(v.cast("double"), digits))


def integer(v: Column) -> Column:
    return number(v, 0)


def percent(v: Column, digits: int = 1) -> Column:
    return _or_absent(v, F.concat(F.format_number(v.cast("double"), digits), F.lit(" %")))


def compact(v: Column) -> Column:
    """Three significant digits with K, M, B or T for thousands and their powers."""
    power = F.least(F.greatest(F.floor(F.log10(F.greatest(F.abs(v), F.lit(1.0))) / 3), F.lit(0)), F.lit(4)).cast("int")
    scaled = v / F.pow(F.lit(1000.0), power)
    places = F.greatest(2 - F.floor(F.log10(F.greatest(F.abs(scaled), F.lit(1.0)))), F.lit(0)).cast("int")
    text = F.when(places == 2, F.format_number(scaled, 2)).when(places == 1, F.format_number(scaled, 1)).otherwise(F.format_number(scaled, 0))
    text = F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    return _or_absent(v, F.concat(text, F.element_at(F.array(*map(F.lit, ("", "K", "M", "B", "T"))), power + 1)))


def size(v: Column) -> Column:
    """Bytes in binary steps up to gigabytes; no decimals from 100 on."""
    step = F.when(v < 1 << 20, 1).when(v < 1 << 30, 2).otherwise(3)
    scaled = v / F.pow(F.lit(1024.0), step)
    text = F.concat(F.when(scaled >= 100, F.format_number(scaled, 0)).otherwise(F.format_number(scaled, 1)), F.lit(" "), F.element_at(F.array(*map(F.lit, ("KB", "MB", "GB"))), step))
    return _or_absent(v, F.when(v < 1024, F.concat(F.format_number(v.cast("double"), 0), F.lit(" B"))).otherwise(text))


def duration(v: Column) -> Column:
    """Seconds as m:ss, or h:mm:ss from an hour on."""
    s = _whole(v)
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return _or_absent(v, F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _padded(m), F.lit(":"), _padded(sec))).otherwise(F.concat(m.cast("string"), F.lit(":"), _padded(sec))))


def hours_minutes(v: Column) -> Column:
    """Seconds as '7 h 24', or '24 min' under an hour."""
    total = _whole(v / 60)
    h, m = F.floor(total / 60), total % 60
    return _or_absent(v, F.when(h == 0, F.concat(m.cast("string"), F.lit(" min"))).otherwise(F.concat(h.cast("string"), F.lit(" h "), _padded(m))))


def kilometres(v: Column, digits: int = 1) -> Column:
    return _or_absent(v, F.concat(F.format_number(v / 1000, digits), F.lit(" km")))


def pace(v: Column) -> Column:
    """Seconds per kilometre as '4:52 /km'; absent at zero and below."""
    s = _whole(v)
    text = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), _padded(s % 60), F.lit(" /km"))
    return F.when(v > 0, _or_absent(v, text)).otherwise(ABSENT)


def clock_since_noon(v: Column) -> Column:
    """Minutes since noon as HH:MM."""
    t = F.pmod(_whole(v) + 720, F.lit(1440))
    return _or_absent(v, F.concat(_padded(F.floor(t / 60)), F.lit(":"), _padded(t % 60)))


def shown_unit(unit: Column) -> Column:
    """The unit as it is written; null for none."""
    return F.nullif(F.coalesce(lookup(SHOWN, unit), unit), F.lit(""))


def shown_value(v: Column, unit: Column) -> Column:
    return F.when(unit == "kJ", v / KJ_PER_KCAL).otherwise(v)


def by_magnitude(v: Column, magnitude: Column) -> Column:
    """Decimals by the largest value that is to be shown: none from 100 on, one from 10, else two."""
    return _or_absent(v, F.when(magnitude >= 100, F.format_number(v, 0)).when(magnitude >= 10, F.format_number(v, 1)).otherwise(F.format_number(v, 2)))


def metric_value(v: Column, aggregation: Column, unit: Column, magnitude: Column) -> Column:
    """A metric's canonical value as text; null stays null. Durations are hours and minutes, counts of
    occurrences integers; others are converted, written by the magnitude, and followed by their unit."""
    own = by_magnitude(shown_value(v, unit), F.abs(shown_value(magnitude, unit)))
    with_unit = F.concat_ws(" ", own, shown_unit(unit))
    text = F.when(aggregation == "duration", hours_minutes(v)).when(aggregation == "none", integer(v)).otherwise(with_unit)
    return F.when(v.isNotNull(), text)


def relative(at: Column, now: Column) -> Column:
    """How long ago in the largest fitting unit up to days; the date beyond a week."""
    s = F.unix_seconds(now) - F.unix_seconds(at)
    ago = lambda n, u: F.concat(F.floor(n + 0.5).cast("string"), F.lit(f" {u} ago"))
    text = F.when(s < 60, ago(s, "sec.")).when(s < 3600, ago(s / 60, "min.")).when(s < 86_400, ago(s / 3600, "hr.")).when(s < 604_800, ago(s / 86_400, "days"))
    return F.when(at.isNull(), ABSENT).otherwise(F.coalesce(text, F.date_format(at, "d MMM, HH:mm")))
