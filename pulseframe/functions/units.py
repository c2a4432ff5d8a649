"""Unit conversion, names and classes of metrics."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor of each unit to its dimension's base.
UNITS = {
    "energy": {"kJ": 1.0, "kcal": 4.184, "Cal": 4.184, "cal": 0.004184, "J": 0.001},
    "ratio": {"fraction": 1.0, "%": 0.01},
    "distance": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "ft": 0.3048, "in": 0.0254},
    "speed": {"m/s": 1.0, "km/hr": 1 / 3.6, "mph": 0.44704},
    "duration": {"s": 1.0, "min": 60.0, "hr": 3600.0, "ms": 0.001, "d": 86400.0},
    "volume": {"L": 1.0, "mL": 0.001, "dL": 0.1, "fl_oz_us": 0.0295735},
    "mass": {"kg": 1.0, "g": 0.001, "mg": 0.000001, "lb": 0.45359237},
}
#: Spellings of units.
ALIASES = {"bpm": "count/min", "steps": "count", "sec": "s", "second": "s", "minute": "min", "hour": "hr", "h": "hr"}


def lookup(table: dict, key: Column) -> Column:
    """The value of a key in a small fixed table, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def convert(value: Column, unit: Column, to: Column) -> Column:
    """value in another unit of its dimension; null for unknown units or across dimensions.
    Temperatures go between degC and degF."""
    a, b = (F.coalesce(lookup(ALIASES, u), u) for u in (unit, to))
    factor = {f"{d}:{u}": f for d, us in UNITS.items() for u, f in us.items()}
    dim = {u: d for d, us in UNITS.items() for u in us}
    da, db = lookup(dim, a), lookup(dim, b)
    linear = F.when(da == db, value * lookup(factor, F.concat(da, F.lit(":"), a)) / lookup(factor, F.concat(db, F.lit(":"), b)))
    return (
        F.when(a == b, value).when((a == "degF") & (b == "degC"), (value - 32) / 1.8).when((a == "degC") & (b == "degF"), value * 1.8 + 32)
        .otherwise(linear)
    )


def source_name(name: Column) -> Column:
    """No-break spaces and control blanks become spaces; ends are trimmed; composites stay as they are."""
    return F.trim(F.translate(name, " \t\r\n", "    "))


def elevation_m(text: Column) -> Column:
    """Metres of '1710 cm' or '17.1 m'; null for other text."""
    n = F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)\s*(cm|m)\s*$", 1).try_cast("double")
    return F.when(F.regexp_extract(text, r"(cm|m)\s*$", 1) == "cm", n / 100).otherwise(n)
