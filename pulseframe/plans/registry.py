"""Registry of named queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.canonical import CANON, Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of canonical Tables as a query of (spark, sf_dir)."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(f(Tables(spark, sf_dir)))
        if sql is not None:
            own = sql.strip()
            ORACLES[name] = f"WITH {CANON}{'' if own.upper().startswith('SELECT') else ','}\n{own}"
        return f

    return register


def plain(df: DataFrame) -> DataFrame:
    """Days and instants as text and decimals as doubles, so that results compare across engines."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind in ("int", "smallint"):
            c = c.cast("long")
        cols.append(c.alias(name))
    return df.select(*cols)
