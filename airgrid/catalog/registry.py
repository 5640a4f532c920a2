"""Registration of queries together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.catalog import sql as sql_text
from airgrid.catalog.inputs import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _parse(columns: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in columns.split()]


def _spark_output(df: DataFrame, columns: str) -> DataFrame:
    """Fixed output types: i bigint, f/f4/f2 rounded double, s string, b boolean, t timestamp text."""
    out = []
    for name, kind in _parse(columns):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind.startswith("f"):
            c = c.cast("double")
            c = F.round(F.when(F.abs(c) < F.lit(float("inf")), c), int(kind[1:] or 6)) + F.lit(0.0)
        elif kind == "b":
            c = c.cast("boolean")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def _sql_output(body: str, columns: str) -> str:
    out = []
    for name, kind in _parse(columns):
        c = f'q."{name}"'
        if kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind.startswith("f"):
            v = f"CAST({c} AS DOUBLE)"
            c = f"(CASE WHEN isfinite({v}) THEN round({v}, {int(kind[1:] or 6)}) END) + 0.0::DOUBLE"
        elif kind == "b":
            c = f"CAST({c} AS BOOLEAN)"
        elif kind == "t":
            c = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
        else:
            c = f"CAST({c} AS VARCHAR)"
        out.append(f'{c} AS "{name}"')
    return sql_text.compose(f"SELECT {', '.join(out)} FROM ({body}) q")


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``; ``sql`` is its single-engine twin."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _spark_output(fn(Inputs(spark, sf_dir)), columns)

        assert name not in QUERIES, name
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _sql_output(sql, columns)
        return fn

    return wrap
