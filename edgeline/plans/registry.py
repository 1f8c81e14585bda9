"""Registry of the named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeline.plans.oracle import r6, with_views
from edgeline.sources.adapter import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_ORACLES: dict[str, tuple[str, dict[str, str] | None]] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column; other columns pass unchanged."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def query(name: str, sql: str | None = None, dbl: str = "", ints: str = "",
          views: dict[str, str] | None = None):
    """Register a query; ``dbl`` and ``ints`` name the oracle's double and bigint columns."""
    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            fixes = [f"{r6(c)} AS {c}" for c in dbl.split()]
            fixes += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
            text = (f"SELECT * REPLACE ({', '.join(fixes)}) FROM ({sql.strip()})"
                    if fixes else sql)
            _ORACLES[name] = (text, views)
        return fn
    return add


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(QUERIES[name](Views(spark, sf_dir)))
    return run


def oracle_texts() -> dict[str, str]:
    """Complete oracle SQL per query, with the views each one needs."""
    return {name: with_views(text, views) for name, (text, views) in _ORACLES.items()}
