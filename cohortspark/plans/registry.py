"""All queries over the provided tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_: str = ""):
    """Registers a query under its function's name, and its SQL with the common tables it needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH {with_} " if with_ else "") + sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles whose last digits depend on the order of a sum, with so many digits."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + 0.0 for c in columns})


from . import cohort_queries, evaluation_queries, feature_queries  # noqa: E402, F401
