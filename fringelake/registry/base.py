"""Query registration: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringelake.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _final(df: DataFrame, ints: list[str], reals: list[str], texts: list[str],
           digits: int) -> DataFrame:
    # Adding zero turns -0.0 into 0.0.
    return df.select(*[F.col(c).cast("long").alias(c) for c in ints],
                     *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c)
                       for c in reals],
                     *[F.col(c).cast("string").alias(c) for c in texts])


def _final_sql(sql: str, ints, reals, texts, digits: int) -> str:
    cols = [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints]
    cols += [f'round(CAST("{c}" AS DOUBLE), {digits}) + 0e0 AS "{c}"' for c in reals]
    cols += [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in texts]
    return f"SELECT {', '.join(cols)} FROM ({sql}) AS result"


def query(ints: str = "", reals: str = "", texts: str = "", *, digits: int = 6,
          sql: str | None = None):
    """Register a function under its name. Integers become BIGINT and reals are
    rounded on both sides."""
    names = [s.split() for s in (ints, reals, texts)]

    def register(fn: Query) -> Query:
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return _final(fn(spark, sf_dir), *names, digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _final_sql(sql, *names, digits)
        return fn

    return register
