"""Registry and loaders of the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


ZONE = "spark.sql.session.timeZone"


def in_utc(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``f`` with UTC as the session's zone while the query is built, where Spark binds it to expressions; the caller's zone is put back."""

    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        own = spark.conf.get(ZONE)
        spark.conf.set(ZONE, "UTC")
        try:
            df = f(spark, d)
            df.schema  # noqa: B018  # analysed here, under UTC
            return df
        finally:
            spark.conf.set(ZONE, own)

    return run


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = in_utc(f)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table whose local times are taken as those of the session's zone, which is UTC in a registered query."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def text_of(ts) -> F.Column:
    """A time as text with seconds, the same form in any session."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
