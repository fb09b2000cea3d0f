"""Sinks and keyed changes of tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import one_per_key
from ..operators.numbering import join_null_safe
from ..operators.project import require_unique


def replace_output(df: DataFrame, path: str, **options: str) -> None:
    df.write.options(**options).mode("overwrite").parquet(path)


def append_batches(df: DataFrame, path: str, batch: int = 30_000) -> None:
    """Append in files of ``batch`` rows at most."""
    df.write.option("maxRecordsPerFile", batch).mode("append").parquet(path)


def keyed_update(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` with ``columns`` taken from ``new`` where a key matches and the new value is not null.

    A key that ``new`` has several times is an error; with ``order`` its last
    row counts. A null key matches nothing.
    """
    new = one_per_key(new, key, order) if order else require_unique(new, key)
    side = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = old.join(side, key, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*old.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those with the same key (null is a key like others), and the rest of ``old``."""
    return join_null_safe(old, new.select(*key).distinct(), key, "left_anti").unionByName(new)


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def truncate(spark: SparkSession, path: str) -> None:
    """Empty the table at ``path``; its columns stay."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def observed(df: DataFrame, write, **statistics: Column) -> dict:
    """Write every row unchanged by ``write`` and give the statistics of the rows that passed, from the same pass."""
    seen = Observation()
    write(df.observe(seen, *[e.alias(n) for n, e in statistics.items()]))
    return seen.get


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """With a header; quotes inside values are escaped by doubling."""
    df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def clustered(df: DataFrame, *columns: str, partitions: int | None = None) -> DataFrame:
    """Rows ranged by ``columns`` and sorted in each file, so that min and max skip files."""
    ranged = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return ranged.sortWithinPartitions(*columns)


def create_or_append(spark: SparkSession, df: DataFrame, path: str) -> tuple[str, bool]:
    """Append to the dataset at ``path`` if it has the same fields, else to the first of ``path-2``, ``path-3`` ... that has, else write a new one.

    A dataset with other fields stays as it is. Gives the path that was written
    and whether it was there already.
    """
    place, n = path, 1
    while True:
        try:
            fields = spark.read.parquet(place).schema.fieldNames()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            df.write.mode("append").parquet(place)
            return place, False
        if fields == df.columns:
            df.write.mode("append").parquet(place)
            return place, True
        n += 1
        place = f"{path}-{n}"
