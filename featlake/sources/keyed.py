"""Tables that are changed by key without being written anew.

Rows lie in folders by a hash of their key. A change reads and writes the
folders that its keys hash to, and no others; files of other folders stay as they
are. Spark replaces the touched folders one by one at the end of the job: a
change that is stopped may be run again, as each kind of change gives the same
rows when it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import writers
from .scratch import written

BUCKET = "_bucket"
#: Files that begin with an underscore are no data of the table.
_ABOUT = "_keys"


def _bucketed(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _place(df: DataFrame, path: str, buckets: int) -> None:
    tasks = min(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    writer = df.repartitionById(tasks, F.col(BUCKET) % tasks).write.partitionBy(BUCKET)
    writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_keyed(df: DataFrame, path: str, key: list[str], buckets: int = 256) -> None:
    """A new table at ``path`` in ``buckets`` folders, of which each should fit a task."""
    spark = df.sparkSession
    spark.createDataFrame([(key, buckets)], "key array<string>, buckets int").write.mode("error").parquet(f"{path}/{_ABOUT}")
    df.limit(0).write.parquet(f"{path}/{_ABOUT}_columns")
    _place(_bucketed(df, key, buckets), path, buckets)


def read_keyed(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{path}/{_ABOUT}_columns").schema.add(BUCKET, T.IntegerType())
    df = spark.read.schema(schema).parquet(path)
    return (df if where is None else df.where(where)).drop(BUCKET)


def change_keyed(spark: SparkSession, path: str, changes: DataFrame, how: str, columns: list[str] | None = None, order: list[str] | None = None) -> list[int]:
    """``update`` (of ``columns``), ``upsert`` or ``delete`` rows by the keys of ``changes``; gives the numbers of the folders that were written.

    A key that an update has several times is an error, or its last row by
    ``order`` counts.
    """
    about = spark.read.parquet(f"{path}/{_ABOUT}").first()
    key, buckets = list(about["key"]), about["buckets"]
    touched = sorted(r[0] for r in _bucketed(changes.select(*key), key, buckets).select(BUCKET).distinct().collect())  # as many as there are folders at most
    if not touched:
        return []
    old = read_keyed(spark, path, F.col(BUCKET).isin(touched))
    new = {
        "update": lambda: writers.keyed_update(old, changes, key, columns or [c for c in old.columns if c not in key], order),
        "upsert": lambda: writers.upsert(old, changes.select(*old.columns), key),
        "delete": lambda: writers.delete_keys(old, changes, key),
    }[how]()
    staged = written(_bucketed(new, key, buckets), "changed")
    left = {r[0] for r in staged.select(BUCKET).distinct().collect()}
    _place(staged, path, buckets)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for bucket in set(touched) - left:  # nothing replaces a folder whose rows are all gone
        folder = hadoop.Path(f"{path}/{BUCKET}={bucket}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
