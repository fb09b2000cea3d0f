"""Streaming forms of ingest, keyed state, enrichment, grouping, sessions and guards.

Jobs take a streaming DataFrame and give one, or start a query that ends when
the available input is read. State is kept by Spark and checkpointed with the
query, so a lost executor resumes from the last batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import new_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Files as they arrive, a bounded number in a batch; local times become instants, as watermarks need."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def drain(writer) -> None:
    """Run a stream writer over what is available, then stop."""
    q = writer.trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def ingest(df: DataFrame, path: str) -> None:
    """Append every row once; the checkpoint beside the table remembers what has been read."""
    drain(df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint"))


def to_batches(df: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    spark = df.sparkSession
    drain(df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", new_path(spark, "stream")))


def keyed_state(df: DataFrame, keys: list[str], aggs: list[Column], path: str) -> DataFrame:
    """Running aggregates per key; each batch writes the keys that changed, and the newest row of a key is its state."""
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    to_batches(df.groupBy(*keys).agg(*aggs), write, "update")
    rows = spark.read.option("basePath", path).option("recursiveFileLookup", "true").parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")


def enriched(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Stream-static left join; the side has one row for a key."""
    return df.join(side, key, "left")


def entity_days(df: DataFrame, user: str, ts: str, late: str) -> DataFrame:
    """Events and first time per user and day; rows later than ``late`` behind the newest are left out."""
    return df.withWatermark(ts, late).groupBy(F.col(user).alias("user"), F.window(ts, "1 day")).agg(F.count("*").alias("n"), F.min(ts).alias("noticed_date"))


def gap_sessions(df: DataFrame, user: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    return df.withWatermark(ts, late).groupBy(F.col(user).alias("user"), F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def unique_rows(df: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """First row of each key; repeats within ``late`` are dropped."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame, int], None]]) -> None:
    """Every batch to every sink, computed once."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    to_batches(df, each)
