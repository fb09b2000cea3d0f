"""Row numbers and neighbours without a window over all rows or over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``name``: the number of each row in ``order``, from ``start``, without gaps.

    Rows are sorted by ranges and numbered inside a range; the counts of ranges,
    a row each, give the numbers across ranges. Rows that are equal in ``order``
    may take any of their numbers.
    """
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = written(placed, "numbered")
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_range", (before - F.col("_first") + start).alias("_shift"))
    return placed.join(F.broadcast(ranges), "_range").select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def numbered_flags(df: DataFrame, order: list, flag: Column, name: str) -> DataFrame:
    """``name``: how many rows with ``flag`` come before each row in ``order``; of rows that are equal in it, any of those."""
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.withColumn("_flag", flag.cast("long")).repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = written(placed.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    ranges = placed.groupBy("_range").agg(F.sum("_flag").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_flag").over(W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = placed.withColumn("_inside", inside).join(F.broadcast(ranges.select("_range", before.alias("_before"))), "_range")
    return rows.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null, as in groups and windows; the keys come once, from the left."""
    side = right.withColumnsRenamed({k: f"_join_{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_join_{i}"))
    return left.join(side, same, how).drop(*[f"_join_{i}" for i in range(len(keys))])


def at_position(df: DataFrame, order: list[str], share: float) -> DataFrame:
    """The row at floor(share * n) in ``order``, from 0."""
    rows = numbered(df, order, "_position", 0)
    n = rows.agg(F.floor(F.lit(share) * F.count("*")).alias("_wanted"))
    return rows.join(F.broadcast(n), F.col("_position") == F.col("_wanted")).select(*df.columns)


def with_neighbours(df: DataFrame, key: list[str], bucket: str, order: list[str], previous: dict[str, Column] | None = None, following: dict[str, Column] | None = None) -> DataFrame:
    """Values of the row before (``previous``: name -> column) and after (``following``) each row of a key.

    ``bucket`` grows with ``order``, as a day does with the time. Rows are
    compared inside a bucket; one row per key and bucket carries its first and
    last values to the buckets beside it, so a long history is spread over tasks.
    """
    previous, following = previous or {}, following or {}
    inside = W.partitionBy(*key, bucket).orderBy(*order)
    rows = df.withColumns({
        **{f"_l_{n}": F.lag(F.struct(c.alias("v"))).over(inside) for n, c in previous.items()},
        **{f"_f_{n}": F.lead(F.struct(c.alias("v"))).over(inside) for n, c in following.items()},
    })
    place = F.struct(*order)
    ends = [F.max_by(F.struct(c.alias("v")), place).alias(f"_last_{n}") for n, c in previous.items()] + [F.min_by(F.struct(c.alias("v")), place).alias(f"_first_{n}") for n, c in following.items()]
    across = W.partitionBy(*key).orderBy(bucket)
    buckets = df.groupBy(*key, bucket).agg(*ends)
    buckets = buckets.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*key, bucket])],
        *[F.lag(f"_last_{n}").over(across).alias(f"_before_{n}") for n in previous], *[F.lead(f"_first_{n}").over(across).alias(f"_after_{n}") for n in following],
    )
    same = F.lit(True)
    for i, k in enumerate([*key, bucket]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(buckets, same)
    return out.select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_before_{n}")["v"].alias(n) for n in previous], *[F.coalesce(f"_f_{n}", f"_after_{n}")["v"].alias(n) for n in following]
    )
