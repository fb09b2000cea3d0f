"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..sources.scratch import new_path, written

__all__ = ["BLANKS", "broadcast_if_small", "forget", "let", "new_path", "numbered", "shingle_hashes", "shuffle_partitions", "words", "written"]

#: What separates words: space and the ASCII controls 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/featlake/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text, which are the runs of characters that BLANKS does not hold; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def shingle_hashes(tokens: Column, size: int = 5) -> Column:
    """64-bit hashes of all ``size``-word shingles, in order of place; a shorter text is one shingle, no words none."""

    def body(w: Column) -> Column:
        n = F.size(w)
        whole = F.array(F.xxhash64(w))
        each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, whole).otherwise(each)

    return let(tokens, body)


#: Bytes of a row that a bound on rows stands for.
ROW_BYTES = 64


def broadcast_if_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ROW_BYTES for each on average, which is measured; otherwise the planner chooses."""
    sizes = [F.octet_length(f"`{n}`") if t in ("string", "binary") else F.size(f"`{n}`") * 8 if t.startswith("array") else F.lit(8) for n, t in df.dtypes]
    each = sum((F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("long") for x in sizes), F.lit(0).cast("long"))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= rows * ROW_BYTES else df
