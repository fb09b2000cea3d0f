"""Categorical encoders: fit a dictionary, apply it, decode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

#: Categories of a binary code or a one-hot field at most.
MAX_CATEGORIES = 20


def fit(df: DataFrame, column: str) -> DataFrame:
    """Dictionary (value, idx): 1-based index by sorted value. Only the distinct values are numbered, by ranges."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return numbered(values, ["value"], "idx").withColumn("idx", F.col("idx").cast("int"))


def extend(dictionary: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """The dictionary with values that are new in ``df`` behind its last index; known values keep theirs."""
    new = fit(df.join(dictionary, F.col(column).cast("string") == dictionary["value"], "left_anti"), column)
    top = dictionary.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("top"))
    return dictionary.unionByName(new.join(F.broadcast(top)).select("value", (F.col("idx") + F.col("top")).alias("idx")))


def ordinal(df: DataFrame, column: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Index as a string, null if unknown. The planner broadcasts the dictionary if it is small."""
    side = dictionary.select(F.col("value").alias("_v"), F.col("idx").cast("string").alias(out))
    return df.join(side, F.col(column).cast("string") == F.col("_v"), "left").drop("_v")


def bounded_values(dictionary: DataFrame, most: int = MAX_CATEGORIES) -> list[tuple[str, int]]:
    """The dictionary on the driver; more than ``most`` values are an error."""
    rows = dictionary.orderBy("idx").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} categories")
    return [(r["value"], r["idx"]) for r in rows]


def one_hot(df: DataFrame, column: str, dictionary: DataFrame, most: int = MAX_CATEGORIES) -> DataFrame:
    """Columns ``<column><idx>`` with 1 for the row's value, else 0."""
    return df.withColumns({f"{column}{i}": F.when(F.col(column) == v, 1).otherwise(0) for v, i in bounded_values(dictionary, most)})


def binary_code(idx: Column, most: int = MAX_CATEGORIES) -> Column:
    """"1" and eight bits of the index; unknown values and those beyond ``most`` have index 0."""
    known = F.when(idx.between(1, most), idx).otherwise(0)
    return F.concat(F.lit("1"), F.lpad(F.bin(known.cast("long")), 8, "0"))


def binary(df: DataFrame, column: str, dictionary: DataFrame, out: str, most: int = MAX_CATEGORIES) -> DataFrame:
    side = dictionary.select(F.col("value").alias("_v"), F.col("idx").alias("_i"))
    coded = df.join(side, F.col(column).cast("string") == F.col("_v"), "left")
    return coded.withColumn(out, binary_code(F.coalesce("_i", F.lit(0)), most)).drop("_v", "_i")


def decode(df: DataFrame, code: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Value of a binary code; null for index 0."""
    side = dictionary.select(F.col("value").alias(out), binary_code(F.col("idx")).alias("_c"))
    return df.join(side.where("_c <> '100000000'"), F.col(code) == F.col("_c"), "left").drop("_c")


def bit_columns(df: DataFrame, code: str, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{i}": F.substring(code, i + 2, 1).cast("int") for i in range(8)})


def encoded_names(column: str, encoding: str, dictionary: DataFrame) -> list[str]:
    """Names of the columns that an encoding of a field gives."""
    if encoding == "binary":
        return [f"{column}{i}" for i in range(8)]
    return [f"{column}{i}" for _, i in bounded_values(dictionary)] if encoding == "onehot" else [column]


def encode_all(df: DataFrame, encodings: dict[str, str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Fit and apply the encoding of each field: ``onehot``, ``binary`` or ``id``; returns the dictionaries as well."""
    dictionaries = {}
    for column, kind in encodings.items():
        d = dictionaries[column] = fit(df, column)
        df = one_hot(df, column, d) if kind == "onehot" else binary(df, column, d, f"{column}_code") if kind == "binary" else ordinal(df, column, d, f"{column}_id")
    return df, dictionaries
