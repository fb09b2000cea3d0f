"""Scans: delimited and JSON files, directories, payload columns, catalog tables."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.texts import clean_name
from ..operators.numbering import join_null_safe
from .records import delimited, json_objects, without_quoted
from .scratch import written

#: MIME types of each reader; spreadsheet types are read as CSV, an empty type as JSON.
MIME = {"text/csv": "csv", "application/json": "json", "": "json"}
#: Types of Spark's own formats.
MIME_MORE = {"application/x-ndjson": "jsonl", "application/vnd.apache.parquet": "parquet"}


#: Rows that show which types a column can't have.
FIRST_ROWS = 1000

#: Marks around a value that do not belong to it; double quotes are taken off by the parser.
CSV_TRIM = "\t\n\r'"


def read_csv(spark: SparkSession, path: str, sep: str = ";", header: bool = True, schema: T.StructType | str | None = None, sample: float = 1.0, names: list[str] | None = None) -> DataFrame:
    """Delimited files, read in splits; a line end inside double quotes belongs to the value.

    A file without ``header`` has the ``names`` that are given. Quotes that enclose
    a value, and single quotes, tabs and line ends around it go. Fields without a name, also those that a row has
    beyond the header, are ``NoName_<place>``, and go if they are empty in all rows. Without ``schema`` a type is inferred
    from the rows of ``sample`` (all by default); if it is a smaller share and a
    value of another row does not fit its column's type, the column stays text,
    so that no value is lost. Where the separator is no comma, numbers may have a decimal comma.
    """
    records = delimited(spark, path, sep)
    rows = records.where(~F.col("first")) if header else records
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "multiLine": "true", "maxColumns": "1000000"}
    if schema:
        df = rows.select(F.from_csv("text", schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " "), options).alias("v")).select("v.*")
        return df.toDF(*[clean_name(c) for c in df.columns])
    quoted = F.when(F.col("text").contains('"'), without_quoted(F.col("text"), sep)).otherwise(F.col("text"))
    seen = F.lit(True) if not header else ~F.col("first")
    shape = records.agg(F.max(F.when(seen, F.size(F.split(quoted, re.escape(sep))))).alias("width"), F.min_by(F.when(F.col("first"), F.col("text")), F.when(F.col("first"), F.col("file"))).alias("head")).first()
    heads, width = [shape["head"]] if header and shape["head"] is not None else [], shape["width"] or 0
    given = [x.strip(CSV_TRIM + '" ') for x in next(csv.reader([heads[0]], delimiter=sep, skipinitialspace=True))] if heads else list(names or [])
    given += [""] * (width - len(given))
    if not given:
        return spark.createDataFrame([], T.StructType([]))
    fields = [clean_name(g) if g else f"NoName_{i}" for i, g in enumerate(given)]
    text = rows.select(F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(fields))), options).alias("v")).select("v.*").toDF(*fields)
    # Fields are cut once: kinds, and what reads the result, take the columns they need.
    text = written(text.select(*[F.btrim(F.col(f"`{c}`"), F.lit(CSV_TRIM)).alias(c) for c in fields]), "fields")
    filled = lambda c: F.bool_or(F.coalesce(F.length(f"`{c}`"), F.lit(0)) > 0)
    parse = {kind: (lambda c, kind=kind: _parsed(c, kind, sep)) for kind in KINDS}
    fits = {(c, kind): F.bool_and(F.when(_value(c).isNotNull(), of(c).isNotNull())) for c in fields for kind, of in parse.items()}
    # A kind that does not fit a first row fits no column; all rows are read for the others only.
    begin = _aggregated(text.limit(FIRST_ROWS), fits)
    fits = {of: x for of, x in fits.items() if begin[of] is not False}
    if sample < 1.0:  # kinds that the sample shows, which every value must fit
        shown = _aggregated(text.sample(sample, seed=1), fits)
        fits = {(c, kind): x for (c, kind), x in fits.items() if shown[c, kind]}
    found = _aggregated(text, {**fits, **{(c, "filled"): filled(c) for c in fields}})
    kinds = {c: next((k for k in KINDS if found.get((c, k))), "string") for c in fields}
    keep = [c for c, g in zip(fields, given, strict=True) if g or found[c, "filled"]]
    cast = lambda c: F.col(f"`{c}`") if kinds[c] == "string" else parse[kinds[c]](c)
    return text.select(*[cast(c).alias(c) for c in keep])


def _value(column: str) -> Column:
    return F.when(F.col(f"`{column}`") != "", F.col(f"`{column}`"))


#: Types of a column, the narrowest first; what fits none, or is empty throughout, is text.
KINDS = ("bigint", "double", "timestamp")


def _parsed(column: str, kind: str, sep: str) -> Column:
    """A value as ``kind``, null if it does not fit."""
    value = _value(column)
    if kind == "double" and sep != ",":
        value = F.regexp_replace(value, r"^\s*([+-]?\d+),(\d+)\s*$", "$1.$2")
    if kind == "timestamp":
        value = F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), value)
    return value.try_cast(kind)


def _aggregated(df: DataFrame, parts: dict[tuple, Column]) -> dict[tuple, object]:
    """All aggregates in one pass, by their keys."""
    row = df.agg(*[e.alias(f"a{i}") for i, e in enumerate(parts.values())]).first() if parts else ()
    return dict(zip(parts, row, strict=True))


#: Values of a text column up to which it is encoded by default: two are told apart by a bit each, more by a code.
MOST_DEFAULT = 20


def inferred(df: DataFrame) -> DataFrame:
    """A row per column: ``name``, ``type``, ``is_time`` (of the dataset's time column) and ``encoding``, the default one.

    Numbers and times are taken as they are; a text column is coded as
    ``binary`` up to MOST_DEFAULT distinct values, else by ``id``.
    """
    from ..operators.profiling import timestamp_column

    time = timestamp_column(df)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    counts = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in texts]).first() if texts else {}
    rows = [(f.name, f.dataType.simpleString(), f.name == time, None if f.name not in texts else "binary" if counts[f.name] <= MOST_DEFAULT else "id") for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "name string, type string, is_time boolean, encoding string")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files with an array of objects or one object each."""
    reader = spark.read.option("multiLine", True)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def read_concatenated_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects written one behind another, with blanks between them or nothing; read in splits, whatever their nesting."""
    return json_objects(spark, path).select(F.from_json(F.trim("text"), schema).alias("v")).select("v.*")


def parse_payload(df: DataFrame, column: str, schema: str, kind: str = "json", sep: str = ";") -> DataFrame:
    """Rows held as text in a column."""
    parsed = F.from_json(column, schema) if kind == "json" else F.from_csv(column, schema, {"sep": sep})
    return df.select(parsed.alias("v")).select("v.*")


def read_any(spark: SparkSession, path: str, mime: str) -> DataFrame:
    """Reader chosen by MIME type; an unknown type is an error."""
    kind = "csv" if "ms-excel" in mime else (MIME | MIME_MORE).get(mime)
    if kind is None:
        raise ValueError(f"no reader for {mime!r}")
    return {"csv": lambda: read_csv(spark, path, ","), "json": lambda: read_json_documents(spark, path), "jsonl": lambda: read_json_lines(spark, path), "parquet": lambda: spark.read.parquet(path)}[kind]()


def read_directory(spark: SparkSession, path: str, kind: str = "parquet", shards: int | None = None, **options: str) -> DataFrame:
    """Every file of a folder, top level only; with ``shards`` the first of them in order of name."""
    df = spark.read.options(recursiveFileLookup="false", **options).format(kind).load(path)
    if shards is None:
        return df
    return spark.read.options(**options).format(kind).schema(df.schema).load(sorted(df.inputFiles())[:shards])


def read_shards(spark: SparkSession, path: str, kind: str = "parquet", shards: int | None = None) -> DataFrame:
    """The first ``shards`` folders of ``path``, in order of name (all without a limit); only their files are listed and read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = sorted(f.getPath().toString() for f in found if f.isDirectory())
    return spark.read.format(kind).load(names[:shards])


def read_many(frames: list[DataFrame]) -> DataFrame:
    """Several datasets as one, by column name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def first_entries(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Entry limit, by an order so that it is the same each time."""
    return df.orderBy(*order).limit(n)


def lookup_table(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise LookupError(f"no dataset named {name}")
    return spark.table(name)


def preaggregated(df: DataFrame, where, keys: list[str], total: str, item: list[str], most: int) -> DataFrame:
    """match, group (count, sum), limit, and then the items of the groups that are left, in order."""
    rows = df.where(where)
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(total).alias("total")).orderBy(*keys).limit(most)
    items = join_null_safe(rows, groups.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*item))).alias("items"))
    return join_null_safe(groups, items, keys)
