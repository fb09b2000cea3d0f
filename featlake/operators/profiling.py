"""Dataset descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frequent words of each language.
STOP_WORDS = {
    "de": ("als", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einen", "einer", "er", "es", "für", "ist", "mit", "nach", "nicht", "sich", "sie", "sind", "und", "von", "war", "wie", "zu"),
    "en": ("and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "have", "he", "his", "in", "is", "it", "not", "of", "on", "or", "that", "the", "they", "this", "to", "was", "were", "which", "with", "you"),
    "es": ("al", "con", "del", "el", "ella", "en", "era", "esta", "este", "hay", "la", "las", "lo", "los", "más", "muy", "no", "para", "pero", "por", "que", "se", "ser", "sin", "son", "su", "un", "una", "y", "ya"),
    "fr": ("au", "aux", "avec", "ce", "cette", "dans", "des", "du", "elle", "est", "et", "il", "je", "la", "le", "les", "mais", "ne", "nous", "ont", "ou", "par", "pas", "pour", "que", "qui", "sont", "sur", "une", "vous"),
}


#: Names that time columns have where no column has a time type.
TIME_NAMES = ("timestamp", "on_date", "added_on", "time")


def describe(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values (approximate, or ``exact`` by a shuffle of each column's values), least and greatest value as text, mean of numbers; one pass."""
    stats = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        mean = F.avg(c) if isinstance(f.dataType, T.NumericType) else F.lit(None)
        counts = [F.count("*").alias("n"), (F.count("*") - F.count(c)).alias("nulls"), F.approx_count_distinct(c).alias("distinct")]
        values = [F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most"), mean.cast("double").alias("mean")]
        stats.append(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), *counts, *values))
    out = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    if not exact:
        return out
    counts = None
    for f in df.schema:
        part = df.select(F.col(f"`{f.name}`").alias("v")).distinct().agg(F.count("v").alias("distinct")).select(F.lit(f.name).alias("name"), "distinct")
        counts = part if counts is None else counts.union(part)
    return out.drop("distinct").join(F.broadcast(counts), "name").select(*out.columns)


def timestamp_column(df: DataFrame) -> str | None:
    """The first column of a time type, else one whose name says so."""
    for f in df.schema:
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType):
            return f.name
    return next((f.name for f in df.schema if f.name in TIME_NAMES), None)


def feature_schema(df: DataFrame, keys: list[str], encoded: dict[str, list[str]] | None = None) -> DataFrame:
    """Per column: ``float``, ``datetime`` or ``str``, whether it is a key, and the columns (joined by commas) that its encoding gives, null without one."""
    kind = lambda t: "float" if isinstance(t, T.NumericType) else "datetime" if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType) else "str"
    parts = lambda c: ",".join(encoded[c]) if encoded and c in encoded else None
    return df.sparkSession.createDataFrame([(f.name, kind(f.dataType), f.name in keys, parts(f.name)) for f in df.schema], "name string, kind string, is_key boolean, encoded string")


def target_type(df: DataFrame, column: str, most_classes: int = 20) -> DataFrame:
    """``regression`` for a number with more than ``most_classes`` distinct values, else ``classification``."""
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    n = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most_classes + 1).agg(F.count("*").alias("n"))
    return n.select(F.lit(column).alias("target"), F.when(F.lit(numeric) & (F.col("n") > most_classes), "regression").otherwise("classification").alias("task"))


def column_language(df: DataFrame, text: str) -> DataFrame:
    """Stop words of each language found over all texts; the first row is the language.

    Words are counted before they meet the table of languages, so a word takes one row of a task's shuffle at most.
    """
    known = df.sparkSession.createDataFrame([(lang, w) for lang, words in STOP_WORDS.items() for w in words], "lang string, word string")
    every = sorted({w for words in STOP_WORDS.values() for w in words})
    own = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), lambda w: w.isin(every))
    found = df.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    votes = known.join(found, "word", "left").groupBy("lang").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("votes"))
    return votes.orderBy(F.desc("votes"), "lang")
