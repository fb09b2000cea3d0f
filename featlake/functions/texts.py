"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hostname(url: Column, strip_www: bool = False) -> Column:
    """Host of a URL whose scheme (http or https) and user are optional: what stands before the first slash."""
    host = F.regexp_extract(F.regexp_replace(url, r"^(http://)?(https://)?", ""), r"^[^/]*", 0)
    host = F.regexp_replace(host, r"^www\.", "") if strip_www else host
    return F.regexp_replace(host, r"^[^@]*@", "")


def is_numeric(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def try_int(text: Column) -> Column:
    return text.try_cast("int")


def slug(text: Column) -> Column:
    """Spaces become dashes; all but word characters, points and dashes go."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("-")), r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}.\-]+", "")


def gender_code(text: Column) -> Column:
    """male or t is 1, female or f is 2, else 0."""
    return F.when(text.isin("male", "t"), 1).when(text.isin("female", "f"), 2).otherwise(0)


def clean_name(name: str) -> str:
    """Column name without marks that need quoting."""
    for c in "-. <>=+$#*()":
        name = name.replace(c, "_")
    return name


def json_value(text: Column, path: str, kind: str) -> Column:
    """Member of a JSON text; null if it is missing or of another kind."""
    return F.get_json_object(text, path).try_cast(kind)


def key_hash(*parts: Column) -> Column:
    """64-bit hash of a key's parts, for spreading and joining; nulls count as parts."""
    return F.xxhash64(*[p.cast("string") for p in parts])
