"""Projections and filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.texts import clean_name
from ..sources.scratch import written
from .numbering import numbered, with_neighbours


def cleaned(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def apply_options(df: DataFrame, ignore: list[str] = (), duplicate: dict[str, str] | None = None, compute: dict[str, Column] | None = None, as_string: list[str] = ()) -> DataFrame:
    """Field options: copies under another name, computed or overridden fields, forced strings, then ignored fields go."""
    out = df.withColumns({new: F.col(old) for old, new in (duplicate or {}).items()}) if duplicate else df
    out = out.withColumns(compute) if compute else out
    out = out.withColumns({c: F.col(c).cast("string") for c in as_string}) if as_string else out
    return out.drop(*ignore)


def identity_features(df: DataFrame, targets: list[str]) -> DataFrame:
    """Each column as ``f_<column>``; targets keep their names."""
    return df.select(*[F.col(c) if c in targets else F.col(c).alias(f"f_{c}") for c in df.columns])


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(values))


def in_table(df: DataFrame, keys: DataFrame, on: str, negate: bool = False) -> DataFrame:
    """Rows whose key is (not) in a table of any size."""
    return df.join(keys.select(on).distinct(), on, "left_anti" if negate else "left_semi")


def match_example(df: DataFrame, **pairs) -> DataFrame:
    """Conjunction of equalities; None matches null."""
    out = df
    for name, value in pairs.items():
        out = out.where(F.col(name).eqNullSafe(F.lit(value)))
    return out


#: Rows up to the end of a page that are sorted in one task.
NEAR_PAGE = 100_000


def page(df: DataFrame, order: list, skip: int, take: int) -> DataFrame:
    """``take`` rows behind the first ``skip`` in ``order``. A page far behind is found by row numbers, as a sort of all rows before it would be one task's."""
    if skip + take <= NEAR_PAGE:
        return df.orderBy(*order).offset(skip).limit(take)
    return numbered(df, order, "_place", 0).where(F.col("_place").between(skip, skip + take - 1)).orderBy("_place").drop("_place")


def time_range(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Half-open range, as a predicate that reaches the scan."""
    kind = df.schema[ts].dataType.simpleString()
    return df.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))


EARTH_KM = 6371.0


def haversine_km(lat: Column, lng: Column, lat0: Column | float, lng0: Column | float) -> Column:
    lat0, lng0 = (x if isinstance(x, Column) else F.lit(x) for x in (lat0, lng0))
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat0)) * F.pow(F.sin(F.radians(lng - lng0) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def geo_near(df: DataFrame, lat: str, lng: str, lat0: float, lng0: float, take: int, key: str, within_km: float | None = None) -> DataFrame:
    """The nearest rows, with ``km``; with ``within_km`` those up to this distance, which a belt of latitudes filters first."""
    if within_km is not None:
        belt = math.degrees(within_km / EARTH_KM) + 1e-9
        df = df.where(F.col(lat).between(lat0 - belt, lat0 + belt))
    df = df.withColumn("km", haversine_km(F.col(lat), F.col(lng), lat0, lng0))
    return (df if within_km is None else df.where(F.col("km") <= within_km)).orderBy("km", key).limit(take)


#: Halvings of the cube around the globe: the finest cells have edges of about 12 m.
GEO_LEVELS = 20


def _cells(level: Column, sides: list[str]) -> list[Column]:
    """The cell of a point at a level: each side of the cube is cut into 2^level parts."""
    parts = F.pow(F.lit(2), level).cast("int")
    return [F.least(F.floor((F.col(c) + 1) / 2 * parts), parts - 1).cast("int") for c in sides]


#: Targets up to which their cells are held by every task.
GEO_HELD = 10_000


def geo_nearest(points: DataFrame, targets: DataFrame, lat: str, lng: str, k: int, point_key: str, key: str) -> DataFrame:
    """The ``k`` nearest targets of every point, as ``point_key``, ``key``, ``km`` and ``rank``; of equally near ones the least keys.

    Both sides have columns ``lat`` and ``lng``. Places are points of the unit
    sphere inside a cube that is halved again and again, so there is no border at a
    meridian or pole. A point starts in the smallest of its cells that has k
    targets; the farthest of k targets there bounds the distance, and all targets
    within it lie in the 27 cells around the point whose edges are no shorter. What
    lies around a cell is put together once for all its points, so neither points
    nor pairs are sent for each of the 27. Of targets in one place the first k take
    part. Rows without a place are left out; fewer than k targets are all found.
    """
    sides = ["_x", "_y", "_z"]

    def placed(df: DataFrame, *columns: str) -> DataFrame:
        a, b = F.radians(df[lat]), F.radians(df[lng])
        xyz = {"_x": F.cos(a) * F.cos(b), "_y": F.cos(a) * F.sin(b), "_z": F.sin(a)}
        return df.where(df[lat].isNotNull() & df[lng].isNotNull()).select(*[df[c].alias(n) for c, n in zip(columns, ("_key",), strict=True)], df[lat].cast("double").alias("_lat"), df[lng].cast("double").alias("_lng"), *[e.alias(n) for n, e in xyz.items()])

    def chord2(place: Column) -> Column:
        return sum((F.pow(F.col(c) - place[c], 2) for c in sides), F.lit(0.0))

    same = W.partitionBy("_lat", "_lng").orderBy("_key")
    near = placed(targets, key).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n")
    near = written(near, "targets")
    levels = F.explode(F.sequence(F.lit(0), F.lit(GEO_LEVELS)))
    cell = F.struct(*[c.alias(n) for n, c in zip("abc", _cells(F.col("_level"), sides), strict=True)])
    # Cells with k targets, and the places of k of them.
    some = F.row_number().over(W.partitionBy("_level", "_cell").orderBy("_key"))
    full = near.withColumn("_level", levels).select("_level", cell.alias("_cell"), "_key", F.struct(*sides).alias("_place")).withColumn("_n", some).where(F.col("_n") <= k)
    full = full.groupBy("_level", "_cell").agg(F.collect_list("_place").alias("_some")).where(F.size("_some") == k)
    full = F.broadcast(full) if near.count() <= GEO_HELD else full.hint("merge")
    asks = written(placed(points, point_key).withColumn("_q", F.monotonically_increasing_id()), "points")
    start = asks.select("_q", *sides, levels.alias("_level")).select("_q", *sides, "_level", cell.alias("_cell")).join(full, ["_level", "_cell"])
    start = start.groupBy("_q").agg(F.max_by(F.array_max(F.transform("_some", chord2)), "_level").alias("_bound"))
    # A little more than the bound, for rounded places; without such a cell all targets of the whole cube.
    bound = F.coalesce(F.sqrt("_bound") * (1 + 1e-9) + 1e-12, F.lit(4.0))
    level = F.greatest(F.lit(0), F.least(F.lit(GEO_LEVELS), F.floor(1 - F.log2("_bound")).cast("int")))
    asks = asks.join(start.hint("merge"), "_q", "left").withColumn("_bound", bound).withColumn("_level", level)
    asks = written(asks.select("_q", "_key", "_lat", "_lng", *sides, "_bound", "_level", cell.alias("_cell")), "asks")
    around = asks.select("_level", "_cell").distinct()
    for n in "abc":
        around = around.withColumn(f"_{n}", F.explode(F.array(*[F.col("_cell")[n] + i for i in (-1, 0, 1)])))
        around = around.where((F.col(f"_{n}") >= 0) & (F.col(f"_{n}") < F.pow(F.lit(2), F.col("_level")).cast("int")))
    around = around.select("_level", F.col("_cell").alias("_center"), F.struct(*[F.col(f"_{n}").alias(n) for n in "abc"]).alias("_cell"))
    used = asks.select("_level").distinct()
    beside = near.join(F.broadcast(used)).select("_key", "_lat", "_lng", *sides, "_level", cell.alias("_cell")).join(around.hint("merge"), ["_level", "_cell"])
    beside = beside.select("_level", F.col("_center").alias("_cell"), F.struct("_key", "_lat", "_lng", *sides).alias("_t"))
    # Sizes known before these joins are those of files, before anything is multiplied: no side may be broadcast by them.
    found = asks.join(beside.hint("merge"), ["_level", "_cell"]).where(chord2(F.col("_t")) <= F.col("_bound") * F.col("_bound"))
    found = found.select("_q", F.col("_key").alias("_point"), F.col("_t._key").alias("_key"), haversine_km(F.col("_t._lat"), F.col("_t._lng"), F.col("_lat"), F.col("_lng")).alias("km"))
    rank = F.row_number().over(W.partitionBy("_q").orderBy("km", "_key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_point").alias(point_key), F.col("_key").alias(key), "km", "rank")


def unique_guard(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand in several rows, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``, or an error that names a key of several rows."""
    again = unique_guard(df, key).limit(1).collect()
    if again:
        raise ValueError(f"duplicate key: {again[0].asDict()}")
    return df


def pairwise(df: DataFrame, key: list[str], day: Column, order: list[str], previous: str, value: Column, out: str, make) -> DataFrame:
    """``out``: ``make(previous value, value)`` of each row and the one before it in its key; null where ``make`` gives null for a null."""
    rows = with_neighbours(df.withColumns({"_day": day, "_value": value}), key, "_day", order, {previous: F.col("_value")})
    return rows.withColumn(out, make(F.col(previous), F.col("_value"))).drop("_day", "_value")


def children(df: DataFrame, items: str, make: dict[str, Column], child: str = "child") -> DataFrame:
    """A row for each member of an array, with columns computed from the row and its ``child``; rows without members give none."""
    return df.withColumn(child, F.explode(items)).select(*[e.alias(n) for n, e in make.items()])
