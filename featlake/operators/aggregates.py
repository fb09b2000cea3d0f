"""Grouping keys, declarative feature sets and keyed states."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import join_null_safe, numbered


def first(col: Column, *order: Column) -> Column:
    return F.min_by(col, F.struct(*order))


def last(col: Column, *order: Column) -> Column:
    return F.max_by(col, F.struct(*order))


def num_unique(col: Column) -> Column:
    return F.count_distinct(col.cast("string"))


def num_unique_many(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact distinct values of several columns per group.

    Each column is made distinct with the keys first and the counts are joined
    on the keys, so rows are not expanded once for every column.
    """
    out = None
    for c in columns:
        part = df.select(*keys, F.col(c).cast("string").alias(c)).distinct().groupBy(*keys).agg(F.count(c).alias(f"unique_{c}"))
        out = part if out is None else join_null_safe(out, part, keys)
    return out


def default_grid(ts: Column, include_year: bool = False) -> list[Column]:
    """Hour of day and day of year; years collide unless included."""
    keys = [F.hour(ts).alias("hour"), F.dayofyear(ts).alias("yearday")]
    return [F.year(ts).alias("year"), *keys] if include_year else keys


@dataclass
class FeatureSet:
    """Features over groups of a dataset, computed by one aggregation.

    ``aggregates`` are computed in the group; ``projections`` are expressions
    over their names, so an aggregate that several projections use is computed
    once. A feature named in ``targets`` keeps its name, others are ``f_i``.
    """

    keys: list[Column]
    aggregates: dict[str, Column] = field(default_factory=dict)
    projections: list[tuple[str | None, Column]] = field(default_factory=list)

    def aggregate(self, name: str, expr: Column) -> FeatureSet:
        self.aggregates[name] = expr
        return self

    def feature(self, expr: Column, target: str | None = None) -> FeatureSet:
        self.projections.append((target, expr))
        return self

    def build(self, df: DataFrame) -> DataFrame:
        """One aggregation, then the projections."""
        grouped = df.groupBy(*self.keys).agg(*[e.alias(n) for n, e in self.aggregates.items()])
        names = grouped.columns[: len(self.keys)]
        numbered = [e.alias(t or f"f_{i}") for i, (t, e) in enumerate(self.projections)]
        return grouped.select(*names, *numbered)


def feature_pairs(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Long form: key, feature name, value (double)."""
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, features, "name", "value")


def two_pass(df: DataFrame, keys: list[str], statistics: dict[str, Column], features: dict[str, Column]) -> DataFrame:
    """Statistics over the groups, then features of each row that use them."""
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in statistics.items()])
    return join_null_safe(df, stats, keys).select(*df.columns, *[e.alias(n) for n, e in features.items()])


def group_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct key combinations with a dense id from 1, in order of the keys; only the distinct keys are numbered, by ranges."""
    return numbered(df.select(*keys).distinct(), keys, "group_id").withColumn("group_id", F.col("group_id").cast("int"))


def entity_days(df: DataFrame, user: str, ts: str, items: list[str], flag: Column) -> DataFrame:
    """One row per user and calendar day: first time, events in order, and whether one is flagged."""
    return df.groupBy(user, F.to_date(ts).alias("day")).agg(
        F.min(ts).alias("noticed_date"), F.sort_array(F.collect_list(F.struct(*items))).alias("events"), F.bool_or(flag).cast("int").alias("flagged")
    )


def map_reduce(df: DataFrame, keys: dict[str, Column], values: dict[str, Column], reduce: dict[str, Column], limit: int | None = None, order: list | None = None) -> DataFrame:
    """Keyed groups whose values are collected in order and reduced by expressions over the array ``values``; the limit is on the input.

    For groups that fit a row, as those of a user's day; ``reduce_in_order``
    takes groups of any size.
    """
    rows = df.orderBy(*order).limit(limit) if limit else df
    grouped = rows.groupBy(*[e.alias(n) for n, e in keys.items()]).agg(F.sort_array(F.collect_list(F.struct(*[e.alias(n) for n, e in values.items()]))).alias("values"))
    return grouped.select(*keys, *[e.alias(n) for n, e in reduce.items()])


#: Rows of a key that are reduced at a time, and states that are merged at a time.
CHUNK, FAN = 4096, 64

Reducer = Callable[[Column, Column], Column]


def reduce_in_order(df: DataFrame, keys: dict[str, Column], values: dict[str, Column], init: Column, merge: Reducer, combine: Reducer, finish: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Keyed groups of any size, reduced in the order of ``values``.

    ``merge(state, value)`` takes a struct of ``values`` into a state that
    begins as ``init``; ``combine(earlier, later)`` joins the states of two runs of
    rows, and must give what merging all their rows gives. Rows are numbered in
    order of key and values and reduced in chunks; the states of a key's chunks
    are combined in order, some at a time, until there is one. So no row holds
    more than a chunk of a key, and a hot key is many chunks.
    """
    rows = df.select(*[e.alias(n) for n, e in keys.items()], F.struct(*[e.alias(n) for n, e in values.items()]).alias("_v"))
    rows = numbered(rows, [*keys, "_v"], "_n", 0)
    size, part = -(-rows.count() // CHUNK), F.floor(F.col("_n") / CHUNK)
    chunks = rows.groupBy(*keys, part.alias("_part")).agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    states = chunks.select(*keys, "_part", F.aggregate("_vs", init, merge).alias("_state"))
    while True:
        lists = states.groupBy(*keys, F.floor(F.col("_part") / FAN).alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_part", "_state")))["_state"].alias("_states"))
        first = F.get("_states", F.lit(0))
        states = lists.select(*keys, "_part", F.aggregate(F.slice("_states", 2, F.greatest(F.size("_states") - 1, F.lit(0))), first, combine).alias("_state"))
        size = -(-size // FAN)
        if size <= 1:
            return states.select(*keys, *[f(F.col("_state")).alias(n) for n, f in finish.items()])


def scores(df: DataFrame, category: str, value: str, score: str) -> DataFrame:
    """Meta scores: sum, true count and average of a score per category and value."""
    out = df.groupBy(category, value).agg(F.sum(score).alias("total"), F.count(score).alias("n"))
    return out.withColumn("average", F.col("total") / F.greatest(F.col("n"), F.lit(1)))


def value_sets(df: DataFrame, category: str, entity: str, value: str) -> DataFrame:
    """Sorted distinct values and their number per category and entity."""
    out = df.groupBy(category, entity).agg(F.sort_array(F.collect_set(value)).alias("members"))
    return out.withColumn("size", F.size("members"))


def merged(partials: list[DataFrame], keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Partial states of the same keys merged member by member; rules: sum, min, max."""
    out = partials[0]
    for p in partials[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*[getattr(F, rule)(c).alias(c) for c, rule in rules.items()])
