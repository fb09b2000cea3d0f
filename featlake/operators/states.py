"""Aggregate states that are kept as tables and merged with those of other batches.

A rule makes a state from rows, merges states, and gives its value. Moments are
merged pairwise (count, mean, sum of squared deviations), so nothing cancels out;
sketches and sets are united; the first and last value go by a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A distinct sketch has 2^SKETCH_BITS registers; the relative error of a count is about 1.04 / sqrt of them.
SKETCH_BITS = 12


@dataclass(frozen=True)
class Rule:
    """``partial(*columns)`` and ``merge(state)`` are aggregates, ``finish(state)`` is an expression."""

    partial: Callable[..., Column]
    merge: Callable[[Column], Column]
    finish: Callable[[Column], Column] = lambda state: state


def _moments(x: Column) -> Column:
    x = x.cast("double")
    return F.struct(F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"))


def _joined(a: Column, b: Column) -> Column:
    """The moments of two sets of rows together."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    share = b["n"] / F.greatest(n, F.lit(1))
    return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))


def _merged_moments(state: Column) -> Column:
    """States of a key are as many as its batches."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.collect_list(state), none, _joined)


def _deviation(least: int) -> Callable[[Column], Column]:
    return lambda s: F.when(s["n"] > least, F.sqrt(s["m2"] / (s["n"] - least)))


RULES: dict[str, Rule] = {
    "sum": Rule(F.sum, F.sum), "min": Rule(F.min, F.min), "max": Rule(F.max, F.max), "count": Rule(F.count, F.sum),
    "mean": Rule(_moments, _merged_moments, lambda s: F.when(s["n"] > 0, s["mean"])), "std": Rule(_moments, _merged_moments, _deviation(0)), "std_sample": Rule(_moments, _merged_moments, _deviation(1)),
    "set": Rule(F.collect_set, lambda s: F.array_distinct(F.flatten(F.collect_list(s))), F.sort_array),
    "distinct": Rule(F.collect_set, lambda s: F.array_distinct(F.flatten(F.collect_list(s))), F.size),
    "about_distinct": Rule(lambda x: F.hll_sketch_agg(x, SKETCH_BITS), lambda s: F.hll_union_agg(s, True), F.hll_sketch_estimate),
    "first": Rule(lambda time, x: F.min(F.struct(time.alias("time"), x.alias("value"))), F.min, lambda s: s["value"]),
    "last": Rule(lambda time, x: F.max(F.struct(time.alias("time"), x.alias("value"))), F.max, lambda s: s["value"]),
}


def partial_states(df: DataFrame, keys: list[str], rules: dict[str, tuple]) -> DataFrame:
    """A state per key and rule; rules: name -> (rule, column, ...), of which ``first`` and ``last`` take a time before the column."""
    return df.groupBy(*keys).agg(*[RULES[rule].partial(*[F.col(c) for c in columns]).alias(name) for name, (rule, *columns) in rules.items()])


def merged_states(states: DataFrame, keys: list[str], rules: dict[str, tuple]) -> DataFrame:
    """One state per key of tables of states that were put together, in any number and order."""
    return states.groupBy(*keys).agg(*[RULES[rule].merge(F.col(name)).alias(name) for name, (rule, *_) in rules.items()])


def finished_states(states: DataFrame, keys: list[str], rules: dict[str, tuple]) -> DataFrame:
    return states.select(*keys, *[RULES[rule].finish(F.col(name)).alias(name) for name, (rule, *_) in rules.items()])
