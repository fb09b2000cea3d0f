"""Path trees as tables of nodes, and similarity of paths.

A chain is the sites of a user's sessions on a day, in order. Every site of a
chain gives one row, its node, whose running hash stands for all sites up to it;
so a chain of n sites gives n short rows, and no chain is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nodes(sessions: DataFrame) -> DataFrame:
    """A row per session: its ``depth`` in the chain of the user's day, ``node`` and ``parent``.

    A node stands for all sites up to it: two sums of 60 bits each of the hashes
    of (depth, site), so equal prefixes have equal nodes in all chains.
    """
    w = W.partitionBy("user", "day").orderBy("run")
    day = F.to_date(F.timestamp_micros("start"))
    rows = sessions.withColumn("day", day).select("user", "day", "run", F.col("host").alias("site"), "seconds", F.row_number().over(w).alias("depth"))
    rows = rows.withColumn("_m", F.md5(F.concat_ws(":", F.col("depth").cast("string"), "site")))
    total = lambda at: F.sum(F.conv(F.substring("_m", at, 15), 16, 10).cast("decimal(20,0)")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("string")
    rows = rows.withColumn("node", F.concat_ws(":", total(1), total(16)))
    return rows.select("user", "day", F.struct("user", "day").alias("chain"), "site", "seconds", "depth", "node", F.lag("node").over(w).alias("parent"))


def tree(nodes_: DataFrame, *keys: str) -> DataFrame:
    """Visits and mean seconds of every node, and one chain that has it."""
    return nodes_.groupBy(*keys, "node", "depth").agg(
        F.min("site").alias("site"), F.min("parent").alias("parent"), F.count("*").alias("visits"), F.avg("seconds").alias("mean_seconds"), F.min("chain").alias("chain")
    )


def _key(keys: tuple[str, ...]) -> Column:
    """The keys as one value, so that null keys are joined too."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def longest(tree_: DataFrame, nodes_: DataFrame, *keys: str) -> DataFrame:
    """Deepest path, of equally deep ones the most visited, then the last in order of its text, per ``key`` (a struct of the keys).

    Only candidates are spelt out, each from a chain of its own, so their text
    is never more than that of the chains.
    """
    rows = tree_.select(_key(keys).alias("key"), "node", F.struct("depth", "visits").alias("top"), "chain")
    tops = rows.groupBy("key").agg(F.max("top").alias("top"))
    candidates = rows.join(tops, ["key", "top"])
    steps = candidates.join(nodes_.select("chain", F.struct("depth", "site").alias("step")), "chain").where(F.col("step.depth") <= F.col("top.depth"))
    spelt = steps.groupBy("key", "node", "top", "chain").agg(F.array_join(F.sort_array(F.collect_list("step"))["site"], ">").alias("prefix"))
    best = spelt.groupBy("key").agg(F.max_by(F.struct("prefix", "node", "top", "chain"), "prefix").alias("best"))
    return best.select("key", "best.prefix", "best.top.depth", "best.top.visits", "best.node", "best.chain")


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """The nodes of tree ``a`` that tree ``b`` has as well, with the visits of both."""
    return a.join(b.select("node", F.col("visits").alias("visits_b")), "node")


def longest_common(a: DataFrame, nodes_a: DataFrame, b: DataFrame) -> DataFrame:
    """The deepest path that both trees have, with the visits of both."""
    both = shared(a, b)
    best = longest(both, nodes_a)
    return best.join(both.select("node", "visits_b"), "node").select("prefix", "depth", "visits", "visits_b")


def on_longest(tree_: DataFrame, nodes_: DataFrame, weight: str, *keys: str) -> DataFrame:
    """``key`` and ``weight`` of the nodes on the longest path (one path per key)."""
    best = longest(tree_, nodes_, *keys).select("key", "chain", F.col("depth").alias("_end"))
    path = best.join(nodes_.select("chain", "depth", "node"), "chain").where(F.col("depth") <= F.col("_end")).select("key", "node")
    return path.join(tree_.select(_key(keys).alias("key"), "node", F.col(weight).alias("weight")), ["key", "node"])


def entropy(rows: DataFrame, weight: str, *keys: str) -> DataFrame:
    """Entropy of weights that are made to add up to 1: ln S - (sum of w ln w) / S, in one pass."""
    w = F.col(weight).cast("double")
    out = rows.groupBy(*keys).agg(F.sum(w).alias("_s"), F.sum(F.when(w > 0, w * F.log(w)).otherwise(0.0)).alias("_e"))
    return out.select(*keys, F.when(F.col("_s") > 0, F.log("_s") - F.col("_e") / F.col("_s")).otherwise(0.0).alias("ic"))


def lin_similarity(a: DataFrame, nodes_a: DataFrame, b: DataFrame, nodes_b: DataFrame, *keys: str, weight: str = "visits") -> DataFrame:
    """2 IC(common) / (IC(a) + IC(b)) per key of tree ``a``; 0 if undefined.

    IC is the entropy of the ``weight`` (``visits`` or ``mean_seconds``) along a
    path: the longest of each tree, and the longest that both have, with the
    weights of ``a``.
    """
    ic = lambda t, n, *k: entropy(on_longest(t, n, weight, *k), "weight", "key")
    common = a.join(b.select("node"), "node", "left_semi")
    rows = ic(a, nodes_a, *keys).withColumnRenamed("ic", "ic_a").join(ic(common, nodes_a, *keys).withColumnRenamed("ic", "ic_c"), "key", "left")
    # One row.
    rows = rows.join(F.broadcast(ic(b, nodes_b).select(F.col("ic").alias("ic_b"))), how="left")
    bottom = F.col("ic_a") + F.coalesce("ic_b", F.lit(0.0))
    return rows.select(*[F.col(f"key.{k}") for k in keys], F.when(bottom > 0, 2 * F.coalesce("ic_c", F.lit(0.0)) / bottom).otherwise(0.0).alias("similarity"))
