"""Enrichment, first-match, relation and label joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import week_number
from ..sources.scratch import written
from .numbering import numbered, numbered_flags


def one_per_key(df: DataFrame, key: list[str], order: list[str], last: bool = True) -> DataFrame:
    """One row of each key, the last or first in ``order``; partial aggregation keeps hot keys apart."""
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if last else F.min_by
    row = df.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return row.select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def enrich(left: DataFrame, right: DataFrame, key: list[str], order: list[str], last: bool = True) -> DataFrame:
    """Left rows with the columns of one right row of their key, nulls if there is none. The last duplicate wins, or the first."""
    return left.join(one_per_key(right, key, order, last), key, "left")


def first_match(left: DataFrame, right: DataFrame, equal: list[str], condition: Column, left_key: list[str], order: list[str]) -> DataFrame:
    """Theta join with the first right row in ``order`` that fits any condition, which tries all rows of a key.

    Bounds on one right value need no pairs: see ``first_between``. Needs a key
    or bucket in ``equal``: a theta join over all pairs is refused.
    """
    if not equal:
        raise ValueError("a first-match join needs a column that both sides share")
    rest = [c for c in right.columns if c not in equal]
    hits = left.join(right, equal).where(condition).groupBy(*left_key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return left.join(hits, left_key, "left").select(*left.columns, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


#: Types that are compared as whole numbers, and as doubles.
_WHOLE, _FRACTIONS = ("tinyint", "smallint", "int", "bigint"), ("float", "double")
_TIMES = ("date", "timestamp", "timestamp_ntz")
#: Positions of a block of the array that intervals are looked up in, as a power of two.
BLOCK_BITS = 8


def _compared(value: T.DataType, bound: T.DataType) -> str:
    """The type in which values are compared with bounds: one that holds every value exactly."""
    v, b = value.simpleString(), bound.simpleString()
    decimals = [t for t in (value, bound) if isinstance(t, T.DecimalType)]
    if v == b:
        return v
    for kinds, kind in ((_WHOLE, "bigint"), (_FRACTIONS, "double"), (_TIMES, "timestamp")):
        if v in kinds and b in kinds:
            return kind
    if {v in _WHOLE, b in _WHOLE} == {True, False} and (v in _FRACTIONS or b in _FRACTIONS):
        return "bigint" if v in _WHOLE else "double"
    if decimals and all(isinstance(t, T.DecimalType) or t.simpleString() in _WHOLE for t in (value, bound)):
        scale = max(t.scale for t in decimals)
        if max([19 if len(decimals) == 1 else 0, *[t.precision - t.scale for t in decimals]]) + scale <= 38:
            return f"decimal(38,{scale})"
    raise TypeError(f"values of type {v} are not compared with bounds of type {b}")


def _bound(column: Column, bound: T.DataType, kind: str) -> tuple[Column, Column, Column]:
    """``edge`` (0 below all values, 2 above all, else 1), the bound in the values' type, and its sign against the bound itself."""
    b = bound.simpleString()
    if kind == "bigint" and b in _FRACTIONS:  # the whole number below
        x = column.cast("double")
        inside = (x < float(2**63)) & (x >= -float(2**63))
        whole = F.when(inside, F.floor(x))
        return F.when(x < -float(2**63), 0).when(inside, 1).otherwise(2), whole, F.when(whole.cast("double") < x, -1).otherwise(0)
    if kind == "double" and b in _WHOLE:  # the nearest double
        x = column.cast("double")
        return F.lit(1), x, F.signum(x.cast("decimal(38,0)") - column.cast("decimal(38,0)")).cast("int")
    x = column.cast(kind)
    return F.lit(1), x + F.lit(0.0) if kind == "double" else x, F.lit(0)  # of two zeros there is one


def first_between(
    left: DataFrame, right: DataFrame, equal: list[str], value: str, order: list[str], low: str | None = None, high: str | None = None, low_open: bool = False, high_open: bool = False
) -> DataFrame:
    """Left rows with the first right row of their key, in ``order``, whose ``value`` is from ``low`` to ``high`` (columns of the left; open ends exclude the bound, None is no bound); nulls if there is none.

    The right values of all keys are one sorted array, cut into ranges by key and
    value, so a hot key, also with a narrow range of values, is many ranges. A
    bound is placed in it by a sort of bounds and values together; then every
    left row asks for the least place in ``order`` in an interval of positions.
    Blocks of positions hold these places, and blocks of blocks their least
    ones, so an interval is two pieces of blocks and an interval of whole blocks,
    which is asked for a level up. No pairs are made.

    Values and bounds are compared exactly, in a type that holds every value. A
    null value, bound or key fits nothing; NaN is above all numbers. Rows that
    are equal in ``order`` may each be the first; left rows may repeat.
    """
    rest = [c for c in right.columns if c not in equal]
    bounds = [c for c in (low, high) if c]
    kinds = {_compared(right.schema[value].dataType, left.schema[c].dataType) for c in bounds} or {right.schema[value].dataType.simpleString()}
    if len(kinds) > 1:
        raise TypeError(f"bounds are compared in different types: {sorted(kinds)}")
    kind = kinds.pop()
    known = F.lit(True)
    for c in equal:
        known = known & F.col(c).isNotNull()
    asks = written(left.withColumn("_q", F.monotonically_increasing_id()), "asks")
    gives = numbered(right.where(known & F.col(value).isNotNull()), order, "_o", 0)
    n = gives.count()
    if not n:
        return asks.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in rest])

    asked = asks.where(known)
    for c in bounds:
        asked = asked.where(F.col(c).isNotNull())
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(equal)]
    names = [f"_k{i}" for i in range(len(equal))]
    x = F.col(value).cast(kind)
    rows = gives.select(*keys, F.lit(1).alias("_edge"), (x + F.lit(0.0) if kind == "double" else x).alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_q"), F.lit(None).cast("int").alias("_side"), "_o")
    for side, (column, open_) in enumerate(((low, low_open), (high, high_open))):
        # What lies before a lower bound is too small, what lies before an upper one is not too large: a bound stands before (0)
        # or behind (2) the values that equal its own place.
        if column is None:
            edge, at, behind = F.lit(2 * side), F.lit(None), F.lit(0)
        else:
            edge, at, sign = _bound(F.col(column), left.schema[column].dataType, kind)
            behind = F.when((sign < 0) | ((sign == 0) & F.lit(open_ if side == 0 else not open_)), 2).otherwise(0)
        rows = rows.union(asked.select(*keys, edge, at.cast(kind), behind, "_q", F.lit(side), F.lit(None).cast("long")))
    placed = numbered_flags(rows, [*names, "_edge", "_x", "_kind"], F.col("_kind") == 1, "_p")
    placed = written(placed.select("_q", "_side", "_o", "_p"), "placed")
    asking = placed.where("_q is not null").groupBy("_q").agg(F.max(F.when(F.col("_side") == 0, F.col("_p"))).alias("a"), F.max(F.when(F.col("_side") == 1, F.col("_p"))).alias("b")).where("a < b")
    values = placed.where("_q is null").select(F.col("_p").alias("p"), F.col("_o").alias("o"))

    size, hits = 1 << BLOCK_BITS, []
    while True:
        at = (F.col("p") % size).cast("int")
        blocks = values.groupBy(F.shiftright("p", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "o")))["o"].alias("least"))
        blocks = written(blocks, "blocks")
        first, last = F.shiftright("a", BLOCK_BITS), F.shiftright(F.col("b") - 1, BLOCK_BITS)
        piece = lambda block, begin, end: F.struct(block.alias("block"), begin.cast("int").alias("begin"), end.cast("int").alias("end"))
        begin, end = F.col("a") % size, (F.col("b") - 1) % size + 1
        pieces = F.when(first == last, F.array(piece(first, begin, end))).otherwise(F.array(piece(first, begin, F.lit(size)), piece(last, F.lit(0), end)))
        asking = written(asking.select("_q", "a", "b"), "intervals")
        found = asking.select("_q", F.inline(pieces)).join(blocks, "block")
        hits.append(found.select("_q", F.array_min(F.slice("least", F.col("begin") + 1, F.col("end") - F.col("begin"))).alias("o")))
        n = -(-n // size)
        if n <= 2:
            break
        asking = asking.where(last - first > 1).select("_q", (first + 1).alias("a"), last.alias("b"))
        values = blocks.select(F.col("block").alias("p"), F.array_min("least").alias("o"))
    best = hits[0]
    for h in hits[1:]:
        best = best.union(h)
    best = best.groupBy("_q").agg(F.min("o").alias("_o"))
    found = gives.select("_o", F.struct(*rest).alias("_row")).join(best, "_o").select("_q", "_row")
    return asks.join(found, "_q", "left").select(*left.columns, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def first_above(left: DataFrame, right: DataFrame, equal: list[str], bound: str, value: str, order: list[str]) -> DataFrame:
    """Left rows with the first right row of their key, in ``order``, whose ``value`` is above the left ``bound``; see ``first_between``."""
    return first_between(left, right, equal, value, order, low=bound, low_open=True)


def next_period_label(df: DataFrame, user: str, ts: str, pays: Column) -> DataFrame:
    """Events that are no payments, labelled 1 if their user pays in the next week; weeks whose next week has no payer are left out."""
    rows = df.withColumn("week", week_number(F.col(ts)))
    payers = rows.where(pays).select(user, (F.col("week") - 1).alias("week")).distinct().withColumn("_pays", F.lit(1))
    weeks = payers.select("week").distinct()
    out = rows.where(~pays).join(weeks, "week", "left_semi").join(payers, [user, "week"], "left")
    return out.withColumn("label", F.coalesce("_pays", F.lit(0))).drop("_pays")


def shifted_target(
    df: DataFrame, key: str, ts: str, target: str, row_id: str, before: bool = False, years: int = 0, months: int = 0, days: int = 0, hours: int = 0, seconds: int = 0
) -> DataFrame:
    """``label``: ``target`` of the key's first row at or after each row's time plus an interval, or, with ``before``, of its last row at or before that time minus it.

    Months and years are those of the calendar; a day that the month lacks is
    its last one. Of rows of one time the least id comes first. Null if there is
    no such row, no time or no key; ids may repeat.

    Rows and shifted rows are merged calendar day by day, so no range join is
    made, and rows are carried along, so that they are not joined back; one row
    per key and day carries the nearest value of the other days.
    """
    time = F.col(ts).cast("timestamp")
    interval = F.make_interval(*[F.lit(x) for x in (years, months, 0, days, hours, 0)], F.lit(seconds).cast("decimal(18,6)"))
    place = F.col(row_id)
    rec = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    asks = df.select(F.col(key).alias("_key"), F.unix_micros(time - interval if before else time + interval).alias("_at"), F.lit(1).alias("_ask"), place.alias("_id"), F.lit(None).cast(df.schema[target].dataType).alias("_value"), rec.alias("_rec"))
    gives = df.select(F.col(key).alias("_key"), F.unix_micros(time).alias("_at"), F.lit(0).alias("_ask"), place.alias("_id"), F.col(target).alias("_value"), F.lit(None).cast(asks.schema["_rec"].dataType).alias("_rec"))
    known = F.col("_at").isNotNull() & F.col("_key").isNotNull()
    rows = asks.union(gives).where(known).withColumn("_day", F.floor(F.col("_at") / 86_400_000_000))
    value = F.when(F.col("_ask") == 0, F.struct("_value"))
    # An ask comes behind the gives of its own time, and the nearest give has been seen last.
    way, pick = (F.asc, F.max_by) if before else (F.desc, F.min_by)
    inside = W.partitionBy("_key", "_day").orderBy(way("_at"), F.asc("_ask"), way("_id")).rowsBetween(W.unboundedPreceding, 0)
    per_day = rows.groupBy("_key", "_day").agg(pick(value, F.when(F.col("_ask") == 0, F.struct("_at", "_id"))).alias("_edge"))
    other = F.last("_edge", ignorenulls=True).over(W.partitionBy("_key").orderBy(way("_day")).rowsBetween(W.unboundedPreceding, -1))
    per_day = per_day.select("_key", "_day", other.alias("_other"))
    seen = rows.withColumn("_seen", F.last(value, ignorenulls=True).over(inside)).where("_ask = 1").join(per_day, ["_key", "_day"])
    out = seen.select("_rec", F.coalesce("_seen", "_other")["_value"].alias("label"))
    rest = asks.where(~known).select("_rec", F.col("_value").alias("label"))
    return out.union(rest).select("_rec.*", "label")


def related(left: DataFrame, right: DataFrame, relation: str, how: str = "inner") -> DataFrame:
    """Join by a relation between two datasets, written as ``a = b`` or ``a = b, c = d`` (columns of the left, then of the right side); right columns of the relation go."""
    pairs = [[x.strip() for x in part.split("=")] for part in relation.split(",")]
    if any(len(p) != 2 or p[0] not in left.columns or p[1] not in right.columns for p in pairs):
        raise ValueError(f"not a relation of these datasets: {relation!r}")
    side = right.withColumnsRenamed({b: f"_r_{b}" for _, b in pairs})
    same = [F.col(a) == F.col(f"_r_{b}") for a, b in pairs]
    return left.join(side, same, how).drop(*[f"_r_{b}" for _, b in pairs])
