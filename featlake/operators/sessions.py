"""Event-order operators: previous rows, host runs, sessions.

A user's events are numbered within days; only one row per user and day crosses
days, so a user with a long history is spread over tasks. Events without a user
are one user's, events without a time are of one day before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import micros, week_start
from .numbering import join_null_safe

SECOND = 1_000_000


def ordered_events(df: DataFrame, user: str, ts: str, event: str, host: str) -> DataFrame:
    """``user``, ``at`` (microseconds), ``day``, ``event``, ``host`` and the row itself as ``rec``."""
    return df.select(F.col(user).alias("user"), micros(F.col(ts)).alias("at"), F.to_date(ts).alias("day"), F.col(event).alias("event"), F.col(host).alias("host"), F.struct("*").alias("rec"))


def walked(events: DataFrame) -> DataFrame:
    """``prev_host`` (of the user's event before) and ``run`` (number, from 1, of the row's run of equal hosts in the user's history).

    Rows are compared within days; one summary row per user and day carries the
    last host and the number of runs across days.
    """
    order = W.partitionBy("user", "day").orderBy("at", "event")
    rows = events.withColumns({"_lag": F.lag("host").over(order), "_first": F.row_number().over(order) == 1})
    rows = rows.withColumn("_turn", F.when(F.col("_first") | (F.col("host") == F.col("_lag")), 0).otherwise(1))
    at = F.struct("at", "event")
    days = rows.groupBy("user", "day").agg(F.min_by("host", at).alias("_opens"), F.max_by("host", at).alias("_last"), F.sum("_turn").alias("_turns"))
    w = W.partitionBy("user").orderBy("day")
    days = days.withColumn("_before", F.lag("_last").over(w)).withColumn("_starts", F.when(F.col("_opens") == F.col("_before"), 0).otherwise(1))
    earlier = F.coalesce(F.sum(F.col("_turns") + F.col("_starts")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.select("user", "day", "_before", (earlier + F.col("_starts")).alias("_base"))
    run = (F.sum("_turn").over(order) + F.col("_base")).cast("long")
    prev = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag"))
    return join_null_safe(rows, days, ["user", "day"]).select(*events.columns, prev.alias("prev_host"), run.alias("run"))


def with_previous(events: DataFrame) -> DataFrame:
    """``prev_host``: host of the user's previous event, over day borders too."""
    return walked(events).drop("run")


def host_runs(events: DataFrame) -> DataFrame:
    """``run``: number, from 1, of the row's run of equal hosts in the user's history."""
    return walked(events)


def sessions(events: DataFrame) -> DataFrame:
    """One row per run: host, start, last event, number of events, ``seconds`` and the neighbours' hosts.

    A session lasts until the next one starts, the user's last one until its
    last event; no length, or less, counts as one second.
    """
    runs = host_runs(events).groupBy("user", "run").agg(F.first("host").alias("host"), F.min("at").alias("start"), F.max("at").alias("last"), F.count("*").alias("n"))
    # A run also goes to the numbers beside its own, so neighbours meet by user and number, and a long history is spread.
    seen = lambda by, kind: F.struct((F.col("run") + by).alias("run"), F.lit(kind).alias("kind"), "host", "start", "last", "n")
    rows = runs.select("user", F.inline(F.array(seen(0, "own"), seen(1, "prev"), seen(-1, "next"))))
    row = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("host", "start", "last", "n")))
    runs = rows.groupBy("user", "run").agg(row("own").alias("own"), row("prev").alias("prev"), row("next").alias("next")).where("own is not null")
    runs = runs.select("user", "run", "own.*", F.col("prev.host").alias("prev_host"), F.col("next.host").alias("next_host"), F.col("prev.start").alias("_prev"), F.col("next.start").alias("_next"))
    until = F.coalesce("_next", "last") - F.col("start")
    return runs.withColumns({
        "seconds": F.when(until <= 0, F.lit(1.0)).otherwise(until / SECOND),
        "active_seconds": F.greatest(F.lit(1.0), (F.col("last") - F.col("start")) / SECOND),
        "prev_seconds": (F.col("start") - F.col("_prev")) / SECOND,
    }).drop("_prev", "_next")


def session_sets(events: DataFrame, pays: Column) -> DataFrame:
    """Per user and day: ordered sessions (starts on that day), whether an event of the day pays, and the Monday of its week."""
    s = sessions(events).withColumn("day", F.to_date(F.timestamp_micros("start")))
    sets = s.groupBy("user", "day").agg(F.sort_array(F.collect_list(F.struct("start", "host", "seconds"))).alias("sessions"))
    paid = events.groupBy("user", "day").agg(F.bool_or(pays).cast("int").alias("paying"))
    return join_null_safe(paid, sets, ["user", "day"]).withColumn("week", week_start(F.col("day")))


def between_sessions(events: DataFrame) -> DataFrame:
    """Per user: mean seconds between session starts, and 1 - x / one week of it (0 stays 0)."""
    return between_sessions_of(sessions(events))


def between_sessions_of(sessions_: DataFrame) -> DataFrame:
    """``between_sessions`` of sessions that are there."""
    s = sessions_.groupBy("user").agg(F.sum("prev_seconds").alias("total"), F.count("prev_seconds").alias("n"))
    mean = F.coalesce("total", F.lit(0.0)) / F.greatest("n", F.lit(1))
    return s.select("user", mean.alias("mean_seconds"), F.when(mean == 0, 0.0).otherwise(1 - mean / 604_800).alias("closeness"))


def running_flag(events: DataFrame, flag: Column, name: str, same_day: bool = False, include_current: bool = True) -> DataFrame:
    """1 if an event up to this one (or before it) is flagged, of the user or of the user's day."""
    order = W.partitionBy("user", "day").orderBy("at", "event")
    end = 0 if include_current else -1
    own = F.coalesce(F.max(flag.cast("int")).over(order.rowsBetween(W.unboundedPreceding, end)), F.lit(0))
    if same_day:
        return events.withColumn(name, own)
    days = events.groupBy("user", "day").agg(F.max(flag.cast("int")).alias("_f"))
    days = days.withColumn("_before", F.coalesce(F.max("_f").over(W.partitionBy("user").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_f")
    return join_null_safe(events, days, ["user", "day"]).withColumn(name, F.greatest(own, "_before")).drop("_before")
