"""Streaming jobs over the events table, run until the input is read; SQL gives the same final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import new_path
from ..streaming import jobs as J
from ..streaming import members as M
from .base import query, table
from .clicks import BASE


#: Rows of a file of a slice, about.
ROWS_PER_FILE = 100_000


def last_ms(spark, d) -> int:
    """Milliseconds just behind the newest event."""
    return (table(spark, d, "events").agg(F.max(F.unix_millis("ts"))).first()[0] or 0) + 1


def stream(spark, d, files: int = 4, marker: int | None = None):
    """The events, written as ``files`` slices of about as many rows one after another in order of time and read as a stream, one slice in a batch.

    A slice is written by all tasks, as one file for ``ROWS_PER_FILE`` rows of the
    smallest slice; rows without a time are in the first one.
    ``marker``: milliseconds of a row without other values that comes after them.
    """
    path = new_path(spark, "events-in")
    df = table(spark, d, "events")
    at = F.unix_micros("ts")
    bounds = df.agg(F.percentile_approx(at, [i / files for i in range(1, files)], 10_000)).first()[0] or []
    part = F.coalesce(sum(((at > b).cast("int") for b in bounds), F.lit(0)), F.lit(0))
    sizes = {r["part"]: r["n"] for r in df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    # Equal numbers of files, so that a batch is a slice: rounds over so many rows leave no file empty.
    width = max(1, min(sizes.values(), default=0) // ROWS_PER_FILE)
    for i in range(files):
        if i in sizes or not sizes:
            df.where(part == i).repartition(width).write.mode("append").parquet(path)
    if marker is not None:
        at = F.timestamp_millis(F.lit(marker))
        mark = spark.range(1).select(*[(at if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes])
        mark.coalesce(1).write.mode("append").parquet(path)
    return J.file_stream(spark, path, df.schema, width)


@query("stream_ingest", "select event_id, user_id, value from events")
def stream_ingest(spark, d):
    out = new_path(spark, "ingested")
    J.ingest(stream(spark, d).select("event_id", "user_id", "value"), out)
    return spark.read.parquet(out)


@query("stream_keyed_state", "select user_id, count(*) as n, round(sum(value), 2) as total, max(value) as top from events group by 1")
def stream_keyed_state(spark, d):
    df = J.keyed_state(stream(spark, d), ["user_id"], [F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")], new_path(spark, "state"))
    return df.withColumn("total", F.round("total", 2))


@query("stream_enrich", "select event_id, c_mktsegment from events left join customer on user_id = c_custkey")
def stream_enrich(spark, d):
    side = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    out = new_path(spark, "enriched")
    J.ingest(J.enriched(stream(spark, d), side, "user_id").select("event_id", "c_mktsegment"), out)
    return spark.read.parquet(out)


@query("stream_entity_day", "select user_id as user, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n, epoch_us(min(ts)) as noticed_us from events group by 1, 2")
def stream_entity_day(spark, d):
    path = new_path(spark, "days")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    days = J.entity_days(stream(spark, d), "user_id", "ts", "40 days").select("user", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.unix_micros("noticed_date").alias("noticed_us"))
    J.to_batches(days, write, "update")
    rows = spark.read.parquet(path)
    return rows.groupBy("user", "day").agg(F.max("n").alias("n"), F.min("noticed_us").alias("noticed_us"))


@query("stream_gap_sessions", """with g as (select user_id, ts, event_id, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id) as k from g) select user_id as user, epoch_us(min(ts)) as start_us, count(*) as n from s group by user_id, k""")
def stream_gap_sessions(spark, d):
    """Each session is written once, when the watermark has passed its end; a marker far behind the newest event closes the last ones."""
    out = new_path(spark, "sessions")
    end = last_ms(spark, d)
    rows = J.gap_sessions(stream(spark, d, marker=end + 24 * 3_600_000), "user_id", "ts", "6 hours", "1 hour").select("user", F.unix_micros("session_window.start").alias("start_us"), "n")
    J.ingest(rows.where(F.col("start_us") < end * 1000), out)
    return spark.read.parquet(out)


@query("stream_members", """with c as (select user_id, event_type, count(*) as n from events group by 1, 2), r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
select user_id, n, total, top, kinds, newest from (select user_id, cast(count(*) as double) as n, round(sum(value), 2) as total, max(value) as top from events group by 1)
join (select user_id, string_agg(event_type || '=' || n, ',' order by event_type) as kinds from c group by 1) using (user_id)
join (select user_id, string_agg(cast(event_id as varchar), ',' order by k desc) as newest from r where k <= 3 group by 1) using (user_id)""")
def stream_members(spark, d):
    """Every user's number, sum and greatest value, number of events of each type and newest events, carried from batch to batch."""
    rules = {"n": ("count",), "total": ("sum", "value"), "top": ("max", "value"), "kinds": ("counts", "event_type"), "newest": ("latest", "at", "event_id")}
    rows = stream(spark, d).select("user_id", "value", "event_type", F.unix_micros("ts").alias("at"), "event_id")
    path = new_path(spark, "members")
    with M.state_store(spark):
        J.to_batches(M.keyed_members(rows, "user_id", rules), lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/{i:08d}"), "update")
    newest = spark.read.option("recursiveFileLookup", "true").parquet(path).groupBy("user_id").agg(F.max_by(F.struct("n", "total", "top", F.map_entries("kinds").alias("kinds"), "newest"), "batch").alias("s")).select("user_id", "s.*")
    kinds = F.array_join(F.transform(F.array_sort("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return newest.select("user_id", "n", F.round("total", 2).alias("total"), "top", kinds.alias("kinds"), F.array_join("newest", ",").alias("newest"))


@query("stream_host_sessions", BASE + "select user, start, host, last, n from s")
def stream_host_sessions(spark, d):
    out = new_path(spark, "host-sessions")
    end = last_ms(spark, d)
    rows = stream(spark, d, marker=end + 2 * 3_600_000)
    with M.state_store(spark):
        J.ingest(M.host_runs(rows, "user_id", "ts", "event_id", "event_type", "1 hour", end), out)
    return spark.read.parquet(out)


@query("stream_unique", "select distinct user_id, event_type from events")
def stream_unique(spark, d):
    out = new_path(spark, "unique")
    J.ingest(J.unique_rows(stream(spark, d), ["user_id", "event_type"], "ts", "400 days").select("user_id", "event_type"), out)
    return spark.read.parquet(out)


@query("stream_fan_out", "select 'a' as sink, count(*) as n from events union all select 'b', count(*) from events where event_type = 'purchase'")
def stream_fan_out(spark, d):
    a, b = new_path(spark, "fan-a"), new_path(spark, "fan-b")
    sink = lambda path, where: lambda df, i: df.where(where).write.mode("overwrite").parquet(f"{path}/batch={i:08d}")
    J.fan_out(stream(spark, d), [sink(a, "true"), sink(b, "event_type = 'purchase'")])
    count = lambda path, name: spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(name).alias("sink"), "n")
    return count(a, "a").union(count(b, "b"))
