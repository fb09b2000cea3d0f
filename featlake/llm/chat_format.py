"""Chat formatting with perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that
speaker as the assistant, all others as named users and ``system`` as system;
the mask covers the assistant's texts with their end marks. A rendering comes in
chunks of TURNS_PER_CHUNK turns, by the turn's rank in its conversation, so no
task holds more of a conversation in a row than a chunk; chunks joined in order
are the whole rendering.

Ranks need no window over a conversation. Turns are counted by conversation and
run of TURNS_PER_CHUNK turn numbers; sums of the counts before a run say in which
chunk it begins, and a run that lies in one chunk needs no more. Only turns of runs
that reach into another chunk (gaps, ties, null turns) are ranked: they are sorted by
ranges of (run, turn, role, text), numbered inside a range, and a row for each range
and run carries the numbers across ranges. Runs that differ from their chunk, and the
participants, are broadcast as long as they are few.

Defined cases: null text is empty; null role is a user named ``unknown`` and no
participant; null turns come first; turns with equal numbers go by role (null
first), then text; repeated rows are repeated turns; rows with null conversation
id are one conversation; one without participants gives no row, as does an empty
table. Very long texts are rendered whole; extra columns take no part, whatever
their names. Control marks inside a text are broken by a blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import broadcast_if_small, shuffle_partitions, written

TURNS_PER_CHUNK = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _head(role: Column, own: Column) -> Column:
    name = F.coalesce(role, F.lit("unknown"))
    return F.when(role == own, F.lit(f"{OPEN}assistant\n")).when(role == "system", F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rank`` (from 0) of each turn in its run."""
    order = ["run", "turn", "role", "text"]
    # Equal rows of several input partitions are in several ranges as well.
    ranged = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange(shuffle_partitions(rows.sparkSession), *order, "_from")
    placed = ranged.sortWithinPartitions(*order).drop("_from").withColumns({"_at": F.monotonically_increasing_id(), "_range": F.spark_partition_id()})
    placed = written(placed, "ranked-turns")
    ranges = placed.groupBy("run", "_range").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("run").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = broadcast_if_small(ranges.select("run", "_range", (before - F.col("_first")).alias("_shift")))
    return placed.join(ranges, ["run", "_range"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _chunked(rows: DataFrame) -> DataFrame:
    """``chunk`` of each turn, by its rank in the conversation."""
    size = F.lit(TURNS_PER_CHUNK)
    number = F.floor(F.col("turn") / TURNS_PER_CHUNK)
    # Conversation and number as one value, so that nulls are joined too.
    rows = rows.withColumn("run", F.struct("conv_id", number.alias("number")))
    runs = rows.groupBy("run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("run.conv_id").orderBy("run.number").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0)))
    first = F.floor(F.col("before") / size)
    runs = runs.select("run", "before", first.alias("first"), (F.col("before") % size + F.col("n") > size).alias("split"))
    odd = written(runs.where(F.col("split") | ~F.col("first").eqNullSafe(F.col("run.number"))), "odd-runs")
    marked = rows.join(broadcast_if_small(odd), "run", "left")
    split = F.coalesce("split", F.lit(False))
    whole = marked.where(~split).select("conv_id", "turn", "role", "text", F.coalesce("first", F.col("run.number")).alias("chunk"))
    if odd.where("split").isEmpty():
        return whole
    chunk = F.floor((F.col("before") + F.col("rank")) / size)
    return whole.union(_ranked(marked.where(split)).select("conv_id", "turn", "role", "text", chunk.alias("chunk")))


def perspectives(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``participant``, ``chunk``, ``n_turns``, ``rendered`` and ``mask`` (array of character spans from ``a`` up to ``b`` of the chunk)."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text.alias("text"))
    chunks = _chunked(rows).groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    own = rows.where("role is not null and role <> 'system'").select(F.col("conv_id").alias("own_conv"), F.col("role").alias("participant")).distinct()
    both = chunks.join(broadcast_if_small(own), F.col("conv_id").eqNullSafe(F.col("own_conv"))).drop("own_conv")
    segments = F.transform("turns", lambda t: F.struct(_head(t["role"], F.col("participant")).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), F.coalesce(t["role"] == F.col("participant"), F.lit(False)).alias("own")))
    both = both.select("conv_id", "participant", "chunk", F.size("turns").alias("n_turns"), segments.alias("segments"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        span = F.struct(a.alias("a"), b.alias("b"))
        return F.struct((b + 1).alias("at"), F.when(x["own"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    rendered = F.array_join(F.transform("segments", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    return both.select("conv_id", "participant", "chunk", "n_turns", rendered.alias("rendered"), F.aggregate("segments", start, step, lambda s: s["spans"]).alias("mask"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each participant, masks written as text."""
    df = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    mask = F.array_join(F.transform("mask", lambda x: F.concat(x["a"].cast("string"), F.lit("-"), x["b"].cast("string"))), ",")
    return df.select("conv_id", "participant", "chunk", "n_turns", "rendered", mask.alias("mask"))


ORACLE_SQL = f"""
with t as (select conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text) as rn, (rn - 1) // {TURNS_PER_CHUNK} as chunk from t),
p as (select distinct conv_id, role as participant from t where role is not null and role <> 'system'),
s as (select n.*, participant, coalesce(role = participant, false) as own,
  '{OPEN}' || case when role = participant then 'assistant' when role = 'system' then 'system' else 'user name=' || coalesce(role, 'unknown') end || chr(10) as head, text || '{CLOSE}' as body
  from n join p on n.conv_id is not distinct from p.conv_id),
o as (select *, sum(length(head) + length(body) + 1) over (partition by conv_id, participant, chunk order by rn) - length(body) - 1 as a from s)
select conv_id, participant, chunk, cast(count(*) as integer) as n_turns, string_agg(head || body || chr(10), '' order by rn) as rendered,
  coalesce(string_agg(cast(a as bigint) || '-' || cast(a + length(body) as bigint), ',' order by rn) filter (where own), '') as mask
from o group by conv_id, participant, chunk
"""
