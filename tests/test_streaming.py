"""Final state of streaming jobs against the batch result."""

from pyspark.sql import functions as F

from featlake.plans.streams import stream
from featlake.sources.scratch import new_path
from featlake.streaming import jobs, members


def test_host_sessions_equal_batch_runs_up_to_the_watermark(spark, sf):
    from featlake.operators import sessions
    from featlake.plans.clicks import events

    out = new_path(spark, "t")
    with members.state_store(spark):
        jobs.ingest(members.host_runs(stream(spark, sf, 2), "user_id", "ts", "event_id", "event_type", "1 minute"), out)
    got = {(r.user, r.start): (r.host, r.last, r.n) for r in spark.read.parquet(out).collect()}
    want = {(r.user, r.start): (r.host, r.last, r.n) for r in sessions.sessions(events(spark, sf)).collect()}
    assert got and set(got.items()) <= set(want.items())
    last = spark.read.parquet(out).agg(F.max("start")).first()[0]
    assert len(got) >= 0.8 * sum(1 for k in want if k[1] < last - 3 * 86_400_000_000)


def test_registered_host_sessions_equal_all_batch_runs(spark, sf):
    from featlake.operators import sessions
    from featlake.plans import QUERIES
    from featlake.plans.clicks import events

    got = sorted(tuple(r) for r in QUERIES["stream_host_sessions"](spark, sf).select("user", "start", "host", "last", "n").collect())
    assert got == sorted(tuple(r) for r in sessions.sessions(events(spark, sf)).select("user", "start", "host", "last", "n").collect())


def test_gap_sessions_are_written_once(spark, sf, monkeypatch):
    """Closed sessions leave the state with the batch that closes them, so early batches write some already, and none twice."""
    from featlake.plans import QUERIES, streams

    seen = []
    ingest = streams.J.ingest
    monkeypatch.setattr(streams.J, "ingest", lambda df, path: seen.append(path) or ingest(df, path))
    got = QUERIES["stream_gap_sessions"](spark, sf)
    assert got.count() == got.select("user", "start_us").distinct().count() > 0
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    files = spark.read.parquet(seen[0]).groupBy(F.input_file_name().alias("f")).count().count()
    assert files > 1


def test_slices_are_written_in_parallel_and_keep_rows_without_a_time(spark, sf, tmp_path, monkeypatch):
    from pyspark.sql import Window

    from featlake.plans import streams

    few = F.row_number().over(Window.orderBy("event_id")) <= 3
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("few", few)
    df.withColumn("ts", F.when(~F.col("few"), F.col("ts"))).drop("few").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 50, raising=False)
    batches = []
    rows = streams.stream(spark, str(tmp_path)).withColumn("file", F.input_file_name())
    jobs.to_batches(rows, lambda b, i: batches.append((b.count(), b.select("file").distinct().count(), b.agg(F.min("ts"), F.max("ts")).first())))
    assert sum(n for n, _, _ in batches) == df.count()
    assert len(batches) == 4 and all(files > 1 for _, files, _ in batches)
    assert all(a[2][1] < b[2][0] for a, b in zip(batches, batches[1:], strict=False))


def run(df, path, mode):
    """The rows that a query with this checkpoint gives for what is new."""
    seen = []
    with members.state_store(df.sparkSession):
        jobs.drain(df.writeStream.outputMode(mode).foreachBatch(lambda b, i: seen.extend(b.collect())).option("checkpointLocation", f"{path}/checkpoint"))
    return seen


def test_members_go_on_after_a_restart_in_whatever_order(spark, tmp_path):
    """Two runs of a query with one checkpoint; the second one gets older rows, null values and a null key."""
    schema = "k long, v double, kind string, at long, id long"
    rules = {"n": ("count",), "total": ("sum", "v"), "low": ("min", "v"), "kinds": ("counts", "kind"), "newest": ("latest", "at", "id")}
    rows = [(1, 5.0, "a", 50, 5), (1, None, "b", 40, 4), (2, None, None, 10, 1), (None, 7.0, "a", 1, 9), (1, 2.0, "a", 30, 3), (1, 9.0, None, 60, 6), (2, 1.0, "c", 5, 0), (1, 1.0, "a", None, 7)]
    got = {}
    for again, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        df = members.keyed_members(jobs.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), "k", rules, keep=2)
        got = {r.k: (r.n, r.total, r.low, r.kinds, list(r.newest)) for r in run(df, tmp_path, "update")}
        if not again:
            assert got.keys() == {1, 2, None} and got[2] == (1.0, None, None, {}, [1])
        else:
            assert got == {1: (5.0, 17.0, 1.0, {"a": 3, "b": 1}, [5, 6]), 2: (2.0, 1.0, 1.0, {"c": 1}, [0, 1])}, "only keys that changed"


def test_host_runs_wait_for_late_events_over_a_restart(spark, tmp_path):
    """Events of a run come late, in another run of the query; repeats of an event count."""
    schema = "u long, t long, e long, h string"
    read = lambda: jobs.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema).withColumn("ts", F.timestamp_seconds("t"))
    first = [(1, 1000, 1, "a"), (1, 1300, 4, "b"), (1, 1300, 4, "b"), (2, 1100, 2, "x"), (1, None, 9, "z")]
    second = [(1, 1200, 3, "a"), (2, 1150, 5, "x"), (1, 1300, None, "a"), (None, 1400, 6, None)]
    seen = []
    for part in (first, second, [(3, 100_000, 7, "end")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        seen += run(members.host_runs(read(), "u", "ts", "e", "h", "10 minutes", end=99_000_000), tmp_path, "append")
    s = 1_000_000
    assert sorted(map(tuple, seen), key=str) == sorted([(1, 1000 * s, "a", 1300 * s, 3), (1, 1300 * s, "b", 1300 * s, 2), (2, 1100 * s, "x", 1150 * s, 2), (None, 1400 * s, "", 1400 * s, 1)], key=str)


def test_state_records_do_not_grow_with_keys(spark, tmp_path):
    """Runs of 3000 users: a record for each bucket and batch in the store, none for each user or event."""
    n = 3000
    df = spark.range(n).select(F.col("id").alias("u"), F.timestamp_seconds(F.col("id") % 100 + 1000).alias("ts"), F.col("id").alias("e"), F.lit("h").alias("h"))
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    rows = members.host_runs(jobs.file_stream(spark, f"{tmp_path}/in", df.schema, 1), "u", "ts", "e", "h", "10 minutes", end=99_000_000)
    with members.state_store(spark):
        q = rows.writeStream.outputMode("append").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    kept = q.lastProgress.stateOperators[0].numRowsTotal
    assert 0 < kept <= 8 * 512 < 4 * n


def test_members_of_many_keys_are_few_records(spark, tmp_path):
    """Records of buckets, not of keys and members; keys beyond 2^53 stay whole beside a null key."""
    n, far = 3000, 1 << 60
    df = spark.range(n).select(F.when(F.col("id") > 0, F.col("id") + far).alias("k"), F.col("id").cast("double").alias("v"), F.lit("a").alias("kind"), F.col("id").alias("at"), (F.col("id") + far).alias("e"))
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    rows = members.keyed_members(jobs.file_stream(spark, f"{tmp_path}/in", df.schema, 1), "k", {"n": ("count",), "total": ("sum", "v"), "kinds": ("counts", "kind"), "newest": ("latest", "at", "e")})
    seen = []
    with members.state_store(spark):
        q = rows.writeStream.outputMode("update").foreachBatch(lambda b, i: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.k: (r.n, r.total, r.kinds, r.newest) for r in seen}
    assert got == {i + far if i else None: (1.0, float(i), {"a": 1}, [i + far]) for i in range(n)}
    assert 0 < q.lastProgress.stateOperators[0].numRowsTotal <= 4 * 513 < n
