"""Keyed states of several members, and runs of hosts, kept by Spark as values and lists.

Keys are put together in buckets by their hash, and what a bucket's keys hold is
read, merged and written as columns: a call of the state store and a merge cost
much more than a row of them, so work grows with rows and not with keys and calls.
A bucket's state lies in Spark's state store, a record for each member and for each
batch of waiting events. It is checkpointed with the query: a query that is started
again, with the same number of buckets, goes on where its last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Buckets of keys, which a query's checkpoint fixes.
BUCKETS = 512
_NULL = -1  # the bucket of the null key

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their states in the store that these members need."""
    own = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, own)


def _bucket(key: str, buckets: int) -> Column:
    return F.when(F.col(key).isNull(), _NULL).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")


def _packed(df: pd.DataFrame) -> tuple[bytes]:
    table = pa.Table.from_pandas(df, preserve_index=False).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(record: tuple) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(record[0])).read_all().to_pandas()


class _Members(StatefulProcessor):
    """Rules: ``sum``, ``min``, ``max`` of numbers, ``count`` of rows, ``counts`` of values, ``latest`` (the newest values)."""

    def __init__(self, key: str, rules: dict[str, tuple], keep: int, ttl_ms: int | None) -> None:
        self.key, self.rules, self.keep, self.ttl = key, rules, keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = {n: handle.getValueState(n, "rows binary", self.ttl) for n in self.rules}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)  # the bucket's rows of one batch
        if key[0] == _NULL:
            batch["key"] = 0
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        changed = pd.Index(batch["key"].unique())
        out = {self.key: [None] * len(changed) if key[0] == _NULL else changed}
        for name, (rule, *_) in self.rules.items():
            state = self.states[name]
            old = _unpacked(state.get()) if state.exists() else None
            if old is not None and self.ttl:  # records that have not changed for so long are forgotten, as their bucket may have
                old = old[old["seen"] > now - self.ttl]
            if rule == "latest":
                new = batch.loc[batch[f"{name}_ok"], ["key", f"{name}_at", name]].set_axis(["key", "at", "v"], axis=1).assign(seen=now)
                both = (new if old is None else pd.concat([old, new])).sort_values(["key", "at", "v"]).groupby("key", sort=False).tail(self.keep)
                both = both.assign(seen=both["seen"].mask(both["key"].isin(changed), now))
                found = both[both["key"].isin(changed)].groupby("key", sort=False)["v"].agg(list).to_dict()
                out[name] = [found.get(k, []) for k in changed]
            else:
                by = ["key", name] if rule == "counts" else ["key"]
                if rule in ("count", "counts"):
                    new = batch.dropna(subset=by).groupby(by, sort=False).size().astype("int64" if rule == "counts" else "float64")
                else:
                    values = batch.groupby(by, sort=False)[name]
                    new = (values.sum(min_count=1) if rule == "sum" else values.agg(rule)).dropna()
                new = new.rename("v").reset_index().set_axis([*(["key", "k"][: len(by)]), "v"], axis=1).assign(seen=now)
                by = ["key", "k"][: len(by)]
                both = new if old is None else pd.concat([old, new]).groupby(by, sort=False).agg({"v": rule if rule in ("min", "max") else "sum", "seen": "max"}).reset_index()
                if rule == "counts":
                    found = {}
                    for k, value, n in both[both["key"].isin(changed)][["key", "k", "v"]].itertuples(index=False):
                        found.setdefault(k, {})[value] = n
                    out[name] = [found.get(k, {}) for k in changed]
                else:
                    values = both.set_index("key")["v"].reindex(changed).astype(object)
                    out[name] = values.where(values.notna(), None).to_numpy()
            if len(both):
                state.update(_packed(both))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def keyed_members(df: DataFrame, key: str, rules: dict[str, tuple], keep: int = 3, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The members of every key that changed in a batch, merged with what came before; the newest row of a key is its state.

    ``rules``: name -> (rule, column, ...); ``latest`` takes a time in
    microseconds before its column and holds the ``keep`` newest values, in
    whatever order rows arrive. With ``ttl_ms`` what has not changed for so long
    is forgotten. Rows with a null key are one key's.
    """
    kinds = {"counts": "map<string,bigint>", "latest": "array<bigint>"}
    schema = f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {kinds.get(rule, 'double')}" for n, (rule, *_) in rules.items())
    time = "processingTime" if ttl_ms else "none"
    # Whole numbers without nulls, so that pandas does not make them fractions.
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    columns = {"bucket": _bucket(key, buckets), "key": F.coalesce(F.col(key), F.lit(0).cast(df.schema[key].dataType)) if whole else F.col(key)}
    for name, (rule, *of) in rules.items():
        if rule == "latest":
            ok = F.col(of[0]).isNotNull() & F.col(of[1]).isNotNull()
            columns |= {f"{name}_ok": ok, f"{name}_at": F.when(ok, F.col(of[0])).otherwise(0).cast("long"), name: F.when(ok, F.col(of[1])).otherwise(0).cast("long")}
        elif rule != "count":
            columns[name] = F.col(of[0]).cast("string" if rule == "counts" else "double")
    rows = df.select(*[e.alias(n) for n, e in columns.items()])
    return rows.groupBy("bucket").transformWithStateInPandas(_Members(key, rules, keep, ttl_ms), schema, "Update", time)


class _HostRuns(StatefulProcessor):
    """Events wait in a list, a record for each batch, until the watermark has passed them; one timer a bucket stands at the earliest of them."""

    def __init__(self, end: int | None) -> None:
        self.end = end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getValueState("open", "rows binary")
        self.timer = handle.getValueState("timer", "ms long")

    def _stand(self, ms: int) -> None:
        if self.timer.exists():
            old = self.timer.get()[0]
            if old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([b[["user", "at", "event", "host"]] for b in rows], ignore_index=True)
        if len(batch):
            self.waiting.appendValue(_packed(batch))
            self._stand(int(batch["at"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        chunks = [_unpacked(x) for x in self.waiting.get()] if self.waiting.exists() else []
        events = pd.concat(chunks, ignore_index=True) if chunks else pd.DataFrame({"user": [], "at": [], "event": [], "host": []}).astype({"user": "int64", "at": "int64", "event": "int64"})
        late = events["at"] > mark * 1000
        ready, left = events[~late].sort_values(["user", "at", "event", "host"]), events[late]
        rows = pd.DataFrame({"user": ready["user"], "start": ready["at"], "host": ready["host"], "last": ready["at"], "n": 1, "mark": mark})
        if self.open.exists():  # a user's open run comes before what is ready
            rows = pd.concat([_unpacked(self.open.get()), rows]).sort_values("user", kind="stable")
        run = ((rows["user"] != rows["user"].shift()) | (rows["host"] != rows["host"].shift())).cumsum()
        runs = rows.groupby(run, sort=False).agg({"user": "first", "start": "first", "host": "first", "last": "last", "n": "sum", "mark": "max"})
        # A user's last run stays open, unless all that the user has was taken at an earlier watermark, or by the end.
        more = runs["user"].duplicated(keep="last")
        ended = (runs["mark"] < mark if self.end is None else pd.Series(self.end <= mark, index=runs.index)) & ~runs["user"].isin(left["user"])
        stays = runs[~more & ~ended]
        if len(left):
            self.waiting.put([_packed(left)])
            self._stand(int(left["at"].min()) // 1000 + 1)
        else:
            self.waiting.clear()
        if len(stays):
            self.open.update(_packed(stays))
            if not stays["user"].isin(left["user"]).all():
                self._stand(mark + 1 if self.end is None else self.end)
        else:
            self.open.clear()
        out = runs.loc[more | ended, ["user", "start", "host", "last", "n"]]
        yield out.assign(user=pd.Series([None] * len(out), index=out.index, dtype=object)) if key[0] == _NULL else out

    def close(self) -> None:
        pass


def host_runs(df: DataFrame, user: str, ts: str, event: str, host: str, late: str, end: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Runs of equal hosts per user, as (user, start, host, last, n) in microseconds.

    Events are taken in order of time once the watermark has passed them,
    whatever order they come in. A run is put out when another host begins, or
    when the watermark passes the user's last event; a bounded input has an
    ``end``, in milliseconds, before which no user ends, and a row at ``late`` or
    more behind it releases all that waits. Rows without a time are in no run;
    those without a number come first of their time; a null host is ''.
    """
    # Conditions on the time stay behind the watermark, so that a row that is in no run still moves it.
    rows = df.withWatermark(ts, late).where(F.col(ts).isNotNull() if end is None else F.col(ts) < F.timestamp_millis(F.lit(end)))
    number, name = F.coalesce(F.col(event), F.lit(-(1 << 63))), F.coalesce(F.col(host), F.lit(""))
    rows = rows.select(_bucket(user, buckets).alias("bucket"), F.coalesce(F.col(user).cast("long"), F.lit(0)).alias("user"), F.col(ts), F.unix_micros(ts).alias("at"), number.alias("event"), name.alias("host"))
    return rows.groupBy("bucket").transformWithStateInPandas(_HostRuns(end), "user long, start long, host string, last long, n long", "Append", "eventTime")
