"""Sharding by fixed virtual slots.

Records are hashed into ``n_slots`` virtual slots, whose number never changes.
Bytes and rows are counted per slot, and a slot-to-shard map, which is a small
table with a version, says in which shard a slot lives and since which version.
The first map deals slots, largest first, to the shard with the fewest bytes.
``rebalance`` reads the newest map, edits it, writes the next version and copies
only the rows of the slots that it moved; a map's version is never written again
and readers of an older one are not disturbed. A row of the map whose slot has
moved points at the new copy, so old copies are not read.

Defined cases: null text has no bytes; a row with null key is put into a slot by
its input partition as well, so such rows are spread; a slot with far more rows
and bytes than its share, as of rows that repeat key and text, deals its rows to
all slots by their number; equal rows have positions of their own, in any order
among them; a very long text stays whole; extra columns are kept in ``rec``,
whatever their names; an empty table gives a map with empty slots and no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import new_path, shuffle_partitions, written

N_SLOTS = 8192
#: What a record takes besides its text.
OVERHEAD = 16
#: A slot is heavy from so many times its share of bytes, and of rows, on.
HEAVY = 8


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(key: list[Column], n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def slot_bytes(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per virtual slot, summed on the executors; at most one row per slot comes to the driver."""
    rows = slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r.vslot: (r.b, r.n) for r in rows}


def first_map(sizes: dict[int, tuple[int, int]], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Largest slot first, each to the shard that has the fewest bytes so far."""
    heap, out = [(0, s) for s in range(n_shards)], {}
    for v in sorted(range(n_slots), key=lambda v: (-sizes.get(v, (0, 0))[0], v)):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + sizes.get(v, (0, 0))[0], shard))
        out[v] = shard
    return out


def rebalanced(old: dict[int, int], sizes: dict[int, tuple[int, int]], n_shards: int) -> dict[int, int]:
    """``old`` edited for ``n_shards``: slots leave a shard only while it is above the mean, and go to the lightest one."""
    out, load = dict(old), dict.fromkeys(range(n_shards), 0)
    own: dict[int, list[tuple[int, int]]] = {}
    homeless = []
    for v, s in old.items():
        b = sizes.get(v, (0, 0))[0]
        if s >= n_shards:
            homeless.append((b, v))
        else:
            load[s] += b
            own.setdefault(s, []).append((b, v))
    mean = (sum(load.values()) + sum(b for b, _ in homeless)) / n_shards
    for s, slots in own.items():
        for b, v in sorted(slots):
            if b and load[s] - b >= mean:
                load[s] -= b
                homeless.append((b, v))
    heap = [(n, s) for s, n in load.items()]
    heapq.heapify(heap)
    for b, v in sorted(homeless, reverse=True):
        n, s = heap[0]
        heapq.heapreplace(heap, (n + b, s))
        out[v] = s
    return out


#: A row of a map: positions of a slot's rows in its shard begin at ``before``; bytes and rows are the slot's.
MAP = "vslot int, shard int, since int, before long, bytes long, rows long"


def _map_rows(mapping: dict[int, int], since: dict[int, int], sizes: dict[int, tuple[int, int]]) -> list[tuple]:
    before: dict[int, int] = {}
    rows = []
    for v in sorted(mapping):
        s, (b, n) = mapping[v], sizes.get(v, (0, 0))
        rows.append((v, s, since[v], before.get(s, 0), b, n))
        before[s] = before.get(s, 0) + n
    return rows


def save_map(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> None:
    """Write a version, which must not exist."""
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("error").parquet(f"{path}/map/version={version:06d}")


def newest_version(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/map").agg(F.max("version")).first()[0]


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one that is asked for."""
    version = newest_version(spark, path) if version is None else version
    return spark.read.schema(MAP).parquet(f"{path}/map/version={version:06d}")


def _dealt(mapping: dict[int, int], sizes: dict[int, tuple[int, int]], tasks: int) -> list[tuple[int, int, int]]:
    """Slot, shard and task: slots in order of shards, cut into runs of about equal bytes."""
    total, before, out = max(1, sum(b for b, _ in sizes.values())), 0, []
    for v, s in sorted(mapping.items(), key=lambda x: (x[1], x[0])):
        own = sizes.get(v, (0, 0))[0]
        out.append((v, s, min(tasks - 1, (2 * before + own) * tasks // (2 * total))))
        before += own
    return out


def _write_rows(rows: DataFrame, path: str, version: int) -> None:
    """Rows (rec, vslot, at, shard) in a folder for each version and shard; what a failed run has left there is replaced."""
    rows.select("rec", "vslot", "at", "shard").write.partitionBy("shard").mode("overwrite").parquet(f"{path}/data/since={version}")


def write_shards(docs: DataFrame, key: list[str], text: str, n_shards: int, path: str, n_slots: int = N_SLOTS) -> DataFrame:
    """Write whole records under ``path``/data and the first map under ``path``/map; return the table as read back (see ``read_shards``).

    The map has ``n_slots`` rows, so it is broadcast. Positions come from a
    window over each virtual slot.
    """
    spark = docs.sparkSession
    hashed = lambda *more: slot_of([*[docs[k] for k in key], crc_of(docs[text]), *more], n_slots).alias("vslot")
    no_key = F.lit(False)
    for k in key:
        no_key = no_key | docs[k].isNull()
    columns = [F.struct(*[docs[c] for c in docs.columns]).alias("rec"), size_of(docs[text]).alias("size")]
    slotted = docs.where(~no_key).select(*columns, hashed())
    rest = docs.where(no_key)
    if not rest.isEmpty():  # written, as both passes over them must see the same partitions
        slotted = slotted.union(written(rest.select(*columns, hashed(F.spark_partition_id())), "rows-without-key"))
    sizes = slot_bytes(slotted)
    share = [HEAVY * sum(x[i] for x in sizes.values()) / n_slots for i in (0, 1)]
    heavy = [v for v, (b, n) in sizes.items() if b > share[0] and n > share[1] + HEAVY]  # one in HEAVY of the slots at most
    if heavy:  # written, as the numbers of rows must be the same in both passes
        rows = written(slotted.where(F.col("vslot").isin(heavy)).select("rec", "size"), "heavy-slots")
        rows = rows.select("rec", "size", slot_of([F.monotonically_increasing_id()], n_slots).alias("vslot"))
        slotted = slotted.where(~F.col("vslot").isin(heavy)).union(rows)
        sizes = slot_bytes(slotted)
    mapping = first_map(sizes, n_shards, n_slots)
    save_map(spark, path, 1, _map_rows(mapping, dict.fromkeys(mapping, 1), sizes))
    tasks = shuffle_partitions(spark)
    dealt = spark.createDataFrame(_dealt(mapping, sizes, tasks), "vslot int, shard int, task int")
    # Slots in order of shards are dealt to tasks by bytes, so a task has about as many as any other, and writes few shards.
    moved = slotted.join(F.broadcast(dealt), "vslot").repartitionById(tasks, F.col("task"))
    order = W.partitionBy("task", "vslot").orderBy(*[F.col(f"rec.{k}") for k in key], crc_of(F.col(f"rec.{text}")))
    placed = moved.withColumn("at", (F.row_number().over(order) - 1).cast("long"))
    # An empty table has no file that tells its columns.
    placed.select("rec", "vslot", "at", "shard", F.lit(1).alias("since")).limit(0).write.parquet(f"{path}/columns")
    _write_rows(placed, path, 1)
    return read_shards(spark, path, 1)


def _data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/data")


def read_shards(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``rec`` (the record), ``vslot``, ``shard`` and ``slot`` (the position in the shard, from 0 without gaps) of every row, by a version of the map."""
    here = load_map(spark, path, version).select("vslot", "shard", "since", "before")
    rows = _data(spark, path).join(F.broadcast(here), ["vslot", "shard", "since"])
    return rows.select("rec", "vslot", "shard", (F.col("before") + F.col("at")).alias("slot"))


def rebalance(spark: SparkSession, path: str, n_shards: int) -> int:
    """Edit the newest map for ``n_shards`` shards, copy the rows of the slots that move, and write the next version, whose number is given back.

    The map is written last, so a run that fails leaves the old version in force.
    """
    old = newest_version(spark, path)
    rows = load_map(spark, path, old).collect()  # as many rows as there are slots
    sizes = {r["vslot"]: (r["bytes"], r["rows"]) for r in rows}
    mapping = rebalanced({r["vslot"]: r["shard"] for r in rows}, sizes, n_shards)
    version = old + 1
    since = {r["vslot"]: r["since"] if mapping[r["vslot"]] == r["shard"] else version for r in rows}
    edits = [(r["vslot"], r["shard"], r["since"], mapping[r["vslot"]]) for r in rows if since[r["vslot"]] == version]
    if edits:
        moves = spark.createDataFrame(edits, "vslot int, shard int, since int, to int")
        copied = _data(spark, path).join(F.broadcast(moves), ["vslot", "shard", "since"])
        _write_rows(copied.select("rec", "vslot", "at", F.col("to").alias("shard")), path, version)
    save_map(spark, path, version, _map_rows(mapping, since, sizes))
    return version


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near-equal bytes, as read back from the shard files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(docs, ["doc_id"], "text", 40, new_path(spark, "shards"))
    text = F.col("rec.text")
    return shards.select(
        F.col("rec.doc_id").alias("doc_id"), size_of(text).alias("size"), crc_of(text).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
