"""Token-id output in a byte-aligned variable-length format.

Ids are replaced by their frequency ranks over the whole input, so common ids
take one byte. A rank takes 1 to 4 bytes; the lengths are held apart from the
bytes, two bits each, four to a control byte, so that decoding is one table
lookup per control byte. Blocks of whole documents, in ascending order of id,
are rows of Parquet files with the columns below; ``ranks`` beside them maps ids.

Block: ``part`` (the file's place in the order), ``first`` (tokens of the part
before the block), ``doc_ids``, ``n_tokens``, ``control``, ``data``.

Defined cases: null or empty text has the end id only; null ids come first;
rows that repeat an id lie side by side, by their first tokens; ids of
equal frequency are ranked by id; a very long text is encoded whole and lies in
one block; columns besides id and text take no part, whatever their names; an
empty table gives no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoder import crc_of_ids, encoder, runs, tokenizer_path
from .tables import forget, new_path, shuffle_partitions, written

#: A block is closed once it has this many tokens.
BLOCK_TOKENS = 1 << 17
#: For each control byte, which of the 16 bytes of four little-endian values are stored.
STORED = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3)[:, :, None] >= np.arange(4)
STORED = STORED.reshape(256, 16)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.zeros(-(-len(values) // 4) * 4, "<u4")
    v[: len(values)] = values
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return control.tobytes(), v.view(np.uint8).reshape(-1, 16)[STORED[control]].tobytes()


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    stored = STORED[np.frombuffer(control, np.uint8)]
    out = np.zeros(stored.shape, np.uint8)
    out[stored] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")[:n]


def tokenized(docs: DataFrame, key: str, text: str, path: str, end: int, chunks: str) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian, end id included) of every row, and for each task one row with ``counts``: how often it met each id, as 64-bit numbers."""
    names = ["doc_id", "ids", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end, chunks)
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in runs(batch, "text"):
                ids = enc.encode(part.column("text"))
                got = np.bincount(np.frombuffer(b"".join(ids), enc.dtype))
                longer, other = (got, total) if len(got) > len(total) else (total, got)
                longer[: len(other)] += other
                total = longer
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(work, "doc_id long, ids binary, counts binary")


def rank_table(tokens: DataFrame) -> DataFrame:
    """``id``, ``n`` and ``rank`` (0 is the most frequent), from the tasks' counts: a row per id and task at most is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("counts"):
                total = np.frombuffer(row.as_py(), "<i8")
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    counts = tokens.where("counts is not null").select("counts").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # At most a row per id of the vocabulary is numbered.
    return counts.withColumn("rank", (F.row_number().over(W.orderBy(F.desc("n"), "id")) - 1).cast("long"))


def write_blocks(docs: DataFrame, key: str, text: str, out: str, path: str, end: int, chunks: str) -> None:
    """Encode every row of ``docs`` and write ``out``/blocks and ``out``/ranks."""
    spark = docs.sparkSession
    dtype = encoder(path, end, chunks).dtype.str
    tokens = written(tokenized(docs, key, text, path, end, chunks), "tokens", compression="zstd")
    rank_table(tokens).write.parquet(f"{out}/ranks")
    id_rows = spark.read.parquet(f"{out}/ranks").select("id", "rank").collect()  # a row per id of the vocabulary at most
    rank_of = np.zeros(max([r["id"] for r in id_rows], default=0) + 1, np.uint32)
    for r in id_rows:
        rank_of[r["id"]] = r["rank"]
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, n = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            values = rank_of[np.concatenate(held)]
            control, data = pack_values(values)
            row = [[part], [first], [names], [[len(x) for x in held]], [control], [data]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for name, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                names.append(name)
                held.append(np.frombuffer(ids.as_py(), dtype))
                n += len(held[-1])
                if n >= BLOCK_TOKENS:
                    yield block()
                    first, n, names, held = first + n, 0, [], []
        if held:
            yield block()

    # Rows of one id are told apart by their first tokens and their number, so that many of them are many ranges.
    order = ["doc_id", "head", "row"]
    ordered = tokens.where("counts is null").select("doc_id", "ids", F.substring("ids", 1, 32).alias("head"), F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.mapInArrow(work, "part int, first long, doc_ids array<long>, n_tokens array<int>, control binary, data binary").write.option("compression", "none").parquet(f"{out}/blocks")
    forget(tokens)


def _from_blocks(spark: SparkSession, out: str, columns: str, made) -> DataFrame:
    """``doc_id``, ``start`` and what ``made(ids, ends)`` gives for the documents of a block, in the order of ``columns``."""
    blocks = spark.read.parquet(f"{out}/blocks")
    ranks = spark.read.parquet(f"{out}/ranks").select("id", "rank").collect()
    id_of = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    # One row per part, as many as partitions were written.
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
    base, before = {}, 0
    for part in sorted(totals):
        base[part] = before
        before += totals[part]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ends = np.concatenate([[0], np.cumsum(np.array(b["n_tokens"], np.int64))])
                ids = id_of[unpack_values(b["control"], b["data"], int(ends[-1]))]
                start = base[b["part"]] + b["first"] + ends[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(b["doc_ids"], pa.int64()), pa.array(start, pa.int64()), *made(ids, ends)], names=names)

    names = [c.split()[0] for c in f"doc_id long, start long, {columns}".split(", ")]
    return blocks.mapInArrow(work, f"doc_id long, start long, {columns}")


def read_blocks(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (array of int) of every document in the files."""
    return _from_blocks(spark, out, "ids array<int>", lambda ids, ends: [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32), pa.int32()))])


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document in the files."""

    def made(ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        crc = [crc_of_ids(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())]

    return _from_blocks(spark, out, "n_tokens long, ids_crc32 long", made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files in order of id, and a digest of what the files hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = new_path(spark, "token-files")
    write_blocks(docs, "doc_id", "text", out, tokenizer_path("byte_bpe_50k.json"), 2, "led")
    return read_digests(spark, out)
