"""Packing documents into token windows by best-fit decreasing.

Documents are tokenised and cut: full windows first, then the rest. Pieces are
dealt by hash into groups of about ``DOCS_PER_GROUP`` documents; Spark sorts a
group by falling length (spilling as it needs), and one pass over it puts each
piece into the open window with the least room that takes it. The open windows
are kept in a segment tree whose leaves are remaining capacities.

The hash of a piece covers its id, place, ids and input partition, so equal rows
are spread over as many groups as partitions hold them.

Defined cases: null or empty text is the end id alone; null ids and repeated
rows are packed like others; pieces of equal length go by id, then place, then
ids; a very long text is encoded whole and cut; columns besides id and text take
no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import crc_of_ids, encoder, runs, tokenizer_path
from .tables import shuffle_partitions

WINDOW = 4096
DOCS_PER_GROUP = 1000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over the capacities, and a stack of windows at each leaf."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stack: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = 0

    def _add(self, room: int, by: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += by
            i >>= 1

    def _tightest(self, need: int) -> int | None:
        """The least remaining capacity of ``need`` or more that an open window has."""
        i = self.leaves + need
        if self.count[i]:
            return need
        while i > 1:  # the first right sibling on the way up that holds a window
            if not i & 1 and self.count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece; a new window is opened if none takes it."""
        room = self._tightest(length)
        if room is None:
            window, room = self.opened, self.capacity
            self.opened += 1
        else:
            window = self.stack[room].pop()
            self._add(room, -1)
        if room > length:
            self.stack[room - length].append(window)
            self._add(room - length, 1)
        return window, self.capacity - room


def pieces(docs: DataFrame, key: str, text: str, path: str, end: int, chunks: str, window: int = WINDOW) -> DataFrame:
    """Every document's ids, cut into full windows and a rest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end, chunks)
        width = enc.dtype.itemsize
        for batch in batches:
            for part in runs(batch, "text"):
                rows = []
                for name, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text")), strict=True):
                    n = len(ids) // width
                    rows += [(name, at, min(window, n - at), n, ids[at * width : (at + window) * width]) for at in range(0, n, window)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(work, PIECES)


def packed(docs: DataFrame, key: str, text: str, path: str, end: int, chunks: str, window: int = WINDOW, per_group: int = DOCS_PER_GROUP, digest: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; with ``digest`` the crc32 of the ids (``ids_crc32``) in place of ``ids``."""
    spark = docs.sparkSession
    groups = max(1, -(-docs.count() // per_group))
    dtype = encoder(path, end, chunks).dtype.str
    grp = F.pmod(F.xxhash64("doc_id", "start", "ids", F.spark_partition_id()), F.lit(groups))
    dealt = pieces(docs, key, text, path, end, chunks, window).withColumn("grp", grp)
    # Dealt by number, so that each task has as many groups as any other, give or take one.
    dealt = dealt.repartitionById(shuffle_partitions(spark), F.col("grp").cast("int")).sortWithinPartitions("grp", F.desc("length"), "doc_id", "start", "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_windows = None, OpenWindows(window)
        for batch in batches:
            seq, offset = [], []
            for g, n in zip(batch.column("grp").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, open_windows = g, OpenWindows(window)
                w, at = open_windows.place(n)
                seq.append(g << 32 | w)
                offset.append(at)
            ids = batch.column("ids")
            last = pa.array([crc_of_ids(np.frombuffer(x.as_py(), dtype)) for x in ids], pa.int64()) if digest else ids
            cols = [*[batch.column(c) for c in ("doc_id", "start", "length", "doc_tokens")], last, pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "doc_tokens", "ids_crc32" if digest else "ids", "sequence_id", "offset"])

    columns = PIECES.replace("ids binary", "ids_crc32 long") if digest else PIECES
    return dealt.mapInArrow(work, f"{columns}, sequence_id long, offset long")


def digest(docs: DataFrame) -> DataFrame:
    """Packed pieces of all documents, with the crc32 of their ids."""
    return packed(docs, "doc_id", "text", tokenizer_path("word_bpe_49k.json"), 2, "free", digest=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
