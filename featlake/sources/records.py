"""Records of text files whose ends depend on what comes before them, read in splits.

Spark cuts files into splits at a mark (a line end, a closing brace). Whether a
mark ends a record depends on the state at its place: inside quotes or not, and
how deep in brackets. A piece between marks is a function of the state; a first
pass composes the pieces of each split, for either state that it may begin in, and
so gives the state in which every split really begins: a row per split. With
that, a second pass tells the records inside each split, and the parts of records
that cross splits, two a split at most, are put together by file. So a file of
any size is read by as many tasks as it has splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: Pieces that end a record each, from which on they are taken together.
_TOGETHER = 64

#: Parts of records: a whole one, its end, its begin, a part without either.
WHOLE, END, BEGIN, MIDDLE = range(4)
_SPLITS = "file long, block long, inside0 boolean, depth0 long, inside1 boolean, depth1 long"


def _pieces(spark: SparkSession, path: str, mark: str, state: dict[str, Column]) -> DataFrame:
    """``file``, ``block`` (where the split begins), ``value`` and the columns of ``state``, in order inside a split."""
    df = spark.read.option("lineSep", mark).text(path)
    return df.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").select("file", "block", "value", *[e.alias(n) for n, e in state.items()])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Slices of a batch of one split each."""
    file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
    cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(file)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield (int(file[a]), int(block[a])), batch.slice(a, b - a)


def _columns(part: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [part.column(c).to_numpy(zero_copy_only=False) for c in names]


_STATE = ("inside0", "depth0", "inside1", "depth1")


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function that all pieces of a split are together, of each split."""
    at, now, out = None, [], []
    for batch in batches:
        for key, part in _runs(batch):
            if key != at:
                if at is not None:
                    out.append((*at, *now))
                at, now = key, [False, 0, True, 0]
            in0, d0, in1, d1 = _columns(part, _STATE)
            for i in np.flatnonzero(in0 | ~in1 | (d0 != 0) | (d1 != 0)).tolist():  # other pieces change nothing
                for s in (0, 2):
                    inside = now[s]
                    now[s], now[s + 1] = bool(in1[i] if inside else in0[i]), now[s + 1] + int(d1[i] if inside else d0[i])
    if at is not None:
        out.append((*at, *now))
    names = ["file", "block", *_STATE]
    yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], pa.bool_() if n.startswith("inside") else pa.int64()) for i, n in enumerate(names)})


def _starts(splits: pd.DataFrame) -> pd.DataFrame:
    """The state in which each split of a file begins, and whether a record is open at its end."""
    inside, depth, out = False, 0, []
    for r in splits.sort_values("block").itertuples():
        at = (r.file, r.block, inside, depth)
        inside, depth = (r.inside1, depth + r.depth1) if inside else (r.inside0, depth + r.depth0)
        out.append((*at, bool(inside or depth > 0)))
    return pd.DataFrame(out, columns=["file", "block", "inside", "depth", "open"])


def _assembled(batches: Iterator[pa.RecordBatch], joiner: str, ending: str) -> Iterator[pa.RecordBatch]:
    """The records of each split, and what of records at its ends lies in it; blank pieces between records go."""
    at, held, inside, depth, part, fresh = None, [], False, 0, WHOLE, False
    out: list[tuple] = []

    def rest() -> None:
        if held:
            out.append((*at, BEGIN if part == WHOLE else MIDDLE, fresh, joiner.join(held)))

    def block_of(texts: pa.Array, first: bool) -> pa.RecordBatch:
        n = len(texts)
        firsts = np.arange(n) == (0 if first else -1)
        columns = [np.full(n, at[0]), np.full(n, at[1]), np.full(n, WHOLE, "int32"), firsts]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), texts.cast(pa.string())], ["file", "block", "part", "first", "text"])

    def batch_of() -> pa.RecordBatch:
        kinds = [("file", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("text", pa.string())]
        made = pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(kinds)})
        out.clear()
        return made

    for batch in batches:
        for key, piece in _runs(batch):
            if key != at:
                rest()
                at, held = key, []
                inside, depth = piece.column("inside")[0].as_py(), piece.column("depth")[0].as_py()
                part, fresh = END if inside or depth else WHOLE, key[1] == 0
            in0, d0, in1, d1 = _columns(piece, _STATE)
            changing = np.flatnonzero(in0 | ~in1 | (d0 != 0) | (d1 != 0))
            values, texts, done = piece.column("value"), piece.column("value").to_pylist(), 0
            for i, text in enumerate(texts):
                if i < done:
                    continue
                if not held and part == WHOLE:
                    if not ending:  # pieces that change nothing are records as they are
                        until = int(changing[place]) if (place := np.searchsorted(changing, i)) < len(changing) else len(texts)
                        if until - i >= _TOGETHER:
                            filled = [bool(x.strip()) for x in texts[i:until]]
                            block = values.slice(i, until - i)
                            block = block if all(filled) else block.filter(pa.array(filled))
                            if len(block):
                                yield block_of(block, fresh)
                                fresh = False
                            done = until
                            continue
                    if not text.strip():
                        continue
                depth += int(d1[i] if inside else d0[i])
                inside = bool(in1[i] if inside else in0[i])
                held.append(text + ending)
                if not inside and depth <= 0:
                    out.append((*at, part, fresh and part == WHOLE, joiner.join(held)))
                    held, part, fresh, depth = [], WHOLE, fresh and part != WHOLE, 0
        yield batch_of()
    rest()
    yield batch_of()


def _records(spark: SparkSession, path: str, mark: str, state: dict[str, Column], joiner: str, ending: str) -> DataFrame:
    """``file``, ``first`` (whether it is the first of its file) and ``text`` of all records, written once where some cross splits."""
    pieces = _pieces(spark, path, mark, state)
    splits = pieces.drop("value").mapInArrow(_composed, _SPLITS)
    starts = written(splits.groupBy("file").applyInPandas(_starts, "file long, block long, inside boolean, depth long, open boolean"), "splits")
    begun = pieces.join(F.broadcast(starts.drop("open")), ["file", "block"])  # a row per split
    parts = begun.mapInArrow(lambda batches: _assembled(batches, joiner, ending), "file long, block long, part int, first boolean, text string")
    if starts.where("open").isEmpty():  # no record crosses a split
        return parts.select("file", "first", "text")
    parts = written(parts, "records")
    crossing = parts.where(F.col("part") != WHOLE)
    order = W.partitionBy("file").orderBy("block", "part")
    crossing = crossing.withColumn("record", F.sum((F.col("part") == BEGIN).cast("int")).over(order))
    pieces_of = F.sort_array(F.collect_list(F.struct("block", "part", "text")))
    joined = crossing.groupBy("file", "record").agg(F.max("first").alias("first"), F.array_join(pieces_of["text"], joiner).alias("text"))
    return parts.where(F.col("part") == WHOLE).select("file", "first", "text").union(joined.select("file", "first", "text"))


def _quoted(sep: str) -> str:
    """A quoted value without its field's begin, and what stands behind it."""
    return rf'"(?:[^"]++|"")*+"(?=[ \t]*\r?(?:{re.escape(sep)}|$))'


def without_quoted(text: Column, sep: str) -> Column:
    """``text`` without its quoted values."""
    return F.regexp_replace(text, rf"(^|{re.escape(sep)})[ \t]*{_quoted(sep)}", "$1")


def delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Records of delimited files: a line end inside a quoted value belongs to it.

    A quote opens a value at a field's begin only, and closes it before a
    separator or line end; doubled quotes are part of the value.
    """
    value = F.col("value")
    close = rf'^(?:[^"]++|"")*+"(?=[ \t]*\r?(?:{re.escape(sep)}|$))'
    opens = lambda x: without_quoted(x, sep).rlike(rf'(^|{re.escape(sep)})[ \t]*"')
    has = value.contains('"')
    inside1 = F.when(has & value.rlike(close), opens(F.regexp_replace(value, close, " "))).otherwise(True)
    state = {"inside0": F.when(has, opens(value)).otherwise(False), "depth0": F.lit(0).cast("long"), "inside1": inside1, "depth1": F.lit(0).cast("long")}
    df = _records(spark, path, "\n", state, "\n", "")
    return df.withColumn("text", F.regexp_replace("text", r"\r$", ""))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects that follow one another, with or without blanks between them, in whatever nesting; a brace inside a string is text."""
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    odd = F.regexp_count(clean, F.lit('"')) % 2 == 1
    outside = {"0": F.regexp_replace(clean, r'(?s)"[^"]*+("|$)', ""), "1": F.regexp_replace(F.regexp_replace(clean, r'(?s)^[^"]*+("|$)', ""), r'(?s)"[^"]*+("|$)', "")}
    inside = {"0": odd, "1": ~odd}
    depth = {s: (F.regexp_count(x, F.lit(r"[\[{]")) - F.regexp_count(x, F.lit(r"\]")) - F.when(inside[s], 0).otherwise(1)).cast("long") for s, x in outside.items()}
    state = {"inside0": inside["0"], "depth0": depth["0"], "inside1": inside["1"], "depth1": depth["1"]}
    return _records(spark, path, "}", state, "", "}")
