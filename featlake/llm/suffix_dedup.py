"""Repeated byte strings across all documents, by a sorted array of suffixes.

Every string of LENGTH bytes that also starts earlier is found, and its bytes
are removed. The array is sparse: of the suffixes of a document only those at
anchors are sorted. Among the places in a string where a seed of SEED bytes
begins, the anchor is the one whose seed has the least hash (the first of equal
ones), so it follows from the string's bytes alone: equal strings have their
anchors at the same place, and what is equal is found through them. A run of
neighbouring strings with one anchor is a span.

Spans are written with their suffix's sort key: the leading bytes at the anchor
and a hash of the seed, a hash of the span, and the place. Sampled splitters
over the whole key deal them to ranges, so that a seed which a third of all
documents have is split by span and place; each range is sorted by multikey
quicksort, one word of the key at a time and only among suffixes that are equal
so far, and the last suffix of a range is compared with the first of the next.
Equal spans lie side by side, the earliest first: all strings of the others
start earlier as well. What is left are different spans with equal seeds. Their
bytes are fetched, ranged by the same key, and the strings in them are compared
at the same place around the seed, by a sort in the task that has the seed; if
a seed has more than HOT different spans, their strings are rows that are ranged,
sorted and compared across ranges as the spans were.

Strings are told apart by 128 bits: leading bytes and hashes of 64 and 32 bits.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; very
long texts are read whole, in overlapping pieces; null ids are behind all
others; rows that repeat an id are ordered by a hash of the text, and rows that
repeat id and text are one document, each with its result; columns besides id
and text take no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoder import runs
from .tables import broadcast_if_small, forget, shuffle_partitions, written

LENGTH, SEED = 100, 32
#: A seed with more different spans than this is not resolved inside one task.
HOT = 20_000
#: Suffixes of a range, and strings that a task compares at a time.
RANGE, HELD = 1_000_000, 1_000_000
#: Bytes of text that are searched for anchors at a time.
PIECE = 1 << 21
#: Ids of documents are broadcast up to this many, eight bytes each.
SMALL_IDS = 4_000_000
#: A null id is ordered as this one.
LAST = (1 << 63) - 1

_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_PLACE = np.uint64((1 << 24) - 1)


def seed_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SEED bytes from each place on, by doubling."""
    h, base, span = _TABLE[x], _BASE, 1
    while span < SEED:
        h = h[:-span] * np.uint64(base) + h[span:]
        base, span = base * base % (1 << 64), 2 * span
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def spans_of(data: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """``text``, ``lo``, ``n``, ``anchor`` and ``key`` of the spans of texts that lie one behind another in ``data``: strings [lo, lo + n) have their anchor there."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    h = seed_hashes(x)
    packed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    least = _sliding_least(packed, LENGTH - SEED + 1)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    lo = np.union1d(change, begins[begins < len(least)])
    text = np.searchsorted(begins, lo, "right") - 1
    n = np.minimum(np.append(lo[1:], len(least)), ends[text] - LENGTH + 1) - lo
    lo, text, n = lo[n > 0], text[n > 0], n[n > 0]
    anchor = (least[lo] & _PLACE).astype(np.int64)
    lead = sum(x[anchor + i].astype(np.uint64) << np.uint64(56 - 8 * i) for i in range(4))
    return text, lo, n, anchor, lead | (h[anchor] >> np.uint64(32))


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of about PIECE bytes; longer texts in pieces that overlap, so that no string is cut."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for offset in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
            held.append((i, offset, t[offset : offset + PIECE + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _texts(part: pa.RecordBatch, seen: set | None) -> tuple[list[int], list[bytes]]:
    """Rows and texts of a batch; rows that repeat id and text only once a task where ``seen`` is a set."""
    rows, texts = [], []
    for i, t in enumerate(part.column("text").to_pylist()):
        if seen is not None:
            own = (part.column("doc")[i].as_py(), part.column("tie")[i].as_py())
            if own in seen:
                continue
            seen.add(own)
        rows.append(i)
        texts.append((t or "").encode("utf-8", "surrogatepass"))
    return rows, texts


_SUFFIX = pa.schema([("w0", pa.int64()), ("w1", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("lo", pa.int32()), ("a", pa.int32()), ("n", pa.int32())])
_SUFFIX_DDL = "w0 long, w1 long, doc long, tie long, lo int, a int, n int"
_KEY = ["w0", "w1", "doc", "tie", "lo"]


def suffixes(texts: DataFrame, repeats: bool) -> DataFrame:
    """The spans of all texts (``doc``, ``tie``, ``text``) with their sort keys; ``a`` is the anchor's place in the span."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set() if repeats else None
        for batch in batches:
            for part in runs(batch, "text", PIECE):
                rows, data = _texts(part, seen)
                docs, ties = (part.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("doc", "tie"))
                for group in _pieces(data):
                    joined = b"".join(p for _, _, p in group)
                    ends = np.cumsum([len(p) for _, _, p in group])
                    begins = np.append(0, ends[:-1])
                    text, lo, n, anchor, key = spans_of(joined, begins, ends)
                    a = anchor - lo
                    w1 = [xxhash.xxh3_64_intdigest(joined[x:y], s) for x, y, s in zip(lo.tolist(), (lo + n + LENGTH - 1).tolist(), a.tolist(), strict=True)]
                    which, offset = (np.array([g[i] for g in group]) for i in (0, 1))
                    cols = [key.view(np.int64), np.array(w1, np.uint64).view(np.int64), docs[which[text]], ties[which[text]], lo - begins[text] + offset[text], a, n]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, _SUFFIX, strict=True)], schema=_SUFFIX)

    return texts.mapInArrow(work, _SUFFIX_DDL)


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of rows by ``words``; each word is looked at only where those before it are equal. Rows that are equal in all keep their order."""
    order = np.argsort(words[0], kind="stable")
    v, at = words[0][order], np.arange(len(order))
    run = np.zeros(len(order), np.int64)
    for i, word in enumerate(words):
        if i:
            v = word[order[at]]
            by = np.lexsort((v, run))
            order[at], v = order[at][by], v[by]
        fresh = np.append(True, (v[1:] != v[:-1]) | (run[1:] != run[:-1]))[: len(v)]
        run = np.cumsum(fresh) - 1
        tied = np.bincount(run, minlength=1)[run] > 1 if len(run) else np.zeros(0, bool)
        at, run = at[tied], run[tied]
        if not len(at):
            break
    return order


MARK, OPEN, EDGE = 1, 2, 3
_RUNS_DDL = f"kind int, range int, {_SUFFIX_DDL}, last0 long, last1 long"


def _same(words: list[np.ndarray]) -> np.ndarray:
    """Whether a row equals the one before it in ``words``."""
    out = np.zeros(len(words[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_and.reduce([w[1:] == w[:-1] for w in words])
    return out


def compared(rows: DataFrame) -> DataFrame:
    """What the sorted array of ``suffixes`` tells.

    MARK: a span that equals an earlier one. OPEN: the first of equal spans
    whose seed has other spans too, or may have them in the next range. EDGE: the
    first row of a range and the key of its last one, a row for each range.
    """
    schema = pa.schema([("kind", pa.int32()), ("range", pa.int32()), *_SUFFIX, ("last0", pa.int64()), ("last1", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=_SUFFIX)
        if not len(table):
            return
        cols = {c: table.column(c).to_numpy() for c in _SUFFIX.names}
        del table
        order = multikey_order([cols[c] for c in _KEY])
        cols = {c: x[order] for c, x in cols.items()}
        once = ~_same([cols[c] for c in _KEY])  # rows that repeat id and text
        cols = {c: x[once] for c, x in cols.items()}
        again = _same([cols["w0"], cols["w1"]])
        seed = np.cumsum(~_same([cols["w0"]])) - 1
        several = np.bincount(seed, ~again) > 1
        several[[0, -1]] = True  # these seeds may go on in the ranges beside this one
        number = TaskContext.get().partitionId()
        for kind, which in ((MARK, again), (OPEN, ~again & several[seed])):
            n = int(which.sum())
            plain = [np.full(n, kind, np.int32), np.full(n, number, np.int32), *[cols[c][which] for c in _SUFFIX.names], np.zeros(n, np.int64), np.zeros(n, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(plain, schema, strict=True)], schema=schema)
        edge = [EDGE, number, *[cols[c][0] for c in _SUFFIX.names], cols["w0"][-1], cols["w1"][-1]]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(edge, schema, strict=True)], schema=schema)

    n = max(shuffle_partitions(rows.sparkSession), -(-rows.count() // RANGE))
    found = written(rows.repartitionByRange(n, *_KEY).mapInArrow(work, _RUNS_DDL), "suffix-runs")
    # As many rows as there are ranges: the first span of a range may equal the last one of the range before.
    edges = found.where(F.col("kind") == EDGE)
    before = W.orderBy("range")
    late = edges.withColumns({"p0": F.lag("last0").over(before), "p1": F.lag("last1").over(before)}).where("p0 = w0 and p1 = w1")
    return found.where(F.col("kind") != EDGE).union(late.select(F.lit(MARK).alias("kind"), *found.columns[1:]))


def _ids(lists: DataFrame) -> DataFrame:
    """The documents of ``lists``, each once, with a broadcast hint if they are few: what has nothing in the lists is not shuffled then."""
    ids = written(lists.select(F.col("doc").alias("wanted")).distinct(), "documents")
    return F.broadcast(ids) if ids.count() <= SMALL_IDS else ids


def _fetched(texts: DataFrame, spans: DataFrame, repeats: bool) -> DataFrame:
    """``w0``, ``doc``, ``tie``, ``lo``, ``a``, ``n`` and the bytes of spans."""
    lists = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "a", "n", "w0")).alias("spans"))
    texts = texts.join(_ids(spans), F.col("doc") == F.col("wanted"), "left_semi")
    schema = pa.schema([("w0", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("lo", pa.int32()), ("a", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set() if repeats else None
        for batch in batches:
            for part in runs(batch, "text", PIECE):
                rows, data = _texts(part, seen)
                out = []
                for i, t in zip(rows, data, strict=True):
                    doc, tie = part.column("doc")[i].as_py(), part.column("tie")[i].as_py()
                    out += [(s["w0"], doc, tie, s["lo"], s["a"], s["n"], t[s["lo"] : s["lo"] + s["n"] + LENGTH - 1]) for s in part.column("spans")[i].as_py()]
                cols = zip(*out, strict=True) if out else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    both = texts.join(lists, ["doc", "tie"]).select("doc", "tie", "text", "spans")
    return both.mapInArrow(work, "w0 long, doc long, tie long, lo int, a int, n int, bytes binary")


def _strings(spans: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span, place of the anchor and a hash of every string in ``spans``."""
    n = np.array([s["n"] for s in spans])
    which = np.repeat(np.arange(len(spans)), n)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    hashes = [xxhash.xxh3_64_intdigest(s["bytes"][i : i + LENGTH]) for s in spans for i in range(s["n"])]
    return which, np.array([s["a"] for s in spans])[which] - inside, np.array(hashes, np.uint64)


_MARKS = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])


def _resolved(spans: DataFrame) -> DataFrame:
    """``doc``, ``tie``, ``lo`` and ``n`` of runs of strings that start earlier, of spans of which few have one seed."""

    def later(held: list[dict]) -> pa.RecordBatch:
        which, place, hashes = _strings(held)
        seed = np.cumsum([i > 0 and held[i]["w0"] != held[i - 1]["w0"] for i in range(len(held))])[which]
        words = [seed * 256 + place, hashes]
        order = multikey_order(words)  # spans come in order of place, so the first of equal strings is the earliest
        marked = np.zeros(len(order), bool)
        marked[order] = _same([w[order] for w in words])
        begins = marked & ~np.append(False, marked[:-1] & (which[1:] == which[:-1]))
        ends = marked & ~np.append(marked[1:] & (which[1:] == which[:-1]), False)
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        own = which[first]
        span_at = np.searchsorted(which, own)
        docs, ties, lows = (np.array([s[c] for s in held], np.int64)[own] for c in ("doc", "tie", "lo"))
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(ties), pa.array(lows + first - span_at).cast(pa.int32()), pa.array(last - first + 1).cast(pa.int32())], schema=_MARKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, at = 0, None
        for batch in batches:
            for s in batch.to_pylist():
                if held and (s["doc"], s["tie"], s["lo"], s["w0"]) == at:
                    continue
                if held and s["w0"] != at[3] and size >= HELD:
                    yield later(held)
                    held, size = [], 0
                at = (s["doc"], s["tie"], s["lo"], s["w0"])
                held.append(s)
                size += s["n"]
        if held:
            yield later(held)

    order = ["w0", "doc", "tie", "lo"]
    return spans.repartitionByRange(shuffle_partitions(spans.sparkSession), "w0").sortWithinPartitions(*order).mapInArrow(work, "doc long, tie long, lo int, n int")


def _as_suffixes(spans: DataFrame) -> DataFrame:
    """Every string of ``spans`` as a suffix of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                held = batch.slice(start, 1000).to_pylist()
                which, place, hashes = _strings(held)
                # The place of the anchor is part of what must be equal.
                w1 = (hashes ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
                w0, docs, ties, lows, a = (np.array([s[c] for s in held], np.int64)[which] for c in ("w0", "doc", "tie", "lo", "a"))
                cols = [w0, w1, docs, ties, lows + a - place, place, np.ones(len(which), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, _SUFFIX, strict=True)], schema=_SUFFIX)

    return spans.mapInArrow(work, _SUFFIX_DDL)


def _keyed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """``rec_id`` (the id), ``doc`` and ``tie`` (the place of a document in the order of all) and ``text``; whether ids repeat."""
    ids = docs.select(docs[key].cast("long").alias("id"))
    repeats = not ids.groupBy("id").count().where("count > 1").isEmpty()
    tie: Column = F.xxhash64(F.coalesce(docs[text], F.lit(""))) if repeats else F.lit(0)
    return docs.select(docs[key].cast("long").alias("rec_id"), F.coalesce(docs[key].cast("long"), F.lit(LAST)).alias("doc"), tie.cast("long").alias("tie"), docs[text].alias("text")), repeats


def repeated_strings(texts: DataFrame, repeats: bool, hot: int = HOT) -> DataFrame:
    """``doc``, ``tie``, ``lo`` and ``n``: strings of LENGTH bytes starting at [lo, lo + n) that also start earlier; each in one row or more."""
    rows = written(suffixes(texts.select("doc", "tie", "text"), repeats), "suffixes")
    found = compared(rows)
    marks = found.where(F.col("kind") == MARK).select("doc", "tie", "lo", "n")
    spans = written(_fetched(texts, found.where(F.col("kind") == OPEN), repeats), "spans")
    forget(rows)
    many = written(spans.groupBy("w0").agg(F.count("*").alias("spans")).where(F.col("spans") > hot).select("w0"), "hot-seeds")
    if many.isEmpty():
        return marks.union(_resolved(spans))
    many = broadcast_if_small(many)
    strings = compared(written(_as_suffixes(spans.join(many, "w0", "left_semi")), "hot-strings"))
    marks = marks.union(strings.where(F.col("kind") == MARK).select("doc", "tie", "lo", "n"))
    return marks.union(_resolved(spans.join(many, "w0", "left_anti")))


def _merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings cover."""
    out: list[tuple[int, int]] = []
    for lo, n in sorted((s["lo"], s["n"]) for s in found or []):
        end = lo + n + LENGTH - 1
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((lo, end))
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``removed`` (array of struct<begin, end>, in bytes) and ``kept`` (the bytes that stay) of every row."""
    texts, repeats = _keyed(docs, key, text)
    marks = repeated_strings(texts, repeats, hot)
    lists = written(marks.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "n")).alias("found")), "repeated-strings")
    ids = _ids(lists)
    removed = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text", PIECE):
                data = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                gone = [_merged(f) for f in part.column("found").to_pylist()]
                kept = []
                for t, own in zip(data, gone, strict=True):
                    begins = [0, *[e for _, e in own]]
                    ends = [*[b for b, _ in own], len(t)]
                    kept.append(b"".join(t[b:e] for b, e in zip(begins, ends, strict=True)) if own else t)
                spans = pa.array([[{"begin": b, "end": e} for b, e in own] for own in gone], removed)
                yield pa.RecordBatch.from_arrays([part.column("rec_id"), pa.array([len(t) for t in data], pa.int64()), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    some = texts.join(ids, F.col("doc") == F.col("wanted"), "left_semi").join(lists, ["doc", "tie"], "left").select("rec_id", "text", "found")
    some = some.mapInArrow(work, "doc_id long, n_bytes long, removed array<struct<begin:bigint,end:bigint>>, kept binary")
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rest = texts.join(ids, F.col("doc") == F.col("wanted"), "left_anti")
    return some.union(rest.select("rec_id", F.octet_length(whole).cast("long"), none, whole))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses and keeps."""
    df = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return df.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 100 bytes is a row here, which suits small tables only; bytes are pairs of hexadecimal digits.
ORACLE_SQL = r"""
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
s as (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as p from d),
w as (select doc_id, p, substr(h, 2 * p + 1, 200) as s from s),
f as (select doc_id, p, row_number() over (partition by s order by doc_id, p) > 1 as again from w),
m as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from f where again),
r as (select doc_id, p, sum(case when before is null or p > before + 100 then 1 else 0 end) over (partition by doc_id order by p) as run from m),
g as (select doc_id, run, min(p) as b, max(p) + 100 as e from r group by 1, 2),
l as (select doc_id, sum(e - b) as n_removed, count(*) as n_spans, list(b order by b) as b, list(e order by b) as e from g group by 1),
k as (select d.doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  case when b is null then h else array_to_string(list_transform(range(1, len(b) + 2), lambda i: substr(h, case when i = 1 then 1 else 2 * e[i - 1] + 1 end, case when i > len(b) then length(h) else 2 * b[i] - case when i = 1 then 0 else 2 * e[i - 1] end end)), '') end as kept
  from d left join l on d.doc_id = l.doc_id)
select doc_id, n_bytes::bigint as n_bytes, n_removed::bigint as n_removed, n_spans::bigint as n_spans, sha256(unhex(kept)) as kept_sha256 from k
"""
