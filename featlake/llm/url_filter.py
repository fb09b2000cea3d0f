"""URL allow and block rules by a sort-merge range join.

A host's labels are reversed, so ``www.example.com`` has the key com, example,
www; a rule's host covers the interval of keys that begin with its own. URLs and
rules are cut into ranges at sampled keys, a rule being copied into each range
that its interval meets, and each range is swept once in order of the key with
a stack of the rules' hosts that enclose the current key. Ranges are cut by a
short form of the key: the first HOST_CHARS characters of the reversed host, the
first PATH_CHARS of the path, and hashes of the whole URL and of the row's id,
so a hot host or URL, however long, is cut into ranges as well.

Of the rules that fit, that with the longest host and path together wins, then
that with the longer host; of equal rules a block wins. Defined cases: a null
URL or one without ``://`` has empty host and path; if no rule fits, rule is
null and the verdict is ``default``; repeated rows are judged each; very long
URLs are judged whole; extra columns are kept in ``rec``, whatever their names;
an empty table gives none; rules with a null host are ignored, a null path is
empty, A-Z in a rule's host are in lower case. Rows that agree in URL and in the
column that spreads them (``keep[0]``) are in one range.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Short keys sampled for each range, and characters of host and path in one.
SAMPLE, HOST_CHARS, PATH_CHARS = 20, 300, 100
#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


def short_key(key: Column, path: Column, spread: Column) -> Column:
    """Range key of a row: in the order of host keys up to HOST_CHARS, then of paths, then by hashes."""
    return F.concat(F.substring(key, 1, HOST_CHARS), F.lit("\0"), F.substring(path, 1, PATH_CHARS), F.lit("\0"), F.hex(F.xxhash64(key, path)), F.hex(spread))


def _bounds(keys: DataFrame, ranges: int) -> list[str]:
    """Up to ``ranges - 1`` short keys that cut the rows into about equal ranges, from a sample of ``SAMPLE`` keys for each."""
    rows = keys.count()
    share = min(1.0, SAMPLE * ranges / max(rows, 1))
    found = sorted(r["key"] for r in keys.sample(share, seed=3).limit(4 * SAMPLE * ranges).collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def judged(pages: DataFrame, keep: list[str], rules: DataFrame, default: str = "allow") -> DataFrame:
    """Columns ``keep`` as struct ``rec``, and ``host``, ``path``, ``rule``, ``verdict``. ``keep[0]`` spreads rows of one URL."""
    spark = pages.sparkSession
    host, path = parts_of(pages["url"])
    rows = pages.select(F.struct(*[pages[c] for c in keep]).alias("rec"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    short = short_key(F.col("key"), F.col("path"), F.xxhash64(f"rec.`{keep[0]}`"))
    ranges = shuffle_partitions(spark)
    bounds = _bounds(rows.select(short.alias("key")), ranges)
    kind = rows.schema["rec"].dataType
    # The mark behind a page's key puts rules of its host before it.
    rows = rows.select(F.concat("key", F.lit("\0")).alias("key"), short.alias("short"), F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("action"), "rec")
    rule_rows = rules.where("host is not null").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    key = host_key(F.col("host"))
    rule_rows = rule_rows.select(key.alias("key"), F.substring(key, 1, HOST_CHARS).alias("short"), F.lit(0).alias("kind"), "host", "path", "action", F.lit(None).cast(kind).alias("rec"))
    both = rule_rows.union(rows)
    names = both.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, at = [], []
            for i, (key, is_row) in enumerate(zip(batch.column("short").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                lo = bisect_right(bounds, key)
                hi = lo if is_row else bisect_right(bounds, key + "\U0010ffff")
                take += [i] * (hi - lo + 1)
                at += range(lo, hi + 1)
            got = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(at, pa.int32())], names=[*names, "range"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []  # of (key, host, {path: action}, lengths of paths, longest first)
        for batch in batches:
            take, out = [], []
            for i, (rng, key, is_row, host, path, action) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("range", "key", "kind", "host", "path", "action")], strict=True)):
                if rng != now:
                    now, stack = rng, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_row:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    paths = stack[-1][2]
                    if paths.get(path) != "block":
                        paths[path] = action
                    stack[-1][3][:] = sorted({len(p) for p in paths}, reverse=True)
                    continue
                best = (-1, -1, None, default)
                for _, owner, paths, lengths in stack:
                    if host == owner or host.endswith(f".{owner}"):
                        for n in lengths:
                            if (p := path[:n]) in paths:
                                best = max(best, (len(owner) + len(p), len(owner), f"{owner}{p}", paths[p]), key=lambda x: x[:2])
                                break
                take.append(i)
                out.append(best[2:])
            got = batch.take(pa.array(take, pa.int64()))
            cols = [got.column("rec"), got.column("host"), got.column("path"), *[pa.array([x[i] for x in out], pa.string()) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays(cols, names=["rec", "host", "path", "rule", "verdict"])

    dealt = both.mapInArrow(placed, f"{ddl}, range int").repartitionById(ranges, F.col("range"))
    return dealt.sortWithinPartitions("range", "key", "kind", "path").mapInArrow(sweep, f"rec {kind.simpleString()}, host string, path string, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judged(pages, ["page_id"], rules).select("rec.page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(rhost, rpath, action) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (select page_id, host, path, rhost || rpath as rule, action, row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last, length(rhost) desc) as rn
  from h left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from m where rn = 1
"""
