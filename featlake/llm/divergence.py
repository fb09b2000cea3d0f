"""Divergence of sources: how far apart the term distributions of a language's sources are.

Terms are counted in every task before anything is shuffled. Each language
numbers its kept terms, the frequent ones first, and the counts of a source form
a segment tree over these numbers. The range of numbers is cut into aligned
subtrees of SPAN terms, which are priced in different tasks; a task builds the
trees of all sources of a tile over its subtree at once, level by level, and
hash-conses them: equal pairs of children are one node, so equal count subtrees
of any sources share it. Two trees are walked side by side from the root, for
all pairs of sources together; node pairs that are equal are merged into one
with its number of places, so each is visited, and at last priced, once for a
pair of sources. Prices of subtrees add up.

Smoothed shares are fixed-point numbers, p = 1 + floor(ONE * (count + 2) / (N +
2 * V)), and the price of two shares is floor((p - q)^2 / (p + q)): all sums are
exact, in any order.

Defined cases: null text, language and source count as ''; a group without
terms has p from its counts of zero; a language without kept terms has pairs
with value 0 and no terms; an only source has no pairs; ties go by the UTF-8
bytes of the item; repeated rows and ids are documents of their own; very long
texts are counted whole; columns besides text, language and source take no
part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoder import runs
from .tables import numbered, shuffle_partitions, written

#: A term is kept from this many documents of the language on.
LEAST_DOCS = 10
#: Terms of a subtree that is priced in one piece, a power of two, and sources of a tile.
SPAN, TILE = 1024, 64
#: Ranks of the terms that are told for a group.
TOP = 10
ONE = 1_000_000_000
#: ONE = STEPS[0] * STEPS[1]: quotients are taken in two steps, so counts up to 10^14 stay inside 64 bits.
STEPS = (32_000, 31_250)
#: Distinct terms that a task holds before it gives out what it has counted.
HELD = 200_000

#: Bytes of terms: letters in lower case and all bytes beyond ASCII; every other byte becomes a blank.
_FORM = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str | None, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of letters A-Z (in lower case) and of characters beyond ASCII, as UTF-8; a list for each ``piece`` bytes or so of the text."""
    form = text.encode("utf-8", "surrogatepass").translate(_FORM) if text else b""
    start = 0
    while start < len(form):
        end = form.find(b" ", start + piece)
        end = len(form) if end < 0 else end
        yield form[start:end].split()
        start = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (documents with it), a row each; a group also has a row with null term, which counts its documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], Counter] = defaultdict(Counter)
        having: dict[tuple[str, str], Counter] = defaultdict(Counter)
        sizes: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for lang_, source_ in sizes:
                counter, seen = found[lang_, source_], having[lang_, source_]
                n = len(counter)
                names = pa.array([None, *[t.decode("utf-8", "replace") for t in counter]], pa.string())
                cols = [pa.array([lang_] * (n + 1)), pa.array([source_] * (n + 1)), names, pa.array([0, *counter.values()], pa.int64()), pa.array([sizes[lang_, source_], *[seen[t] for t in counter]], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            for x in (found, having, sizes):
                x.clear()

        for batch in batches:
            for part in runs(batch, "text", 1 << 20):
                for text_, lang_, source_ in zip(*[part.column(c).to_pylist() for c in ("text", "lang", "source")], strict=True):
                    own: set[bytes] = set()
                    for words in terms(text_):
                        found[lang_, source_].update(words)
                        own.update(words)
                    having[lang_, source_].update(own)
                    sizes[lang_, source_] += 1
                if sum(map(len, found.values())) > HELD:
                    yield from out()
        yield from out()

    plain = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    rows = docs.select(docs[text].alias("text"), plain(lang).alias("lang"), plain(source).alias("source"))
    parts = rows.mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a term, exact: floor(ONE * a / b) = floor(x * ONE / STEPS[0] / b) by the quotient and rest of x = STEPS[0] * a."""
    first = (count + 2) * STEPS[0]
    of = lambda a, b: F.call_function("div", a, b)
    base = total + 2 * kept
    whole = of(first, base)
    return 1 + whole * STEPS[1] + of((first - whole * base) * STEPS[1], base)


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    first, base = (counts + 2) * STEPS[0], total + 2 * kept
    return 1 + first // base * STEPS[1] + first % base * STEPS[1] // base


class Forest:
    """Hash-consed segment trees of the rows of ``counts`` (a power of two wide; -1 where there is no term).

    ``leaves`` are the distinct counts, ``levels`` the distinct pairs of nodes
    of the level below, bottom up, and ``roots`` the node of each row.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.leaves, nodes = np.unique(counts, return_inverse=True)
        nodes = nodes.reshape(counts.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(self.leaves)
        while nodes.shape[1] > 1:
            pairs, up = np.unique(nodes[:, ::2].astype(np.int64) * n + nodes[:, 1::2], return_inverse=True)
            nodes = up.reshape(nodes.shape[0], -1)
            self.levels.append((pairs // n, pairs % n))
            n = len(pairs)
        self.roots = nodes[:, 0]

    def priced(self, a: np.ndarray, b: np.ndarray, total_a: np.ndarray, total_b: np.ndarray, kept: int) -> np.ndarray:
        """The price of each pair of rows (a, b) with these totals; equal node pairs of a pair of rows are merged at every level."""
        at, x, y, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64)
        sizes = [len(self.leaves), *[len(left) for left, _ in self.levels]]
        equal_totals = total_a == total_b
        for level in range(len(self.levels), -1, -1):
            differ = (x != y) | ~equal_totals[at]  # equal counts of equal totals have equal shares
            at, x, y, times = at[differ], x[differ], y[differ], times[differ]
            if level == 0:
                break
            left, right = self.levels[level - 1]
            n = sizes[level - 1]
            key = np.concatenate([(at * n + left[x]) * n + left[y], (at * n + right[x]) * n + right[y]])
            key, where = np.unique(key, return_inverse=True)
            times = np.bincount(where, np.concatenate([times, times]), len(key)).astype(np.int64)
            at, x, y = key // (n * n), key // n % n, key % n
        real = self.leaves[x] >= 0
        at, x, y, times = at[real], x[real], y[real], times[real]
        p, q = _shares(self.leaves[x], total_a[at], kept), _shares(self.leaves[y], total_b[at], kept)
        out = np.zeros(len(a), np.int64)
        np.add.at(out, at, (p - q) * (p - q) // (p + q) * times)
        return out


def pair_prices(vectors: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``b`` (numbers of sources, a < b) and ``value`` of subtrees.

    ``vectors``: ``lang``, ``block``, ``tile`` (two numbers), ``place`` (the
    source's number), ``total`` (its N), ``kept`` (V), and the counts that are
    not zero as ``ids`` (inside the block) and ``counts``. All sources of two
    tiles of a block are together, at most 2 * TILE rows.
    """
    schema = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])

    def unit(rows: list[dict]) -> pa.RecordBatch:
        lang, block, kept, tiles = rows[0]["lang"], rows[0]["block"], rows[0]["kept"], (rows[0]["tile_a"], rows[0]["tile_b"])
        width = min(SPAN, kept - block * SPAN)
        counts = np.full((len(rows), SPAN), -1, np.int64)
        counts[:, :width] = 0
        for i, r in enumerate(rows):
            counts[i, r["ids"]] = r["counts"]
        places, totals = np.array([r["place"] for r in rows]), np.array([r["total"] for r in rows])
        a, b = np.triu_indices(len(rows), 1)
        if tiles[0] != tiles[1]:
            across = places[a] // TILE != places[b] // TILE
            a, b = a[across], b[across]
        value = Forest(counts).priced(a, b, totals[a], totals[b], kept)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(places[a]), pa.array(places[b]), pa.array(value)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["lang"], r["tile_a"], r["tile_b"], r["block"])
                if key != at and held:
                    yield unit(held)
                    held = []
                at = key
                held.append(r)
        if held:
            yield unit(held)

    order = ["lang", "tile_a", "tile_b", "block"]
    dealt = vectors.repartition(shuffle_partitions(vectors.sparkSession), *order).sortWithinPartitions(*order, "place")
    return dealt.mapInArrow(work, "lang string, a long, b long, value long")


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``: the prices of all pairs of a language's sources, and the terms that set a source apart from its language."""
    counts = written(term_counts(docs, text, lang, source), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = numbered(kept, ["lang", F.desc("docs"), "term"], "id", 0).drop("docs")
    langs = kept.groupBy("lang").agg(F.min("id").alias("first"), F.count("*").alias("kept"), F.sum("of_lang").alias("lang_total"))
    groups = numbered(counts.where("term is null").select("lang", "source"), ["lang", "source"], "place", 0)
    langs = written(groups.groupBy("lang").agg(F.min("place").alias("first_place"), F.count("*").alias("sources")).join(langs, "lang", "left").na.fill(0), "audit-langs")
    own = counts.where("n > 0").join(kept, ["lang", "term"]).join(langs.select("lang", "first"), "lang")
    own = written(own.select("lang", "source", "term", "n", "of_lang", (F.col("id") - F.col("first")).alias("id")), "kept-counts")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    groups = written(groups.withColumn("place", F.col("place") - F.col("first_place")).drop("first", "first_place"), "audit-groups")

    # Every source has a row for each block of its language, with or without counts, and one copy for each tile it meets.
    block = F.floor(F.col("id") / SPAN)
    parts = own.groupBy("lang", "source", block.alias("block")).agg(F.collect_list(F.struct((F.col("id") % SPAN).cast("int").alias("i"), "n")).alias("c"))
    wanted = groups.where("sources > 1 and kept > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("kept") - 1) / SPAN))))
    vectors = wanted.join(parts, ["lang", "source", "block"], "left")
    tile = F.floor(F.col("place") / TILE)
    vectors = vectors.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / TILE))))
    empty = F.array().cast("array<struct<i:int,n:bigint>>")
    vectors = vectors.withColumns({"tile_a": F.least(tile, "other"), "tile_b": F.greatest(tile, "other"), "c": F.coalesce("c", empty)})
    vectors = vectors.select("lang", "block", "tile_a", "tile_b", "place", "total", "kept", F.col("c.i").alias("ids"), F.col("c.n").alias("counts"))
    prices = pair_prices(vectors).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = prices.select("lang", "a", "b", "value").union(prices.select("lang", F.col("b"), F.col("a"), "value"))
    name = lambda column, alias: groups.select("lang", F.col("place").alias(column), F.col("source").alias(alias))
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")
    # Without kept terms all pairs have the value 0.
    bare = groups.where("kept = 0").select("lang", "source")
    pairs = pairs.union(bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long")))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    marked = own.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("of_lang"), F.col("lang_total"), F.col("kept"))
    marked = marked.withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    marked = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.union(marked)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of all pairs of sources, and the terms that mark a source, in every language."""
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
g as (select distinct lang, source from d),
t as (select lang, source, r, unnest(w) as term from d),
k as (select lang, term, count(*) as c from t group by 1, 2 having count(distinct r) >= 10),
v as (select lang, count(*)::hugeint as v, sum(c)::hugeint as n from k group by 1),
c as (select lang, source, term, count(*) as c from t join k using (lang, term) group by 1, 2, 3),
n as (select lang, source, sum(c)::hugeint as n from c group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)::hugeint) // (coalesce(n.n, 0) + 2 * v.v) as p
  from g join k on k.lang = g.lang join v on v.lang = g.lang left join n on n.lang = g.lang and n.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select k.lang, k.term, 1 + (1000000000 * (k.c + 2)::hugeint) // (v.n + 2 * v.v) as q from k join v using (lang)),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source as a, y.source as b, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term group by 1, 2, 3) s
  on s.lang = a.lang and s.a = a.source and s.b = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::bigint as value from p join q using (lang, term) where p.c > 0 and p.p > q.q)
select lang, source, part, item, value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms)) where part = 'pair' or rank <= 10
"""
