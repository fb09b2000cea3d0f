"""Near-duplicate documents by MinHash.

Signatures of many universal hash minima are cut into bands. Texts with equal
shingle sets are one class, of which one document goes on. The members of a
bucket (equal band) are compared with the bucket's smallest id, its centre:
their signatures must agree in enough minima, then the full shingle sets decide.

Verified links to centres give components by large-star and small-star. A link
between two members of one centre matters only if they are in different
components by then, so only centres with such members are looked at again. A
member's difference to its centre (the shingles that only one of the two has)
fixes its similarity to other members: with a = 15/185, sets i and j are linked
if and only if their differences differ in at most a * (|i| + |j|) shingles. So
differences of linked members share many shingles, and one of the rarest of the
one is in the other (prefix filter, exact). Rare shingles that members of
different components share give candidate pairs across these components, whose
differences decide; what is found joins components.

So copies of one text meet each other through one of them: no pairs are made
inside a component, none is capped, and no link that joins components is left
out. Pairs across two components that share rare shingles are all compared.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing; a text of fewer than five words is one shingle; rows that repeat an id
count as one document with several texts, of which each is compared for itself; a row with null id takes its class's
component and has none if no row with an id is in the class; very long texts
are one set like others; columns besides id and text take no part, whatever
their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .encoder import runs
from .shingles import MinHash, shingles
from .tables import broadcast_if_small, shuffle_partitions, written

#: Bands of ROWS minima: a pair of similarity 0.85 shares no band with probability 4e-7.
BANDS, ROWS = 20, 4
#: Least number of equal minima of a candidate: for similarity 0.85 fewer are found with probability under 1e-6.
AGREE = 51
#: A pair is linked from intersection / union = LINK / 100 on.
LINK = 85
#: Members of a centre are verified in this many parts.
PARTS = 1024
#: A list of documents to fetch is broadcast up to this many rows (of four numbers each).
SMALL_ROWS = 200_000


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id``, ``th`` (a hash of the text), ``n_shingles``, ``fp`` (128 bits of the shingle set) and ``sig`` of every row; the last two are null without shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mh = MinHash(BANDS * ROWS)
        for batch in batches:
            for part in runs(batch, "text", 1 << 18):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                sigs = iter(mh.signatures([s for s in sets if len(s)]))
                fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sig = [next(sigs).tobytes() if len(s) else None for s in sets]
                cols = [part.column("doc_id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n_shingles", "fp", "sig"])

    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))
    return rows.mapInArrow(work, "doc_id long, th long, n_shingles long, fp binary, sig binary")


#: A pair: the centre's id and text, and the member's; a class is known by the id and text of one of its rows.
PAIR = ["centre", "centre_th", "id", "th"]


def _with_agreement(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs and whether their signatures agree in at least AGREE minima."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, BANDS * ROWS) for c in ("sig_a", "sig_b"))
            agree = pa.array((a == b).sum(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in PAIR], agree], names=[*PAIR, "agree"])

    a = reps.select(F.col("id").alias("centre"), F.col("th").alias("centre_th"), F.col("sig").alias("sig_a"))
    b = reps.select("id", "th", F.col("sig").alias("sig_b"))
    both = pairs.join(a, ["centre", "centre_th"]).join(b, ["id", "th"]).select(*PAIR, "sig_a", "sig_b")
    return both.mapInArrow(work, "centre long, centre_th long, id long, th long, agree boolean")


def _texts_once(docs: DataFrame, key: str, text: str, feats: DataFrame) -> DataFrame:
    """``need`` (the id), ``th`` and ``text``; rows that repeat id and text are one, found among the ids of several rows only."""
    texts = docs.select(docs[key].cast("long").alias("need"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text")).where("need is not null")
    several = written(feats.where("doc_id is not null").groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "ids-of-rows")
    if several.isEmpty():
        return texts
    several = broadcast_if_small(several, SMALL_ROWS)
    same = F.col("need") == F.col("again")
    once = texts.join(several, same, "left_semi").groupBy("need", "th").agg(F.min("text").alias("text"))
    return texts.join(several, same, "left_anti").unionByName(once)


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``centre`` (a hash of the centre's class), ``centre_id``, ``id``, ``linked``, ``n_centre``, ``n`` (sizes of the full sets) and ``diff`` (their difference) of the pairs.

    Texts are fetched by id and hash, one for a class; each part of a centre's
    members is sorted behind one copy of the centre's text, and a task holds one
    text at a time besides.
    """
    spark = texts.sparkSession
    group = F.xxhash64("centre", "centre_th")
    pairs = pairs.select(*PAIR, group.alias("group"), F.pmod(F.xxhash64("id", "th"), F.lit(PARTS)).cast("int").alias("part"))
    own = pairs.select(F.col("centre").alias("need"), F.col("centre_th").alias("th"), "group", "centre", "part", F.lit(0).alias("member")).distinct()
    need = written(own.union(pairs.select(F.col("id").alias("need"), "th", "group", "centre", "part", F.lit(1).alias("member"))), "need")
    need = broadcast_if_small(need, SMALL_ROWS)
    rows = texts.join(need, ["need", "th"]).repartition(shuffle_partitions(spark), "group", "part").sortWithinPartitions("group", "part", "member", "need")
    schema = pa.schema([("centre", pa.int64()), ("centre_id", pa.int64()), ("id", pa.int64()), ("linked", pa.bool_()), ("n_centre", pa.int64()), ("n", pa.int64()), ("diff", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, c = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for group_, centre, part, member, need_id, text_ in zip(*[batch.column(x).to_pylist() for x in ("group", "centre", "part", "member", "need", "text")], strict=True):
                s = shingles(text_)
                if not member:
                    at, c = (group_, part), s
                    continue
                assert (group_, part) == at, "a centre's text comes before its members"
                diff = np.setxor1d(s, c, assume_unique=True)
                linked = 100 * (len(s) + len(c) - len(diff)) >= LINK * (len(s) + len(c) + len(diff)) > 0
                for column, x in zip(out, (group_, centre, need_id, linked, len(c), len(s), diff.view(np.int64)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    ddl = "centre long, centre_id long, id long, linked boolean, n_centre long, n long, diff array<long>"
    return rows.select("group", "centre", "part", "member", "need", "text").mapInArrow(work, ddl)


def _between_members(compared: DataFrame, direct: DataFrame) -> DataFrame:
    """Links (u, v) between members of a centre that are in different components of ``direct`` (id, component)."""
    share = (100 - LINK) / (100 + LINK)
    component = F.coalesce("component", "id")
    rows = compared.withColumn("d", F.size("diff")).where("d > 0")
    slim = rows.select("centre", "id", "linked", "n", "d").join(direct, "id", "left").withColumn("component", component)
    slack = F.when(~F.col("linked"), F.col("d") - share * F.col("n"))
    groups = slim.groupBy("centre").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(slack).alias("least_slack"))
    groups = written(groups.where("lo <> hi").select("centre", "least_slack"), "open-centres")
    rows = rows.join(broadcast_if_small(groups, SMALL_ROWS), "centre").join(direct, "id", "left").withColumn("component", component)
    rows = written(rows.withColumn("row", F.xxhash64("centre", "id", "n", "diff")), "open-members")

    # How many members have a shingle, how many components they are of, and which of these has most of them.
    parts = rows.select("centre", "row", "component", F.explode("diff").alias("h"))
    lists = parts.groupBy("centre", "h", "component").agg(F.count("*").alias("n"))
    lists = lists.groupBy("centre", "h").agg(F.sum("n").alias("found"), F.count("*").alias("several"), F.max_by("component", F.struct("n", "component")).alias("main"))
    lists = written(lists.where("found > 1"), "common-shingles")
    parts = parts.join(lists, ["centre", "h"], "left").select("centre", "row", "h", F.coalesce("found", F.lit(1)).alias("found"), F.coalesce("several", F.lit(1)).alias("several"), "main")
    ranked = parts.withColumn("place", F.row_number().over(W.partitionBy("centre", "row").orderBy("found", "h"))).where("several > 1")
    ranked = ranked.join(rows.select("centre", "row", "id", "d", "n", "linked", "least_slack", "component"), ["centre", "row"])
    ranked = written(ranked.withColumn("minor", F.col("component") != F.col("main")), "common-parts")

    # Two linked members share at least this many shingles of their differences, so the first shared one, in the order
    # of ``place``, leaves as many in both.
    least = F.greatest(F.lit(1), F.ceil((F.col("d_i") + F.col("d_j") - share * (F.col("n_i") + F.col("n_j"))) / 2 - 1e-6))
    # The other member is not linked to the centre, so its slack bounds the number from below.
    least_j = F.greatest(F.lit(1), F.ceil((F.col("d") + F.col("least_slack") - share * F.col("n")) / 2 - 1e-6))
    side = lambda df, k: df.select("centre", "h", *[F.col(c).alias(f"{c}_{k}") for c in ("row", "id", "d", "n", "linked", "place", "component", "minor")])
    first = side(ranked.where(F.col("place") <= F.col("d") - least_j + 1), "j")
    whole = side(ranked.where(~F.col("linked")), "i")
    fits = (F.col("component_i") != F.col("component_j")) & (F.col("linked_j") | (F.col("row_i") < F.col("row_j")))
    fits = fits & (100 * F.least("n_i", "n_j") >= LINK * F.greatest("n_i", "n_j"))
    fits = fits & (F.col("place_i") <= F.col("d_i") - least + 1) & (F.col("place_j") <= F.col("d_j") - least + 1)
    # Of two components one is not the main one of a list, so members of the main one never meet each other.
    found = whole.where("minor_i").join(first, ["centre", "h"]).union(whole.where("not minor_i").join(first.where("minor_j"), ["centre", "h"]))
    found = found.where(fits).select("centre", F.least("row_i", "row_j").alias("a"), F.greatest("row_i", "row_j").alias("b")).distinct()
    found = written(found, "member-pairs")
    full = lambda k: rows.select("centre", F.col("row").alias(k), F.col("id").alias(f"id_{k}"), F.col("n").alias(f"n_{k}"), F.col("diff").alias(f"diff_{k}"))
    both = found.join(full("a"), ["centre", "a"]).join(full("b"), ["centre", "b"])
    apart = F.size("diff_a") + F.size("diff_b") - 2 * F.size(F.array_intersect("diff_a", "diff_b"))
    total = F.col("n_a") + F.col("n_b")
    return both.where(100 * (total - apart) >= LINK * (total + apart)).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))


def _of_repeated_ids(feats: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (u, v) between an id whose rows have different texts and the classes of these."""
    rows = feats.where("fp is not null and doc_id is not null").select("doc_id", "fp", F.xxhash64("fp").alias("f"))
    several = written(rows.groupBy("doc_id").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo <> hi").select("doc_id"), "repeated-ids")
    own = rows.join(broadcast_if_small(several, SMALL_ROWS), "doc_id").select("doc_id", "fp").distinct()
    return own.join(reps.select("fp", "id"), "fp").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` (doc_id = component_id) of every row."""
    feats = written(features(docs, key, text), "features")
    own = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), "th")))
    classes = feats.where("fp is not null").groupBy("fp").agg(own.alias("own"), F.count("*").alias("n"), F.min("sig").alias("sig"))
    reps = written(classes.where("own is not null").select("fp", "own.*", "n", "sig"), "classes")
    bands = reps.select(F.struct("id", "th").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("b"), "sig")
    bands = bands.select(F.xxhash64("b", F.expr(f"substring(sig, b * {4 * ROWS} + 1, {4 * ROWS})")).alias("bucket"), "own")
    shared = bands.groupBy("bucket").agg(F.min("own").alias("centre"), F.max("own").alias("hi")).where("centre <> hi").select("bucket", "centre")
    # Texts of one id are one document as it is.
    pairs = bands.join(written(shared, "buckets"), "bucket").where("own.id <> centre.id")
    pairs = written(pairs.select(F.col("centre.id").alias("centre"), F.col("centre.th").alias("centre_th"), "own.id", "own.th").distinct(), "pairs")
    pairs = written(_with_agreement(pairs, reps), "agreement")
    # A member whose signature does not agree with its centre's matters only to other members.
    lone = pairs.groupBy("centre", "centre_th").agg(F.count("*").alias("members")).where("members = 1").select("centre", "centre_th")
    pairs = pairs.where("agree").union(pairs.where("not agree").join(written(lone, "lone"), ["centre", "centre_th"], "left_anti").select(*PAIR, "agree")).select(*PAIR)
    compared = written(_compared(pairs, _texts_once(docs, key, text, feats)), "compared")
    links = compared.where("linked").select(F.col("id").alias("u"), F.col("centre_id").alias("v"))
    found = written(components(links.union(_of_repeated_ids(feats, reps))), "direct-components")
    between = written(_between_members(compared, found), "member-links")
    if not between.isEmpty():
        found = components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).union(between))
    own = reps.select("fp", "id", "n").join(found, "id", "left").select("fp", "n", "id", F.coalesce("component", "id").alias("component"))
    # A class of one row that is its own component needs no look-up.
    own = written(own.where("n > 1 or component <> id").select(F.col("fp").alias("class_fp"), "component"), "class-components")
    out = feats.select("doc_id", "n_shingles", "fp").join(own, F.col("fp") == F.col("class_fp"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _one_of_each(docs: DataFrame) -> DataFrame:
    """One row, the smallest, of those with equal id and equal shingle set; rows without shingles stay."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text", 1 << 18):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("rec"), pa.array(fp, pa.binary())], names=["rec", "fp"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("rec"), docs["text"].alias("text"))
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["rec"].dataType)
    rows = written(rows.mapInArrow(work, f"rec struct<{fields}>, fp binary"), "repeated-rows")
    one = rows.where("fp is not null").groupBy("rec.doc_id", "fp").agg(F.min("rec").alias("rec"))
    return one.select("rec.*").union(rows.where("fp is null").select("rec.*"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that a smaller id of their component stands for, and without exact copies under one id; rows with a null id stay."""
    gone = written(near_duplicates(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct(), "duplicates")
    gone = broadcast_if_small(gone, 5 * SMALL_ROWS)
    kept = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    several = written(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "several-rows")
    if several.isEmpty():
        return kept
    several = broadcast_if_small(several, 5 * SMALL_ROWS)
    again = kept.join(several, kept["doc_id"] == several["again"], "left_semi")
    return kept.join(several, kept["doc_id"] == several["again"], "left_anti").union(_one_of_each(again))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair that shares a shingle is compared, which suits small tables only.
ORACLE_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as u, b.doc_id as v, count(*) as both_ from s a join s b using (s) where a.doc_id > b.doc_id group by 1, 2),
l as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * both_ >= 85 * (a.n + b.n - both_)),
e as (select u, v from l union all select v, u from l),
r as (select doc_id as id, doc_id as c from w union select r.id, e.v from r join e on r.c = e.u),
c as (select id, min(c) as c from r group by 1)
select w.doc_id, coalesce(n, 0) as n_shingles, c as component_id, w.doc_id = c as kept from w join c on w.doc_id = c.id left join n on n.doc_id = w.doc_id
"""
