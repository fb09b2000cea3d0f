"""Benchmark items inside documents, by size-partitioned MinHash containment search.

The sketch of an item of n distinct shingles is k = n - ceil(0.8 n) + 1 of its
hashes (bottom-k MinHash), so k follows the item's size. A document that holds
0.8 of an item lacks fewer than k of its shingles, so it has at least one of
these k hashes: a contained item is retrieved with probability 1, however long
the document. Shingles that more than HOT_ITEMS items hold, as those of a common
opening, come last in the order of an item's hashes: they would only tell that a
document has the opening. An item that is made of such shingles but for fewer
than k belongs to the template that its hot shingles are; templates, which are
few, are sketched and verified as items are, from the number of shingles on that
any member needs of them, and only documents that hold the template meet its
members.

Items are partitioned by size. A partition has the least number of shingles that
a document must share with one of its items, and the greatest hash in a sketch.
A document's sketch are its hashes up to the greatest bound of the partitions
that its own number of shingles can reach, so short documents look up little.
Candidates are verified by exact containment: all shingles of the item against
all of the document.

Items under five shingles have one hash each, of any size, so the sketch of a
document that reaches them may be nearly all of its hashes.

Defined cases: null or blank texts and items have no shingles and match nothing;
texts under five words are one shingle; repeated rows are each judged; an item
that repeats an id is one item with the shingles of all its rows; null item ids
are ignored; an item at exactly the least share is found; very long texts are
read whole; columns besides id and text take no part, whatever their names;
empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import broadcast_if_small, let, shingle_hashes, words, written

#: An item is found from this share of its shingles on.
LEAST_SHARE = 0.8
#: A shingle of more items than this is the last choice for a sketch.
HOT_ITEMS = 16
#: Items and candidates are broadcast up to this many rows of a few numbers.
ITEM_ROWS, SMALL_ROWS = 1_000_000, 200_000


def least_shared(n: Column, least_share: float) -> Column:
    """The least number of shared shingles that is a share of ``least_share`` of ``n``."""
    return F.ceil(F.lit(least_share) * n - 1e-9)


def _hashes(text: Column) -> Column:
    return shingle_hashes(words(F.lower(text)))


def item_table(items: DataFrame, key: str, text: str, least_share: float = LEAST_SHARE) -> DataFrame:
    """A row per item and shingle: ``item_id``, ``h``, ``n`` (shingles of the item), ``part`` (its size partition), ``hot``, ``template`` (null but for items of hot shingles), ``needs`` (hot shingles that a match has at least) and ``kept`` (whether the hash is in the item's sketch)."""
    rows = items.where(items[key].isNotNull()).select(items[key].alias("item_id"), F.explode(_hashes(items[text])).alias("h")).distinct()
    held = rows.groupBy("h").agg(F.count("*").alias("held")).where(F.col("held") > HOT_ITEMS).select("h", F.lit(True).alias("hot"))
    rows = rows.join(held, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    own = W.partitionBy("item_id")
    hot = F.sort_array(F.collect_list(F.when(F.col("hot"), F.col("h"))).over(own))
    rows = rows.withColumns({"n": F.count("*").over(own), "place": F.row_number().over(own.orderBy("hot", "h")), "_hot": hot})
    least = least_shared(F.col("n"), least_share)
    k, rare = F.col("n") - least + 1, F.col("n") - F.size("_hot")
    part = F.floor(F.log2(F.col("n"))).cast("int")
    made = rare < k
    return rows.select(
        "item_id", "h", "n", part.alias("part"), "hot", F.when(made, F.xxhash64("_hot")).alias("template"), F.when(made, least - rare).alias("needs"), (~made & (F.col("place") <= k)).alias("kept")
    )


def template_table(table: DataFrame) -> DataFrame:
    """A row per template and shingle: ``template``, ``h``, ``n``, ``needs`` and ``kept``, as of items."""
    hot = table.where("template is not null and hot")
    needs = hot.groupBy("template").agg(F.min("needs").alias("needs"))
    rows = hot.select("template", "h").distinct().join(needs, "template")
    own = W.partitionBy("template")
    rows = rows.withColumns({"n": F.count("*").over(own), "place": F.row_number().over(own.orderBy("h"))})
    return rows.select("template", "h", "n", "needs", (F.col("place") <= F.col("n") - F.col("needs") + 1).alias("kept"))


def bounds(table: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """``part``, ``bound`` (the greatest hash in a sketch of the partition), ``least`` (shingles that a match shares at least) and ``items``."""
    kept = table.where("kept")
    return kept.groupBy("part").agg(F.max("h").alias("bound"), F.min(least_shared(F.col("n"), least_share)).alias("least"), F.count_distinct("item_id").alias("items"))


def _verified(rows: DataFrame, pairs: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """``doc_id``, ``row``, ``name`` and ``n_shared`` of candidate pairs (``row``, ``name``): the hashes of both are intersected."""
    sets = broadcast_if_small(written(table.groupBy(name).agg(F.collect_list("h").alias("own")), f"{name}-sets"), SMALL_ROWS)
    met = rows.join(broadcast_if_small(pairs, SMALL_ROWS), "row").withColumn("hashes", _hashes(F.col("text")))
    return met.join(sets, name).select("doc_id", "row", name, F.size(F.array_intersect("own", "hashes")).alias("n_shared"))


def matches(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least_share: float = LEAST_SHARE) -> DataFrame:
    """``doc_id``, ``row`` (hash of id and text), ``item_id``, ``n_item`` and ``n_shared`` of every item found."""
    table = written(item_table(items, item_key, item_text, least_share), "item-shingles")
    templates = written(template_table(table), "template-shingles")
    # A row per size partition: 64 at most of either kind.
    parts = [(r["least"], r["bound"]) for r in bounds(table, least_share).collect()]
    parts += [(r["least"], r["bound"]) for r in templates.where("kept").groupBy(F.floor(F.log2("needs")).alias("part")).agg(F.max("h").alias("bound"), F.min("needs").alias("least")).collect()]
    rows = docs.select(docs[key].alias("doc_id"), F.xxhash64(docs[key], docs[text]).alias("row"), docs[text].alias("text"))

    def sketch(hashes: Column) -> Column:
        """Without a partition in reach there is no bound, and nothing is looked up."""
        bound = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *[F.when(F.size(hashes) >= F.lit(least), F.lit(bound)) for least, bound in parts])
        return let(F.struct(hashes.alias("h"), bound.alias("bound")), lambda x: F.filter(x["h"], lambda v: v <= x["bound"]))

    rare = table.where("kept").select("h", "item_id", F.lit(None).cast("long").alias("template"))
    common = templates.where("kept").select("h", F.lit(None).cast(table.schema["item_id"].dataType).alias("item_id"), "template")
    sketches = broadcast_if_small(rare.union(common), ITEM_ROWS)
    found = rows.select("row", F.explode(let(_hashes(F.col("text")), sketch)).alias("h")).join(sketches, "h").select("row", "item_id", "template").distinct()
    found = written(found, "candidates")
    pairs = found.where("item_id is not null").select("row", "item_id")
    if not templates.isEmpty():
        held = _verified(rows, found.where("template is not null").select("row", "template"), templates, "template")
        held = held.join(templates.select("template", "needs").distinct(), "template").where("n_shared >= needs").select("row", "template").distinct()
        members = table.where("template is not null").select("template", "item_id").distinct()
        pairs = written(pairs.union(held.join(members, "template").select("row", "item_id")).distinct(), "candidates")
    exact = _verified(rows, pairs, table, "item_id")
    sizes = broadcast_if_small(table.select("item_id", F.col("n").alias("n_item")).distinct(), SMALL_ROWS)
    exact = exact.join(sizes, "item_id").where(F.col("n_shared") >= least_shared(F.col("n_item"), least_share))
    return exact.select("doc_id", "row", "item_id", "n_item", F.col("n_shared").cast("long").alias("n_shared")).distinct()


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents in which no item is found, with their own columns."""
    gone = written(matches(docs, "doc_id", "text", items, "item_id", "text").select("row").distinct(), "contaminated")
    gone = broadcast_if_small(gone, SMALL_ROWS)
    return docs.join(gone, F.xxhash64(docs["doc_id"], docs["text"]) == gone["row"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return matches(docs, "doc_id", "text", items, "item_id", "text").select("doc_id", "item_id", "n_item", "n_shared").distinct()


_SHINGLES = """
select distinct {id}, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
from (select {id}, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from (select {id}, list_filter(regexp_split_to_array(lower({text}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {table} where {text} is not null and {id} is not null) where len(w) > 0)
"""
ORACLE_SQL = f"""
with d as ({_SHINGLES.format(id="doc_id", text="text", table="documents")}), b as ({_SHINGLES.format(id="item_id", text="text", table="benchmark")}),
n as (select item_id, count(*) as n_item from b group by item_id)
select doc_id, item_id, n_item, count(*) as n_shared from d join b using (s) join n using (item_id)
group by doc_id, item_id, n_item having count(*) >= 0.8 * n_item
"""
