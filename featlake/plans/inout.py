"""Sources and sinks: what is written is read back and compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import keyed
from ..sources import readers as R
from ..sources import writers as S
from ..sources.scratch import new_path
from .base import query, table

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
NAMES = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
SQL = f"select {', '.join(NAMES)} from orders"


def orders(spark, d):
    return table(spark, d, "orders").select(*NAMES)


@query("csv_roundtrip", SQL)
def csv_roundtrip(spark, d):
    path = new_path(spark, "csv")
    S.write_csv(orders(spark, d), path, ";")
    return R.read_csv(spark, path, ";", schema=ORDERS)


@query("csv_inferred", "select o_orderkey, o_totalprice, 'a ; \"b\"' as note from orders")
def csv_inferred(spark, d):
    path = new_path(spark, "csv")
    S.write_csv(orders(spark, d).select("o_orderkey", "o_totalprice", F.lit('a ; "b"').alias("note")), path, ";")
    df = R.read_csv(spark, path, ";", sample=1.0)
    return df.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice", "note")


@query("csv_default", "select o_orderkey, o_totalprice, case when o_orderkey % 1000 = 1 then 'n/a' else cast(o_custkey as varchar) end as _cust, o_orderstatus as NoName_4 from orders")
def csv_default(spark, d):
    """Default reading: a rare value that is no number keeps its column text, names that begin like Spark's stay, empty fields without a name go."""
    path = new_path(spark, "csv")
    cust = F.when(F.col("o_orderkey") % 1000 == 1, "n/a").otherwise(F.col("o_custkey").cast("string"))
    line = F.concat_ws(";", "o_orderkey", "o_totalprice", F.concat(F.lit("'"), cust, F.lit("'")), F.lit(""), "o_orderstatus")
    rows = orders(spark, d).select(line.alias("value"))
    heads = spark.range(1).select(F.lit("o_orderkey;o_totalprice;_cust;;").alias("value"))
    # A header in each file, as in a folder of exported files.
    for i in range(2):
        heads.union(rows.where(F.col("value").isNotNull() & (F.crc32("value") % 2 == i))).coalesce(1).write.mode("append").text(path)
    return R.read_csv(spark, path)


#: Records of a file, about.
CSV_ROWS = 500_000


@query("csv_records", """select o_orderkey, 'a; "b"' || chr(10) || chr(10) || o_orderpriority || ';' as note, o_totalprice as price, case when o_orderkey % 3 = 0 then o_custkey end as NoName_3,
  case when o_orderkey % 6 = 0 then o_orderstatus end as NoName_4 from orders""")
def csv_records(spark, d):
    """Values with quotes, separators and line ends, decimal commas, and fields beyond the header."""
    path = new_path(spark, "csv")
    note = F.concat(F.lit('"a; ""b""\n\n'), "o_orderpriority", F.lit(';"'))
    more = F.when(F.col("o_orderkey") % 6 == 0, F.concat_ws(";", F.lit(""), "o_custkey", "o_orderstatus")).when(F.col("o_orderkey") % 3 == 0, F.concat_ws(";", F.lit(""), "o_custkey"))
    line = F.concat(F.concat_ws(";", "o_orderkey", note, F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), ".", ",")), F.coalesce(more, F.lit("")))
    files = table(spark, d, "orders").count() // CSV_ROWS + 1
    file = F.pmod(F.xxhash64("o_orderkey"), F.lit(files)).cast("int")
    rows = orders(spark, d).select(line.alias("value"), F.lit(1).alias("order"), "o_orderkey", file.alias("file"))
    head = spark.range(files).select(F.lit("o_orderkey;note;price").alias("value"), F.lit(0).alias("order"), F.lit(0).cast("long").alias("o_orderkey"), F.col("id").cast("int").alias("file"))
    # Every file has a header, and its rows in order.
    head.union(rows).repartitionById(files, F.col("file")).sortWithinPartitions("order", "o_orderkey").select("value").write.text(path)
    return R.read_csv(spark, path)


@query("inferred_schema", """select * from (values ('o_orderkey', 'bigint', false, null), ('o_totalprice', 'double', false, null), ('o_orderdate', 'timestamp', true, null),
  ('o_orderstatus', 'string', false, 'binary'), ('o_comment', 'string', false, 'id')) v(name, type, is_time, encoding) where (select count(*) from orders) > 0""")
def inferred_schema(spark, d):
    path = new_path(spark, "csv")
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderstatus", F.concat(F.lit("note "), "o_orderkey").alias("o_comment"))
    S.write_csv(df, path, ";")
    return R.inferred(R.read_csv(spark, path))


@query("json_roundtrip", SQL)
def json_roundtrip(spark, d):
    path = new_path(spark, "json")
    orders(spark, d).write.json(path)
    return R.read_json_lines(spark, path, ORDERS)


@query("json_payload", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_payload(spark, d):
    df = table(spark, d, "events").select(F.concat(F.lit('{"event_id": '), F.col("event_id"), F.lit(', "p": '), F.col("props"), F.lit("}")).alias("payload"))
    return R.parse_payload(df, "payload", "event_id long, p struct<k: long>").select("event_id", "p.k")


@query("csv_payload", "select c_custkey, c_acctbal from customer")
def csv_payload(spark, d):
    df = table(spark, d, "customer").select(F.concat_ws(";", "c_custkey", "c_acctbal").alias("payload"))
    return R.parse_payload(df, "payload", "c_custkey long, c_acctbal double", "csv")


#: Objects of a text of concatenated JSON, about.
JSON_OBJECTS = 1000


@query("concatenated_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def concatenated_json(spark, d):
    path = new_path(spark, "json")
    rows = table(spark, d, "events")
    groups = rows.count() // JSON_OBJECTS + 1
    value = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    text = F.concat(F.lit('{"event_id": '), value(F.col("event_id")), F.lit(', "k": '), value(F.get_json_object("props", "$.k")), F.lit("}"))
    df = rows.select(text.alias("x"), F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("g"))
    df.groupBy("g").agg(F.array_join(F.collect_list("x"), "").alias("value")).select("value").write.text(path)
    return R.read_concatenated_json(spark, path, "event_id long, k long")


@query("json_nested", """select event_id, user_id, event_type || ' }{ "x" \\' as label, cast(json_extract(props, '$.k') as bigint) as k, [event_id, user_id] as ids from events""")
def json_nested(spark, d):
    """Nested objects and arrays one behind another, with braces, quotes and backslashes in strings; objects of a task are one line."""
    path = new_path(spark, "json")
    df = table(spark, d, "events").select(
        "event_id", F.struct("user_id", F.struct(F.concat("event_type", F.lit(' }{ "x" \\')).alias("label"), F.from_json("props", "k long").alias("p")).alias("inner")).alias("o"), F.array("event_id", "user_id").alias("ids")
    )
    df.select(F.to_json(F.struct("*")).alias("value")).write.option("lineSep", " ").text(path)
    out = R.read_concatenated_json(spark, path, "event_id long, o struct<user_id: long, inner: struct<label: string, p: struct<k: long>>>, ids array<long>")
    return out.select("event_id", "o.user_id", "o.inner.label", "o.inner.p.k", "ids")


@query("replaced_output", "select o_orderstatus, count(*) as n from orders group by 1")
def replaced_output(spark, d):
    path = new_path(spark, "out")
    df = orders(spark, d)
    S.replace_output(df.select("o_orderstatus"), path)
    S.replace_output(df.groupBy("o_orderstatus").agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path)


@query("batched_append", "select o_orderkey, 2 as copies from orders")
def batched_append(spark, d):
    path = new_path(spark, "out")
    for _ in range(2):
        S.append_batches(orders(spark, d), path, 3000)
    return spark.read.parquet(path).groupBy("o_orderkey").agg(F.count("*").cast("int").alias("copies"))


@query("create_or_append", "select c_custkey, 2 as copies from customer")
def create_or_append(spark, d):
    path = new_path(spark, "dataset")
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    for _ in range(2):
        S.create_or_append(spark, df, path)
        S.create_or_append(spark, df.select("c_acctbal"), path)  # other fields: a dataset beside it
    return spark.read.parquet(path).groupBy("c_custkey").agg(F.count("*").cast("int").alias("copies"))


@query("clustered_write", "select o_orderkey, o_custkey from orders where o_custkey between 100 and 200")
def clustered_write(spark, d):
    path = new_path(spark, "clustered")
    S.replace_output(S.clustered(orders(spark, d), "o_custkey", partitions=8), path)
    return spark.read.parquet(path).where("o_custkey between 100 and 200").select("o_orderkey", "o_custkey")


@query("preagg_scan", "select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as items from orders where o_orderstatus = 'F' group by 1 order by 1 limit 50")
def preagg_scan(spark, d):
    df = R.preaggregated(table(spark, d, "orders"), F.col("o_orderstatus") == "F", ["o_custkey"], "o_totalprice", ["o_orderkey"], 50)
    return df.select("o_custkey", "n", F.round("total", 2).alias("total"), F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("items"))


@query("shard_limit", "select o_orderkey from orders where o_orderdate < (select quantile_disc(o_orderdate, 0.5) from orders)")
def shard_limit(spark, d):
    """Orders before the middle date are in the first of two shards by name, and only that one is read."""
    path = new_path(spark, "shards")
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    at = F.unix_micros("o_orderdate")
    middle = df.agg(F.expr("percentile_disc(0.5) within group (order by unix_micros(o_orderdate))")).first()[0]
    early = F.coalesce(at < F.lit(middle), F.lit(False))
    for name, where in (("shard-0", early), ("shard-1", ~early)):
        df.where(where).write.parquet(f"{path}/{name}")
    return R.read_shards(spark, path, shards=1).select("o_orderkey")


@query("file_limit", "select o_custkey // 500 as bucket, count(*) as n from orders where o_custkey // 500 < 2 group by 1")
def file_limit(spark, d):
    """The first two files of a folder by name, which hold the orders of the first thousand customers."""
    path = new_path(spark, "files")
    bucket = F.floor(F.col("o_custkey") / 500)
    df = orders(spark, d).select(bucket.alias("bucket"), F.least(bucket, F.lit(2)).cast("int").alias("file"))
    df.repartitionById(3, F.col("file")).select("bucket").write.parquet(path)
    return R.read_directory(spark, path, shards=2).groupBy("bucket").agg(F.count("*").alias("n"))


@query("entry_limit", "select o_orderkey from orders order by o_orderkey limit 100")
def entry_limit(spark, d):
    return R.first_entries(orders(spark, d), 100, "o_orderkey").select("o_orderkey")


@query("catalog_lookup", "select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def catalog_lookup(spark, d):
    table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment").createOrReplaceTempView("featlake_customers")
    return orders(spark, d).join(R.lookup_table(spark, "featlake_customers"), "o_custkey").select("o_orderkey", "c_mktsegment")


@query("read_by_mime", "select c_custkey, c_mktsegment from customer")
def read_by_mime(spark, d):
    path = new_path(spark, "csv")
    S.write_csv(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path)
    return R.read_any(spark, path, "text/csv").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment")


@query("observed_write", "select count(*) as n, round(sum(o_totalprice), 2) as total from orders")
def observed_write(spark, d):
    seen = S.observed(orders(spark, d), S.discard, n=F.count("*"), total=F.sum("o_totalprice"))
    return spark.createDataFrame([(seen["n"], seen["total"])], "n long, total double").select("n", F.round("total", 2).alias("total"))


@query("reduced_output", "select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def reduced_output(spark, d):
    """The reduced rows replace what ``<name>_reduced`` held."""
    path = new_path(spark, "orders_reduced")
    S.replace_output(orders(spark, d).select("o_custkey"), path)
    S.replace_output(orders(spark, d).groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), path)
    return spark.read.parquet(path)


@query("keyed_table", """select c_custkey, c_mktsegment, case when c_custkey % 5 = 0 then -1.0 when c_custkey % 7 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal
  from customer where c_custkey % 11 <> 0 union all select 10000000 + c_custkey, c_mktsegment, c_acctbal + 1 from customer where c_custkey % 7 = 0""")
def keyed_table(spark, d):
    """A table in folders by key: an upsert with new keys, an update, and a deletion; each writes the folders of its keys only."""
    path = new_path(spark, "keyed")
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    keyed.write_keyed(df, path, ["c_custkey"], 16)
    some = df.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    keyed.change_keyed(spark, path, some.union(some.withColumn("c_custkey", F.col("c_custkey") + 10_000_000)), "upsert")
    keyed.change_keyed(spark, path, df.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.lit(-1.0)), "update", ["c_acctbal"])
    keyed.change_keyed(spark, path, df.where("c_custkey % 11 = 0"), "delete")
    return keyed.read_keyed(spark, path)
