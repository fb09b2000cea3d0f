"""Aggregations, feature sets, scores, encoders and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, texts, times
from ..operators import aggregates as A
from ..operators import encoders as E
from ..operators import languages as L
from ..operators import profiling as P
from ..operators import states as M
from ..sources import writers as S
from ..sources.scratch import new_path
from .base import query, table



class _Columns:
    """Columns of ``events``, made when a query runs, as they need a session."""

    @property
    def ts(self):
        return F.col("ts")

    @property
    def order(self):
        return F.col("ts"), F.col("event_id")


C = _Columns()


@query("feature_grid", """select cast(hour(ts) as integer) as hour, cast(dayofyear(ts) as integer) as yearday, min(value) as f_0, round(avg(value), 6) as f_1, round(stddev_pop(value), 6) as f_2,
  count(distinct event_type) as f_3, cast(day(arg_min(ts, (ts, event_id))) as integer) as f_4 from events group by 1, 2""")
def feature_grid(spark, d):
    fs = A.FeatureSet(A.default_grid(C.ts))
    fs.aggregate("lo", F.min("value")).aggregate("mean", F.avg("value")).aggregate("std", F.stddev_pop("value"))
    fs.aggregate("kinds", A.num_unique(F.col("event_type"))).aggregate("first_ts", A.first(C.ts, *C.order))
    fs.feature(F.col("lo")).feature(F.round("mean", 6)).feature(F.round("std", 6)).feature(F.col("kinds")).feature(F.dayofmonth("first_ts"))
    return fs.build(table(spark, d, "events"))


@query("group_basic_aggs", """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, max(l_extendedprice) as max_price, min(l_discount) as min_disc, round(stddev_samp(l_quantity), 6) as std_qty,
  round(avg(l_extendedprice), 4) as avg_price, count(*) as n from lineitem group by all""")
def group_basic_aggs(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.max("l_extendedprice").alias("max_price"), F.min("l_discount").alias("min_disc"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("std_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n"))


@query("first_last_by_ts", "select user_id, arg_min(value, (ts, event_id)) as first_value, arg_max(event_type, (ts, event_id)) as last_type from events group by 1")
def first_last_by_ts(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(A.first(F.col("value"), *C.order).alias("first_value"), A.last(F.col("event_type"), *C.order).alias("last_type"))


@query("num_unique_many", "select l_returnflag, l_linestatus, count(distinct l_partkey) as unique_l_partkey, count(distinct l_suppkey) as unique_l_suppkey, count(distinct l_quantity) as unique_l_quantity from lineitem group by 1, 2")
def num_unique_many(spark, d):
    return A.num_unique_many(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_partkey", "l_suppkey", "l_quantity"])


@query("mode_by_group", "with c as (select user_id, event_type, count(*) n from events group by all) select user_id, event_type as top_type from c qualify row_number() over (partition by user_id order by n desc, event_type) = 1")
def mode_by_group(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("top_type"))


@query("skew_by_group", """with m as (select l_returnflag, avg(l_quantity) as a from lineitem group by 1)
select l_returnflag, round(avg(power(l_quantity - a, 3)) / power(avg(power(l_quantity - a, 2)), 1.5), 6) as skew from lineitem join m using (l_returnflag) group by 1""")
def skew_by_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.skewness("l_quantity"), 6).alias("skew"))


@query("agg_over_projection", """select o_orderpriority, cast(min(dayofweek(o_orderdate) + 1) as integer) as min_weekday, count(distinct day(o_orderdate)) as days, cast(max(month(o_orderdate)) as integer) as max_month,
  cast(min(year(o_orderdate)) as integer) as min_year, cast(max(dayofyear(o_orderdate)) as integer) as max_yearday, cast(max(hour(o_orderdate)) as integer) as max_hour from orders group by 1""")
def agg_over_projection(spark, d):
    ts = F.col("o_orderdate")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.min(times.weekday(ts)).alias("min_weekday"), A.num_unique(F.dayofmonth(ts)).alias("days"), F.max(F.month(ts)).alias("max_month"), F.min(F.year(ts)).alias("min_year"),
        F.max(F.dayofyear(ts)).alias("max_yearday"), F.max(F.hour(ts)).alias("max_hour"))


@query("group_by_id", "select o_orderkey, count(*) as n, max(o_totalprice) as price from orders group by 1")
def group_by_id(spark, d):
    return table(spark, d, "orders").groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("price"))


@query("global_count", "select count(*) as n from orders")
def global_count(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"))


@query("group_by_computed_key", "select cast(floor(o_totalprice / 50000) as bigint) as band, count(*) as n from orders group by 1")
def group_by_computed_key(spark, d):
    return table(spark, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 50000).alias("band")).agg(F.count("*").alias("n"))


@query("distinct_values", "select distinct p_brand from part")
def distinct_values(spark, d):
    return table(spark, d, "part").select("p_brand").distinct()


@query("distinct_filtered", "select distinct user_id from events where event_type = 'purchase' and value > 100")
def distinct_filtered(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase' and value > 100").select("user_id").distinct()


@query("week_rollup", "select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, epoch_us(min(ts)) as first_us, count(*) as n, round(sum(value), 2) as total from events group by 1")
def week_rollup(spark, d):
    return table(spark, d, "events").groupBy(times.week_start(C.ts).cast("string").alias("week")).agg(times.micros(F.min("ts")).alias("first_us"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).orderBy("week")


@query("entity_day_events", """select user_id, cast(epoch_us(date_trunc('day', ts)) // 86400000000 as integer) as day, epoch_us(min(ts)) as noticed_us,
  string_agg(event_type, ',' order by ts, event_id) as events, cast(max(case when event_type = 'purchase' then 1 else 0 end) as integer) as flagged from events group by 1, 2""")
def entity_day_events(spark, d):
    df = A.entity_days(table(spark, d, "events"), "user_id", "ts", ["ts", "event_id", "event_type"], F.col("event_type") == "purchase")
    return df.select("user_id", F.unix_date("day").alias("day"), times.micros(F.col("noticed_date")).alias("noticed_us"), F.array_join("events.event_type", ",").alias("events"), "flagged")


@query("mapreduce_entity_day", """select user_id, cast(epoch_us(date_trunc('day', ts)) // 86400000000 as integer) as day, count(*) as n, epoch_us(min(ts)) // 1000 as first_ms, arg_min(value, (ts, event_id)) as first_value,
  coalesce(string_agg(event_type, ',' order by ts, event_id) filter (where value > 50), '') as dear, case when count(*) > 2 then 'many' else 'few' end as size from events group by 1, 2""")
def mapreduce_entity_day(spark, d):
    v = F.col("values")
    return A.map_reduce(
        table(spark, d, "events"), {"user_id": F.col("user_id"), "day": times.day_number(C.ts)},
        {"ms": times.epoch_millis(C.ts), "ts": C.ts, "event_id": F.col("event_id"), "event_type": F.col("event_type"), "value": F.col("value")},
        {"n": F.size(v).cast("long"), "first_ms": v[0]["ms"], "first_value": v[0]["value"],
         "dear": F.array_join(F.transform(F.filter(v, lambda x: x["value"] > 50), lambda x: x["event_type"]), ","),
         "size": arrays.either(F.size(v) > 2, F.lit("many"), F.lit("few"))})


@query("mapreduce_limited", """select user_id, count(*) as n, string_agg(event_type, ',' order by ts, event_id) as kinds from (select * from events order by ts, event_id limit 100) group by 1""")
def mapreduce_limited(spark, d):
    v = F.col("values")
    return A.map_reduce(table(spark, d, "events"), {"user_id": F.col("user_id")}, {"ts": C.ts, "event_id": F.col("event_id"), "event_type": F.col("event_type")},
                        {"n": F.size(v).cast("long"), "kinds": F.array_join(arrays.select_many(v, lambda x: F.array(x["event_type"])), ",")}, limit=100, order=["ts", "event_id"])


@query("chunked_values", "with r as (select user_id, event_type, (row_number() over (partition by user_id order by ts, event_id) - 1) // 10 as chunk from events) select user_id, cast(count(distinct chunk) as bigint) as chunks, cast(count(*) as bigint) as n from r group by 1")
def chunked_values(spark, d):
    df = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return df.select("user_id", F.ceil(F.col("n") / 10).cast("long").alias("chunks"), "n")


@query("meta_scores", "select event_type, user_id, round(sum(value), 2) as total, count(*) as n, round(sum(value) / count(*), 6) as average from events group by 1, 2")
def meta_scores(spark, d):
    return A.scores(table(spark, d, "events"), "event_type", "user_id", "value").select("event_type", "user_id", F.round("total", 2).alias("total"), "n", F.round("average", 6).alias("average"))


@query("meta_sets", "select event_type, user_id, string_agg(distinct cast(day(ts) as varchar), ',' order by cast(day(ts) as varchar)) as days, cast(count(distinct day(ts)) as integer) as size from events group by 1, 2")
def meta_sets(spark, d):
    df = table(spark, d, "events").withColumn("day", F.dayofmonth("ts").cast("string"))
    return A.value_sets(df, "event_type", "user_id", "day").select("event_type", "user_id", F.array_join("members", ",").alias("days"), "size")


@query("meta_max", "select c_custkey, coalesce(max(value), -1) as best from customer left join events on user_id = c_custkey and event_type = 'purchase' group by 1")
def meta_max(spark, d):
    best = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("best"))
    return table(spark, d, "customer").join(best, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("best", F.lit(-1.0)).alias("best"))


@query("merge_partials", "select user_id, round(sum(value), 2) as total, min(value) as lo, max(value) as hi, count(*) as n from events group by 1")
def merge_partials(spark, d):
    df = table(spark, d, "events")
    part = lambda x: x.groupBy("user_id").agg(F.sum("value").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    out = A.merged([part(df.where("event_id % 2 = 0")), part(df.where("event_id % 2 = 1"))], ["user_id"], {"total": "sum", "lo": "min", "hi": "max", "n": "sum"})
    return out.withColumn("total", F.round("total", 2))


@query("mapreduce_ordered", """with r as (select event_type, date_trunc('day', ts) as day, ts, event_id, value, lag(value) over w as before from events window w as (partition by event_type order by ts, event_id))
select event_type, count(*) as n, arg_min(event_id, (ts, event_id)) as first_event, arg_max(event_id, (ts, event_id)) as last_event, round(max(before - value), 2) as deepest_fall, sum(case when value > before then 1 else 0 end) as rises from r group by 1""")
def mapreduce_ordered(spark, d):
    """All events of a type in order of time: number, ends, the deepest fall of the value from one event to the next, and how often it rises."""

    def state(n, first, last, opens, closes, fall, rises):
        names = ("n", "first", "last", "opens", "closes", "fall", "rises")
        return F.struct(*[x.alias(name) for name, x in zip(names, (n, first, last, opens, closes, fall, rises), strict=True)])

    def joined(a, b):
        fall = F.when(a["closes"].isNotNull() & b["opens"].isNotNull(), a["closes"] - b["opens"])
        rises = F.when(b["opens"] > a["closes"], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        return state(a["n"] + b["n"], F.coalesce(a["first"], b["first"]), F.coalesce(b["last"], a["last"]), F.when(a["n"] > 0, a["opens"]).otherwise(b["opens"]), b["closes"], F.greatest(a["fall"], fall, b["fall"]), a["rises"] + rises + b["rises"])

    zero, none, empty = F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("double")
    one = lambda v: state(F.lit(1).cast("long"), v["event_id"], v["event_id"], v["value"], v["value"], empty, zero)
    values = {"ts": F.col("ts"), "event_id": F.col("event_id"), "value": F.col("value")}
    finish = {"n": lambda s: s["n"], "first_event": lambda s: s["first"], "last_event": lambda s: s["last"], "deepest_fall": lambda s: F.round(s["fall"], 2), "rises": lambda s: s["rises"]}
    return A.reduce_in_order(table(spark, d, "events"), {"event_type": F.col("event_type")}, values, state(zero, none, none, empty, empty, empty, zero), lambda a, v: joined(a, one(v)), joined, finish)


@query("merge_states", """select event_type, round(sum(value), 2) as total, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(stddev_samp(value), 6) as std_sample,
  cast(count(distinct user_id) as integer) as users, list(distinct day(ts) order by day(ts)) as days, arg_max(event_id, (ts, event_id)) as last_event, arg_min(event_id, (ts, event_id)) as first_event from events group by 1""")
def merge_states(spark, d):
    """States of three batches, each appended to one table, merged with each other."""
    df = table(spark, d, "events").withColumns({"day": F.dayofmonth("ts").cast("long"), "at": F.struct("ts", "event_id")})
    rules = {
        "total": ("sum", "value"), "n": ("count", "value"), "mean": ("mean", "value"), "std": ("std", "value"), "std_sample": ("std_sample", "value"),
        "users": ("distinct", "user_id"), "days": ("set", "day"), "last_event": ("last", "at", "event_id"), "first_event": ("first", "at", "event_id"),
    }
    path = new_path(spark, "states")
    for i in range(3):
        S.append_batches(M.partial_states(df.where(F.col("event_id") % 3 == i), ["event_type"], rules), path)
    out = M.finished_states(M.merged_states(spark.read.parquet(path), ["event_type"], rules), ["event_type"], rules)
    return out.withColumns({"total": F.round("total", 2), **{c: F.round(c, 6) for c in ("mean", "std", "std_sample")}})


@query("feature_pairs_long", """with g as (select user_id, cast(count(*) as double) as n, min(value) as lo, max(value) as hi from events group by 1)
select user_id, 'n' as name, n as value from g union all select user_id, 'lo', lo from g union all select user_id, 'hi', hi from g""")
def feature_pairs_long(spark, d):
    df = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return A.feature_pairs(df, ["user_id"], ["n", "lo", "hi"])


@query("two_pass_features", "with s as (select user_id, avg(value) m, stddev_pop(value) sd from events group by 1) select event_id, round(value - m, 9) as above, round((value - m) / greatest(sd, 1e-9), 5) as z from events join s using (user_id)")
def two_pass_features(spark, d):
    df = A.two_pass(table(spark, d, "events"), ["user_id"], {"m": F.avg("value"), "sd": F.stddev_pop("value")}, {"above": F.round(F.col("value") - F.col("m"), 9), "z": F.round((F.col("value") - F.col("m")) / F.greatest("sd", F.lit(1e-9)), 5)})
    return df.select("event_id", "above", "z")


@query("group_ids", "select user_id, event_type, cast(row_number() over (order by user_id, event_type) as integer) as group_id from (select distinct user_id, event_type from events)")
def group_ids(spark, d):
    return A.group_ids(table(spark, d, "events"), ["user_id", "event_type"])


@query("multi_generator", """select user_id, cast(hour(min(ts)) as integer) as first_hour, count(*) as n, round(sum(case when event_type = 'purchase' then value else 0 end), 2) as spent,
  round(sum(case when event_type = 'purchase' then 1 else 0 end) / greatest(1.0, count(*)), 6) as buy_rate from events group by 1""")
def multi_generator(spark, d):
    is_buy = F.col("event_type") == "purchase"
    when = [F.hour(F.min("ts")).alias("first_hour"), F.count("*").alias("n")]
    money = [F.round(F.sum(F.when(is_buy, F.col("value")).otherwise(0.0)), 2).alias("spent"), F.round(arrays.guarded(F.count_if(is_buy), F.count("*")), 6).alias("buy_rate")]
    return table(spark, d, "events").groupBy("user_id").agg(*when, *money)


DICT = "with d as (select c_mktsegment as value, row_number() over (order by c_mktsegment) as idx from (select distinct c_mktsegment from customer)) "


@query("onehot", DICT + "select c_custkey, " + ", ".join(f"case when idx = {i} then 1 else 0 end as c_mktsegment{i}" for i in range(1, 6)) + " from customer join d on c_mktsegment = value")
def onehot(spark, d):
    df = table(spark, d, "customer")
    out = E.one_hot(df, "c_mktsegment", E.fit(df, "c_mktsegment"))
    return out.select("c_custkey", *[c for c in out.columns if c[:-1] == "c_mktsegment"])


@query("binary_code", DICT + "select c_custkey, '1' || lpad(bin(idx), 8, '0') as code from customer join d on c_mktsegment = value")
def binary_code(spark, d):
    df = table(spark, d, "customer")
    return E.binary(df, "c_mktsegment", E.fit(df, "c_mktsegment"), "code").select("c_custkey", "code")


@query("binary_overflow", "select p_partkey, '1' || lpad(bin(case when idx <= 20 then idx else 0 end), 8, '0') as code from part join (select p_brand as value, row_number() over (order by p_brand) as idx from (select distinct p_brand from part)) on p_brand = value")
def binary_overflow(spark, d):
    df = table(spark, d, "part")
    return E.binary(df, "p_brand", E.fit(df, "p_brand"), "code").select("p_partkey", "code")


@query("ordinal_id", DICT + "select c_custkey, cast(idx as varchar) as id from customer join d on c_mktsegment = value")
def ordinal_id(spark, d):
    df = table(spark, d, "customer")
    return E.ordinal(df, "c_mktsegment", E.fit(df, "c_mktsegment"), "id").select("c_custkey", "id")


@query("decode_labels", "select c_custkey, c_mktsegment as label from customer")
def decode_labels(spark, d):
    df = table(spark, d, "customer")
    dictionary = E.fit(df, "c_mktsegment")
    return E.decode(E.binary(df, "c_mktsegment", dictionary, "code").select("c_custkey", "code"), "code", dictionary, "label").select("c_custkey", "label")


@query("bit_columns", DICT + "select c_custkey, " + ", ".join(f"cast(substr(lpad(bin(idx), 8, '0'), {i + 1}, 1) as integer) as seg{i}" for i in range(8)) + " from customer join d on c_mktsegment = value")
def bit_columns(spark, d):
    df = table(spark, d, "customer")
    out = E.bit_columns(E.binary(df, "c_mktsegment", E.fit(df, "c_mktsegment"), "code"), "code", "seg")
    return out.select("c_custkey", *[f"seg{i}" for i in range(8)])


@query("incremental_dict", """with a as (select p_brand as value, row_number() over (order by p_brand) as idx from (select distinct p_brand from part where p_size <= 2)),
b as (select p_brand as value, row_number() over (order by p_brand) + (select max(idx) from a) as idx from (select distinct p_brand from part where p_brand not in (select value from a)))
select value, cast(idx as integer) as idx from a union all select value, cast(idx as integer) from b""")
def incremental_dict(spark, d):
    df = table(spark, d, "part")
    return E.extend(E.fit(df.where("p_size <= 2"), "p_brand"), df, "p_brand")


@query("encode_all", DICT + "select c_custkey, '1' || lpad(bin(idx), 8, '0') as c_mktsegment_code, cast(dense_rank() over (order by cast(c_nationkey as varchar)) as varchar) as c_nationkey_id from customer join d on c_mktsegment = value")
def encode_all(spark, d):
    df, _ = E.encode_all(table(spark, d, "customer"), {"c_mktsegment": "binary", "c_nationkey": "id"})
    return df.select("c_custkey", "c_mktsegment_code", "c_nationkey_id")


@query("date_parse", """with t as (select o_orderkey, o_orderdate, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') when 1 then strftime(o_orderdate, '%d/%m/%Y') || ' 0:00'
  when 2 then strftime(o_orderdate, '%d-%m-%y') || ' 00:00' when 3 then '1709287872' else 'none' end as s from orders)
select o_orderkey, case when o_orderkey % 5 in (3, 4) then null when o_orderkey % 5 = 1 and day(o_orderdate) <= 12 then epoch_us(make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0.0))
  when o_orderkey % 5 = 2 and year(o_orderdate) < 2000 then epoch_us(o_orderdate + interval 100 year) else epoch_us(o_orderdate) end as us from t""")
def date_parse(spark, d):
    ts, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(ts, "dd/MM/yyyy H:mm")).when(k == 2, F.date_format(ts, "dd-MM-yy HH:mm")).when(k == 3, "1709287872").otherwise("none")
    return table(spark, d, "orders").select("o_orderkey", times.micros(times.parse_date(text)).alias("us"))


@query("hostnames", "select page_id, regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '^(http://)?(https://)?', ''), '^[^/]*'), '^www\\.', ''), '^[^@]*@', '') as host from pages")
def hostnames(spark, d):
    return table(spark, d, "pages").select("page_id", texts.hostname(F.col("url"), strip_www=True).alias("host"))


@query("url_flags", "select page_id, contains(url, 'utm_source') as tracked, regexp_matches(url, '^https?://m\\.') as mobile from pages")
def url_flags(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("url").contains("utm_source").alias("tracked"), texts.hostname(F.col("url")).startswith("m.").alias("mobile"))


@query("slugs", "select doc_id, regexp_replace(replace(text, ' ', '-'), '[^\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}.\\-]+', '', 'g') as slug from documents")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.slug(F.col("text")).alias("slug"))


@query("is_numeric", "select event_id, try_cast(props as double) is not null as whole, try_cast(regexp_extract(props, '[0-9]+') as double) is not null as inner_number from events")
def is_numeric(spark, d):
    return table(spark, d, "events").select("event_id", texts.is_numeric(F.col("props")).alias("whole"), texts.is_numeric(F.regexp_extract("props", "[0-9]+", 0)).alias("inner_number"))


@query("gender_map", "select c_custkey, cast(case c_custkey % 5 when 0 then 1 when 1 then 2 when 2 then 1 when 3 then 2 else 0 end as integer) as gender, try_cast(case when c_custkey % 3 = 0 then 'x' else cast(c_nationkey as varchar) end as integer) as age from customer")
def gender_map(spark, d):
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, "male").when(k == 1, "female").when(k == 2, "t").when(k == 3, "f").otherwise("")
    age = F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", texts.gender_code(raw).alias("gender"), texts.try_int(age).alias("age"))


@query("unwrap_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(null as bigint) as missing from events")
def unwrap_props(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", texts.json_value(p, "$.k", "bigint").alias("k"), texts.json_value(p, "$.none", "bigint").alias("missing"))


@query("profile_columns", "select 'o_totalprice' as name, 'double' as type, count(*) as n, count(*) - count(o_totalprice) as nulls, round(avg(o_totalprice), 4) as mean from orders union all select 'o_orderstatus', 'string', count(*), count(*) - count(o_orderstatus), null from orders")
def profile_columns(spark, d):
    return P.describe(table(spark, d, "orders").select("o_totalprice", "o_orderstatus")).select("name", "type", "n", "nulls", F.round("mean", 4).alias("mean"))


_KINDS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp",
}


def _profile(c: str, kind: str) -> str:
    text = f"strftime({{}}({c}), '%Y-%m-%d %H:%M:%S')" if kind == "timestamp" else f"cast({{}}({c}) as varchar)"
    mean = f"round(avg({c}), 4)" if kind in ("bigint", "int", "double") else "null"
    return f"select '{c}' as name, '{kind}' as type, count(*) as n, count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\", {text.format('min')} as least, {text.format('max')} as most, {mean} as mean from lineitem"


@query("profile_all_columns", " union all ".join(_profile(c, k) for c, k in _KINDS.items()))
def profile_all_columns(spark, d):
    return P.describe(table(spark, d, "lineitem").select(*_KINDS), exact=True).withColumn("mean", F.round("mean", 4))


@query("encoded_columns", DICT + "select * from (values ('c_custkey', 'float', true, null), ('c_mktsegment', 'str', false, 'c_mktsegment1,c_mktsegment2,c_mktsegment3,c_mktsegment4,c_mktsegment5'), "
       "('c_nationkey', 'float', false, 'c_nationkey0,c_nationkey1,c_nationkey2,c_nationkey3,c_nationkey4,c_nationkey5,c_nationkey6,c_nationkey7')) v(name, kind, is_key, encoded) where (select count(*) from d) = 5")  # fmt: skip
def encoded_columns(spark, d):
    """Columns that encodings give, in the report of a dataset's fields."""
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    names = {"c_mktsegment": E.encoded_names("c_mktsegment", "onehot", E.fit(df, "c_mktsegment")), "c_nationkey": E.encoded_names("c_nationkey", "binary", E.fit(df, "c_nationkey"))}
    return P.feature_schema(df, ["c_custkey"], names)


@query("encoded_onehot", DICT + "select c_custkey, " + ", ".join(f"case when idx = {i} then 1 else 0 end as c_mktsegment{i}" for i in range(1, 6)) + ", cast(dense_rank() over (order by cast(c_nationkey as varchar)) as varchar) as c_nationkey_id from customer join d on c_mktsegment = value")
def encoded_onehot(spark, d):
    df, dictionaries = E.encode_all(table(spark, d, "customer"), {"c_mktsegment": "onehot", "c_nationkey": "id"})
    return df.select("c_custkey", *E.encoded_names("c_mktsegment", "onehot", dictionaries["c_mktsegment"]), "c_nationkey_id")


@query("week_bounds", "select event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') as week_start, strftime(date_trunc('week', ts) + interval 7 day, '%Y-%m-%d') as week_end from events")
def week_bounds(spark, d):
    return table(spark, d, "events").select("event_id", times.week_start(C.ts).cast("string").alias("week_start"), times.week_end(C.ts).cast("string").alias("week_end"))


@query("day_chunks", "select user_id, cast(epoch_us(date_trunc('day', ts)) // 86400000000 as integer) as day, cast((count(*) + 9) // 10 as integer) as chunks, cast(case when count(*) % 10 = 0 then 10 else count(*) % 10 end as integer) as last_size from events group by 1, 2")
def day_chunks(spark, d):
    """The events of a day in groups of ten."""
    days = table(spark, d, "events").groupBy("user_id", times.day_number(C.ts).alias("day")).agg(F.collect_list("event_id").alias("v"))
    parts = days.select("user_id", "day", arrays.chunks(F.col("v"), 10).alias("c")).where(arrays.has_any(F.col("c")))
    return parts.select("user_id", "day", F.size("c").alias("chunks"), F.size(F.element_at("c", -1)).alias("last_size"))


@query("ts_discovery", "select 'ts' as column_name, count(ts) as n, epoch_us(max(ts)) as last_us from events")
def ts_discovery(spark, d):
    df = table(spark, d, "events")
    name = P.timestamp_column(df)
    return df.agg(F.lit(name).alias("column_name"), F.count(name).alias("n"), times.micros(F.max(name)).alias("last_us"))


@query("target_type", "select 'o_totalprice' as target, 'regression' as task union all select 'o_orderstatus', 'classification'")
def target_type(spark, d):
    df = table(spark, d, "orders")
    return P.target_type(df, "o_totalprice").union(P.target_type(df, "o_orderstatus"))


def _votes(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in P.STOP_WORDS[lang])
    return f"select '{lang}' as lang, cast(sum(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x in ({words})))) as bigint) as votes from documents"


@query("doc_language", " union all ".join(_votes(x) for x in sorted(P.STOP_WORDS)))
def doc_language(spark, d):
    return P.column_language(table(spark, d, "documents"), "text")


@query("text_languages", r"""with t as (select doc_id, lang, doc_id % 3 = 0 as own, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' as t from documents where text is not null),
c as (select doc_id, lang, own, substr(t, i, 3) as gram, count(*) as n from (select *, unnest(range(1, length(t) - 1)) as i from t where length(t) > 2) where substr(t, i + 1, 1) <> ' ' group by all),
p as (select lang, gram, row_number() over (partition by lang order by sum(n) desc, gram) - 1 as rank from c where not own and lang is not null group by lang, gram qualify rank < 300),
d as (select doc_id, gram, row_number() over (partition by doc_id order by n desc, gram) - 1 as rank from c qualify rank < 300),
s as (select d.doc_id, l.lang, sum(case when p.rank is null then 300 else least(300, abs(p.rank - d.rank)) end) as apart, count(*) as n from d cross join (select distinct lang from p) l left join p on p.gram = d.gram and p.lang = l.lang group by all),
b as (select doc_id, arg_min(lang, (apart, lang)) as lang, min(apart / (300.0 * n)) as distance from s group by doc_id)
select documents.doc_id, case when coalesce(distance, 1) <= 0.85 then b.lang else 'unknown' end as language, round(coalesce(distance, 1.0), 6) as distance from documents left join b on b.doc_id = documents.doc_id""")
def text_languages(spark, d):
    """Languages of all texts, by profiles learned from two thirds of the labelled ones."""
    df = table(spark, d, "documents")
    profiles = L.learn_profiles(df.where("doc_id % 3 <> 0"), "text", "lang")
    return L.text_language(df.select("doc_id", "text"), "text", profiles).select("doc_id", "language", F.round("distance", 6).alias("distance"))


@query("feature_schema", "select column_name as name, case when data_type like '%DOUBLE%' or data_type like '%INT%' then 'float' when data_type like 'TIME%' then 'datetime' else 'str' end as kind, column_name = 'o_orderkey' as is_key, cast(null as varchar) as encoded from (describe select * from orders) t(column_name, data_type, a, b, c, e)")
def feature_schema(spark, d):
    return P.feature_schema(table(spark, d, "orders"), ["o_orderkey"])
