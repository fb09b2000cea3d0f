"""Projections, filters, joins, keyed changes and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import joins as J
from ..operators import project as P
from ..sources import readers as R
from ..sources import writers as S
from ..sources.scratch import new_path
from .base import query, table


@query("identity_features", "select c_custkey as f_c_custkey, c_nationkey as f_c_nationkey, c_acctbal, c_mktsegment as f_c_mktsegment from customer")
def identity_features(spark, d):
    return P.identity_features(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), ["c_acctbal"])


@query("computed_fields", "select o_orderkey, round(o_totalprice * 1.1 - 5, 4) as price, round(o_totalprice / (o_custkey % 7 + 3), 6) as per, o_orderstatus = 'F' as done from orders")
def computed_fields(spark, d):
    df = P.apply_options(table(spark, d, "orders"), compute={"price": F.round(F.col("o_totalprice") * 1.1 - 5, 4), "per": F.round(F.col("o_totalprice") / (F.col("o_custkey") % 7 + 3), 6), "done": F.col("o_orderstatus") == "F"})
    return df.select("o_orderkey", "price", "per", "done")


@query("dup_drop_cast", "select cast(c_custkey as varchar) as c_custkey, c_acctbal, c_mktsegment, c_mktsegment as segment_copy from customer")
def dup_drop_cast(spark, d):
    return P.apply_options(table(spark, d, "customer"), ignore=["c_name", "c_nationkey"], duplicate={"c_mktsegment": "segment_copy"}, as_string=["c_custkey"])


@query("clean_names", "select c_custkey as c_custkey, c_acctbal as acct_bal____ from customer")
def clean_names(spark, d):
    return P.cleaned(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("acct.bal ($)")))


@query("page_filter_limit", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 25 offset 10")
def page_filter_limit(spark, d):
    return P.page(table(spark, d, "orders").where("o_orderstatus = 'O'"), [F.desc("o_totalprice"), "o_orderkey"], 10, 25).select("o_orderkey", "o_totalprice")


@query("in_list", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def in_list(spark, d):
    return P.in_list(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey")


@query("not_in", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 5000)")
def not_in(spark, d):
    poor = table(spark, d, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("o_custkey"))
    return P.in_table(table(spark, d, "orders"), poor, "o_custkey", negate=True).select("o_orderkey")


@query("exists_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def exists_semi(spark, d):
    dear = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return P.in_table(table(spark, d, "customer"), dear, "c_custkey").select("c_custkey")


@query("any_first_match", "select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus <> 'P' order by o_orderkey limit 1")
def any_first_match(spark, d):
    return R.first_entries(table(spark, d, "orders").where((F.col("o_totalprice") > 100000) & ~(F.col("o_orderstatus") == "P")), 1, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("between_or", "select o_orderkey from orders where (o_totalprice between 1000 and 50000) or (o_orderstatus = 'F' and o_custkey < 100)")
def between_or(spark, d):
    return table(spark, d, "orders").where(F.col("o_totalprice").between(1000, 50000) | ((F.col("o_orderstatus") == "F") & (F.col("o_custkey") < 100))).select("o_orderkey")


@query("match_example", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority = '5-LOW'")
def match_example(spark, d):
    return P.match_example(table(spark, d, "orders"), o_orderstatus="F", o_orderpriority="5-LOW").select("o_orderkey")


@query("time_range_flag", "select event_id, value from events where ts >= '2024-01-08' and ts < '2024-01-15' and event_type = 'purchase'")
def time_range_flag(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet")  # uncast, so that the range reaches the scan
    return P.time_range(df, "ts", "2024-01-08", "2024-01-15").where("event_type = 'purchase'").select("event_id", "value")


@query("geo_near", """with s as (select s_suppkey, (s_suppkey * 37 % 180) - 90.0 as lat, (s_suppkey * 73 % 360) - 180.0 as lng from supplier)
select s_suppkey, round(2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(lat - 42.7) / 2), 2) + cos(radians(lat)) * cos(radians(42.7)) * power(sin(radians(lng - 23.3) / 2), 2)))), 4) as km from s order by km, s_suppkey limit 10""")
def geo_near(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 180 - 90.0).alias("lat"), (F.col("s_suppkey") * 73 % 360 - 180.0).alias("lng"))
    return P.geo_near(df, "lat", "lng", 42.7, 23.3, 10, "s_suppkey").select("s_suppkey", F.round("km", 4).alias("km"))


@query("geo_nearest", """with s as (select s_suppkey, (s_suppkey * 37 % 180) - 90.0 as lat, (s_suppkey * 73 % 360) - 180.0 as lng from supplier),
c as (select c_custkey, (c_custkey * 41 % 1801) / 10.0 - 90.0 as lat, (c_custkey * 97 % 3601) / 10.0 - 180.0 as lng from customer),
d as (select c_custkey, s_suppkey, 2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(c.lat)) * power(sin(radians(s.lng - c.lng) / 2), 2)))) as km from c, s)
select c_custkey, cast(rank as integer) as rank, round(km, 3) as km from (select *, row_number() over (partition by c_custkey order by km, s_suppkey) as rank from d) where rank <= 3""")
def geo_nearest(spark, d):
    """The distances of every customer's three nearest suppliers, around the globe."""
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 180 - 90.0).alias("lat"), (F.col("s_suppkey") * 73 % 360 - 180.0).alias("lng"))
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 41 % 1801 / 10.0 - 90.0).alias("lat"), (F.col("c_custkey") * 97 % 3601 / 10.0 - 180.0).alias("lng"))
    return P.geo_nearest(c, s, "lat", "lng", 3, "c_custkey", "s_suppkey").select("c_custkey", "rank", F.round("km", 3).alias("km"))


@query("enrich_left", "with r as (select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) select c_custkey, o_orderkey, o_totalprice from customer left join r on o_custkey = c_custkey")
def enrich_left(spark, d):
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return J.enrich(table(spark, d, "customer").select("c_custkey"), right, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey", "o_totalprice")


@query("lookup_first", "with r as (select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1) select c_custkey, o_orderkey from customer left join r on o_custkey = c_custkey")
def lookup_first(spark, d):
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return J.enrich(table(spark, d, "customer").select("c_custkey"), right, ["c_custkey"], ["o_orderdate", "o_orderkey"], last=False).select("c_custkey", "o_orderkey")


@query("theta_first", """select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderdate nulls last, o_orderkey) rn
  from customer left join orders on o_custkey = c_custkey and o_totalprice > c_acctbal * 40) where rn = 1""")
def theta_first(spark, d):
    left = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") * 40).alias("bound"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_totalprice")
    return J.first_above(left, right, ["c_custkey"], "bound", "o_totalprice", ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("theta_first_any", """select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderdate nulls last, o_orderkey) rn
  from customer left join orders on o_custkey = c_custkey and o_orderstatus <> 'F' and o_totalprice between c_acctbal and c_acctbal * 40) where rn = 1""")
def theta_first_any(spark, d):
    """A condition on the right side alone, and two bounds on one value."""
    left = table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") * 40).alias("most"))
    right = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_totalprice")
    return J.first_between(left, right, ["c_custkey"], "o_totalprice", ["o_orderdate", "o_orderkey"], "c_acctbal", "most").select("c_custkey", "o_orderkey")


@query("theta_first_band", """with c as (select c_custkey, c_nationkey, c_acctbal / 500 as b from customer), r as (select s_nationkey, s_suppkey, (s_suppkey * 7 % 23) - 4 as x from supplier)
select c_custkey, b, s_suppkey, x from (select *, row_number() over (partition by c_custkey order by s_suppkey) rn from c left join r on s_nationkey = c_nationkey and x > b and x <= b + 4) where rn = 1""")
def theta_first_band(spark, d):
    """Whole numbers between negative and fractional bounds, open below."""
    left = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") / 500).alias("b"), (F.col("c_acctbal") / 500 + 4).alias("most"))
    right = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", (F.col("s_suppkey") * 7 % 23 - 4).alias("x"))
    return J.first_between(left, right, ["nation"], "x", ["s_suppkey"], "b", "most", low_open=True).select("c_custkey", "b", "s_suppkey", "x")


@query("theta_first_no_key", """select p_partkey, o_orderkey from (select p_partkey, o_orderkey, row_number() over (partition by p_partkey order by o_orderdate nulls last, o_orderkey) rn
  from part left join orders on o_totalprice >= p_retailprice * 100 and o_totalprice < p_retailprice * 101) where rn = 1""")
def theta_first_no_key(spark, d):
    """Bounds without a key that both sides share: the first order of about a price, among all orders."""
    left = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("least"), (F.col("p_retailprice") * 101).alias("most"))
    right = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return J.first_between(left, right, [], "o_totalprice", ["o_orderdate", "o_orderkey"], "least", "most", high_open=True).select("p_partkey", "o_orderkey")


@query("relation_join", "select o_orderkey, count(*) as lines, round(sum(l_extendedprice), 2) as total from orders join lineitem on o_orderkey = l_orderkey group by 1")
def relation_join(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return J.related(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey = l_orderkey")


@query("child_rows", "select user_id, event_type, count(*) as n from events group by all")
def child_rows(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("child_visitor", "select user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, event_id from events")
def child_visitor(spark, d):
    """A user's events of a day as an array, and a row for each of its members."""
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.collect_list(F.struct("event_type", "event_id")).alias("events"))
    return P.children(days, "events", {"user_id": F.col("user_id"), "day": F.col("day"), "event_type": F.col("child.event_type"), "event_id": F.col("child.event_id")})


WEEK = "cast(floor((epoch_us(date_trunc('day', ts)) // 86400000000 + 3) / 7.0) as integer)"


@query("next_week_label", f"""with e as (select *, {WEEK} as week from events), p as (select distinct user_id, week - 1 as week from e where event_type = 'purchase' and value > 100)
select event_id, week, cast(case when p.user_id is null then 0 else 1 end as integer) as label from e left join p using (user_id, week) where not (event_type = 'purchase' and value > 100) and week in (select week from p)""")
def next_week_label(spark, d):
    pays = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    return J.next_period_label(table(spark, d, "events"), "user_id", "ts", pays).select("event_id", "week", "label")


@query("time_shift_target", """with a as (select event_id, user_id, epoch_us(ts) + 21600000000 as at from events), v as (select user_id, epoch_us(ts) as at, event_id as vid, value from events)
select a.event_id, arg_min(value, (v.at, vid)) as label from a left join v on a.user_id = v.user_id and v.at >= a.at group by 1""")
def time_shift_target(spark, d):
    return J.shifted_target(table(spark, d, "events"), "user_id", "ts", "value", "event_id", hours=6).select("event_id", "label")


@query("month_shift_target", """select a.o_orderkey, arg_min(v.o_totalprice, (v.o_orderdate, v.o_orderkey)) as label from orders a
left join orders v on a.o_custkey = v.o_custkey and v.o_orderdate >= a.o_orderdate + interval 13 month + interval 2 day group by 1""")
def month_shift_target(spark, d):
    """The customer's first price from a year, a month and two days later on, by the calendar."""
    return J.shifted_target(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey", years=1, months=1, days=2).select("o_orderkey", "label")


@query("month_before_target", """select a.o_orderkey, arg_max(v.o_totalprice, (v.o_orderdate, v.o_orderkey)) as label from orders a
left join orders v on a.o_custkey = v.o_custkey and v.o_orderdate <= a.o_orderdate - interval 1 month group by 1""")
def month_before_target(spark, d):
    """The customer's last price until a month before."""
    return J.shifted_target(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey", before=True, months=1).select("o_orderkey", "label")


@query("anti_delete", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def anti_delete(spark, d):
    keys = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return S.delete_keys(table(spark, d, "orders"), keys, ["o_custkey"]).select("o_orderkey")


@query("upsert", "select c_custkey, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0")
def upsert(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return S.upsert(df.where("c_custkey % 2 = 0"), df.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("keyed_update", "select c_custkey, c_name, case when c_custkey % 5 = 0 then 0.0 else c_acctbal end as c_acctbal from customer")
def keyed_update(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return S.keyed_update(df, df.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"], ["c_acctbal"])


@query("keyed_update_last", "select c_custkey, case when c_custkey % 5 = 0 then c_nationkey + 2.0 else c_acctbal end as c_acctbal from customer")
def keyed_update_last(spark, d):
    """Each key stands three times in the update; the last one by an order counts."""
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    new = df.where("c_custkey % 5 = 0").withColumn("step", F.explode(F.array(F.lit(0), F.lit(2), F.lit(1)))).withColumn("c_acctbal", F.col("c_nationkey") + F.col("step").cast("double"))
    return S.keyed_update(df, new, ["c_custkey"], ["c_acctbal"], order=["step"]).select("c_custkey", "c_acctbal")


@query("sync_tables", "select c_custkey, round(c_acctbal * case when c_custkey % 2 = 0 then 2 else 1 end, 2) as c_acctbal from customer")
def sync_tables(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    b = df.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 2)
    return S.upsert(df, b, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("truncate_table", "select c_nationkey, count(*) as n from customer where c_custkey % 2 = 0 group by 1")
def truncate_table(spark, d):
    """A written table is emptied, keeps its columns and takes other rows."""
    path = new_path(spark, "truncated")
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    S.replace_output(df, path)
    S.truncate(spark, path)
    S.append_batches(df.where("c_custkey % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("append_union", "select c_nationkey, count(*) as n from (select * from customer union all select * from customer) group by 1")
def append_union(spark, d):
    df = table(spark, d, "customer")
    return R.read_many([df, df]).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("multi_dataset_read", "select c_custkey as k, c_acctbal as amount, null as o_orderstatus from customer union all select o_orderkey, o_totalprice, o_orderstatus from orders")
def multi_dataset_read(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("amount"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    return R.read_many([a, b])


@query("keyed_intersect", "select distinct c_custkey as k from customer where c_custkey in (select o_custkey from orders)")
def keyed_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("key_difference", "select c_custkey as k from customer except select o_custkey from orders where o_totalprice > 400000")
def key_difference(spark, d):
    dear = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(dear)


@query("sorted_limit", "select event_id, value from events order by value desc, event_id limit 20")
def sorted_limit(spark, d):
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "value")


@query("limit_after_group", "select user_id, count(*) as n from events group by 1 order by n desc, user_id limit 10")
def limit_after_group(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("unique_guard", "select user_id, cast(day(ts) as bigint) as day, count(*) as n from events group by 1, 2 having count(*) > 1")
def unique_guard(spark, d):
    """Keys of several events; the events themselves have ids of their own, or this is an error."""
    df = P.require_unique(table(spark, d, "events"), ["event_id"])
    return P.unique_guard(df.withColumn("day", F.dayofmonth("ts").cast("long")), ["user_id", "day"])


@query("key_hashes", "select count(distinct (user_id, event_type)) as keys, count(distinct (user_id, event_type)) as hashes from events")
def key_hashes(spark, d):
    df = table(spark, d, "events").select("user_id", "event_type").distinct()
    return df.agg(F.count("*").alias("keys"), F.count_distinct(texts.key_hash(F.col("user_id"), F.col("event_type"))).alias("hashes"))
