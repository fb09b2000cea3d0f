"""Windows, sessions, clickstream features and paths over ``events``.

``event_type`` stands for the host, ``purchase`` for a payment, ``click`` for
the target site, ``signup`` for the mobile one and ``view`` for a promotion.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import times
from ..operators import aggregates
from ..operators import clickstream as K
from ..operators import paths as T
from ..operators import project as P
from ..operators import sessions as S
from ..operators import user_features as U
from ..operators.numbering import at_position
from ..sources.scratch import written
from .base import query, table

TARGET, MOBILE, PROMOTION = "click", "signup", "view"

#: SQL of what the operators share: ordered events, runs, sessions, payers, people, calendar.
BASE = """with e as (select user_id as user, epoch_us(ts) as tus, cast(epoch_us(date_trunc('day', ts)) // 86400000000 as integer) as day, event_id as event, event_type as host, ts, value from events),
f as (select *, lag(host) over (partition by user order by tus, event) as prev_host from e),
r as (select *, sum(case when host = prev_host then 0 else 1 end) over (partition by user order by tus, event) as run from f),
s0 as (select user, cast(run as bigint) as run, min(host) as host, min(tus) as start, max(tus) as last, count(*) as n from r group by user, run),
s as (select *, lead(host) over w as next_host, lag(host) over w as prev_host, (start - lag(start) over w) / 1000000.0 as prev_seconds,
  coalesce(lead(start) over w, last) - start as until, case when coalesce(lead(start) over w, last) - start <= 0 then 1.0 else (coalesce(lead(start) over w, last) - start) / 1000000.0 end as seconds,
  greatest(1.0, (last - start) / 1000000.0) as active_seconds, cast(start // 86400000000 as integer) as day from s0 window w as (partition by user order by run)),
payers as (select distinct user from e where host = 'purchase'),
visitors as (select distinct user from e where host = 'click'),
people as (select c_custkey as user, c_nationkey % 5 as age, c_mktsegment as gender from customer),
led as (select prev_host as lead, count(*) as led, count(distinct s.user) as users, count(distinct p.user) as paying_users, avg(prev_seconds) as mean_seconds from s left join payers p on s.user = p.user where host = 'click' and prev_host is not null group by 1),
hv as (select host, count(distinct user) as visitors from s group by 1),
rating as (select lead, (greatest(0.0, (select count(distinct user) from s where host = 'click')) / greatest(1.0, visitors)) * ((select count(*) from payers) / greatest(1.0, paying_users)) / greatest(1.0, mean_seconds) as rating from led join hv on lead = host),
cal as (select cast(x as date) as holiday from (values ('2024-01-01'), ('2024-01-06'), ('2024-01-15')) v(x))
"""


def events(spark, d):
    return S.ordered_events(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


def sessions(spark, d):
    return S.sessions(events(spark, d))


def stored_sessions(spark, d):
    """The sessions, written once, for queries that use them several times."""
    return written(sessions(spark, d), "sessions")


def payers(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("user")).distinct()


def visitors(spark, d):
    return table(spark, d, "events").where(F.col("event_type") == TARGET).select(F.col("user_id").alias("user")).distinct()


def people(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user"), (F.col("c_nationkey") % 5).alias("age"), F.col("c_mktsegment").alias("gender"))


def calendar(spark):
    return spark.createDataFrame([("2024-01-01",), ("2024-01-06",), ("2024-01-15",)], "day string")


def is_buy():
    return F.col("event_type") == "purchase"


@query("prev_event", BASE + "select event, prev_host from f")
def prev_event(spark, d):
    return S.with_previous(events(spark, d)).select("event", "prev_host")


@query("domain_sessions", BASE + "select user, run, host, start, n from s")
def domain_sessions(spark, d):
    return sessions(spark, d).select("user", "run", "host", "start", "n")


@query("session_durations", BASE + "select user, run, round(seconds, 6) as seconds from s")
def session_durations(spark, d):
    return sessions(spark, d).select("user", "run", F.round("seconds", 6).alias("seconds"))


@query("prev_diff_page", BASE + "select event, s.prev_host as prev_page from r join s on r.user = s.user and r.run = s.run")
def prev_diff_page(spark, d):
    e = events(spark, d)
    runs = S.sessions(e).select("user", "run", F.col("prev_host").alias("prev_page"))
    return S.host_runs(e).select("user", "run", "event").join(runs, ["user", "run"]).select("event", "prev_page")


@query("between_sessions", BASE + """, m as (select user, coalesce(sum(prev_seconds), 0) / greatest(count(prev_seconds), 1) as m from s group by 1)
select user, round(m, 4) as mean_seconds, round(case when m = 0 then 0.0 else 1 - m / 604800 end, 6) as closeness from m""")
def between_sessions(spark, d):
    return S.between_sessions(events(spark, d)).select("user", F.round("mean_seconds", 4).alias("mean_seconds"), F.round("closeness", 6).alias("closeness"))


@query("active_time", BASE + "select user, round(sum(active_seconds), 6) as active from s group by 1")
def active_time(spark, d):
    return sessions(spark, d).groupBy("user").agg(F.round(F.sum("active_seconds"), 6).alias("active"))


@query("total_period", BASE + "select user, round((max(tus) - min(tus)) / 1000000.0, 6) as period from e group by 1")
def total_period(spark, d):
    return events(spark, d).groupBy("user").agg(F.round((F.max("at") - F.min("at")) / S.SECOND, 6).alias("period"))


@query("new_day_count", BASE + "select user, count(distinct day) as days from e where host = 'click' group by 1")
def new_day_count(spark, d):
    visits = events(spark, d).where(F.col("host") == TARGET).groupBy("user", "day").agg(F.min("at").alias("at"))
    w = W.partitionBy("user").orderBy("at")
    flags = visits.withColumn("new", F.coalesce((F.col("day") != F.lag("day").over(w)).cast("long"), F.lit(1)))
    return flags.groupBy("user").agg(F.sum("new").alias("days"))


@query("earlier_flag", BASE + "select event, coalesce(max(case when host = 'signup' then 1 else 0 end) over (partition by user, day order by tus, event rows between unbounded preceding and 1 preceding), 0) as earlier from e qualify host = 'click'")
def earlier_flag(spark, d):
    rows = S.running_flag(events(spark, d), F.col("host") == MOBILE, "earlier", same_day=True, include_current=False)
    return rows.where(F.col("host") == TARGET).select("event", "earlier")


@query("running_paying", BASE + "select event, max(case when host = 'purchase' then 1 else 0 end) over (partition by user order by tus, event) as paying from e")
def running_paying(spark, d):
    return S.running_flag(events(spark, d), F.col("host") == "purchase", "paying").select("event", "paying")


#: Events of which some have no user, or no time.
ODD = """with o as (select event_id as event, case when event_id % 7 > 0 then user_id end as user, case when event_id % 11 > 0 then ts end as ts, event_type as host, value from events)"""


def odd_events(spark, d):
    df = table(spark, d, "events")
    return df.withColumns({"user_id": F.when(F.col("event_id") % 7 > 0, F.col("user_id")), "ts": F.when(F.col("event_id") % 11 > 0, F.col("ts"))})


@query("prev_event_nulls", ODD + "select event, lag(host) over (partition by user order by ts nulls first, event) as prev_host from o")
def prev_event_nulls(spark, d):
    """Events without a user are one user's, those without a time come first."""
    df = odd_events(spark, d)
    return S.with_previous(S.ordered_events(df, "user_id", "ts", "event_id", "event_type")).select("event", "prev_host")


@query("running_flag_nulls", ODD + "select event, max(case when host = 'purchase' then 1 else 0 end) over (partition by user order by ts nulls first, event) as paying from o")
def running_flag_nulls(spark, d):
    events = S.ordered_events(odd_events(spark, d), "user_id", "ts", "event_id", "event_type")
    return S.running_flag(events, F.col("host") == "purchase", "paying").select("event", "paying")


@query("two_pass_nulls", ODD + "select event, round(value / nullif(sum(value) over (partition by user), 0), 6) as share, count(*) over (partition by user) as n from o")
def two_pass_nulls(spark, d):
    statistics = {"total": F.sum("value"), "n": F.count("*")}
    df = aggregates.two_pass(odd_events(spark, d), ["user_id"], statistics, {"share": F.round(F.col("value") / F.nullif(F.col("total"), F.lit(0)), 6), "n": F.col("n")})
    return df.select(F.col("event_id").alias("event"), "share", "n")


@query("first_per_host", BASE + "select user, host, event from e qualify row_number() over (partition by user, host order by tus, event) = 1")
def first_per_host(spark, d):
    return events(spark, d).groupBy("user", "host").agg(F.min_by("event", F.struct("at", "event")).alias("event"))


@query("pairwise_diff", "select event_id, round(value - lag(value) over (partition by user_id order by ts, event_id), 2) as diff from events")
def pairwise_diff(spark, d):
    df = table(spark, d, "events")
    out = P.pairwise(df, ["user_id"], F.to_date("ts"), ["ts", "event_id"], "before", F.col("value"), "diff", lambda a, b: F.round(b - a, 2))
    return out.select("event_id", "diff")


@query("session_sets", BASE + """, p as (select user, day, cast(max(case when host = 'purchase' then 1 else 0 end) as integer) as paying from e group by 1, 2)
select p.user, p.day, paying, string_agg(s.host, '>' order by start) as hosts, round(sum(seconds), 6) as seconds, cast(p.day - (p.day + 3) % 7 as integer) as week from p join s on p.user = s.user and p.day = s.day group by 1, 2, 3""")
def session_sets(spark, d):
    df = S.session_sets(events(spark, d), F.col("host") == "purchase")
    total = F.aggregate("sessions.seconds", F.lit(0.0), lambda a, x: a + x)
    return df.select("user", F.unix_date("day").alias("day"), "paying", F.array_join("sessions.host", ">").alias("hosts"), F.round(total, 6).alias("seconds"), F.unix_date("week").alias("week"))


@query("positional_sample", "with n as (select count(*) as n from events) select event_id from (select event_id, row_number() over (order by ts, event_id) - 1 as pos from events), n where pos = cast(floor(0.8 * n) as bigint)")
def positional_sample(spark, d):
    return at_position(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], 0.8).select("event_id")


@query("top_k_pages", BASE + "select host, count(*) as visits from s group by 1 order by visits desc, host limit 3")
def top_k_pages(spark, d):
    return sessions(spark, d).groupBy("host").agg(F.count("*").alias("visits")).orderBy(F.desc("visits"), "host").limit(3)


HOLIDAY = "cast(ts as date) in (select holiday from cal)"
BEFORE = "cast(ts as date) + 1 in (select holiday from cal)"


@query("holiday_flags", BASE + f"select event, {HOLIDAY} as is_holiday, {BEFORE} as before_holiday, dayofweek(ts) in (0, 6) as weekend, dayofweek(ts) = 5 as before_weekend from e")
def holiday_flags(spark, d):
    df = times.with_holidays(table(spark, d, "events"), "ts", calendar(spark))
    return df.select(F.col("event_id").alias("event"), "is_holiday", "before_holiday", times.is_weekend(F.col("ts")).alias("weekend"), times.before_weekend(F.col("ts")).alias("before_weekend"))


#: Orthodox Easter of ``y``, by another form of the rule: the Julian date, thirteen days later in these years.
EASTER = "make_date(y::bigint, ((d + e + 114) // 31)::bigint, ((d + e + 114) % 31 + 1)::bigint) + 13"


@query("holiday_rules", f"""with years as (select distinct year(o_orderdate) as y from orders), d as (select y, (19 * (y % 19) + 15) % 30 as d from years), e as (select y, d, (2 * (y % 4) + 4 * (y % 7) - d + 34) % 7 as e from d),
fixed as (select make_date(y, m, x) as day from years, (values (1, 1), (3, 3), (5, 6), (5, 24), (9, 6), (9, 22), (11, 1), (12, 24), (12, 25), (12, 26)) v(m, x) union all select cast({EASTER} as date) from e),
off as (select case dayofweek(day) when 6 then day - 1 when 0 then day + 1 else day end as day from fixed),
labour as (select make_date(y, 5, 1) + cast((8 - isodow(make_date(y, 5, 1))) % 7 as integer) as day from years),
days as (select cast(day as date) as day from off union select cast(day as date) from labour)
select o_orderkey, cast(o_orderdate as date) in (select day from days) as is_holiday, cast(o_orderdate as date) + 1 in (select day from days) as before_holiday from orders""")
def holiday_rules(spark, d):
    """Orders on holidays, and on days before one, by a calendar that rules make for the years of the orders."""
    df = table(spark, d, "orders")
    first, last = df.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    return times.with_holidays(df, "o_orderdate", times.holiday_calendar(spark, first, last)).select("o_orderkey", "is_holiday", "before_holiday")


CLASS = BASE + f", c as (select user, case when {HOLIDAY} then 'holiday' when {BEFORE} then 'before_holiday' when dayofweek(ts) = 5 then 'before_weekend' when dayofweek(ts) in (0, 6) then 'weekend' else 'none' end as purchase_class from e where host = 'purchase') "


@query("purchase_classes", CLASS + "select user, purchase_class, count(*) as n from c group by 1, 2")
def purchase_classes(spark, d):
    df = K.purchase_classes(table(spark, d, "events"), "ts", is_buy(), calendar(spark))
    return df.groupBy(F.col("user_id").alias("user"), "purchase_class").agg(F.count("*").alias("n"))


@query("purchase_rates", CLASS + "select purchase_class, count(*) as n, count(distinct user) as users, round(count(*) / (select count(*) from c), 6) as rate from c group by 1")
def purchase_rates(spark, d):
    df = K.purchase_rates(K.purchase_classes(table(spark, d, "events"), "ts", is_buy(), calendar(spark)), "user_id")
    return df.withColumn("rate", F.round("rate", 6))


@query("user_browsing_stats", BASE + """select user, round(sum(seconds), 6) as browsing_seconds, round(sum(case when host = 'click' then seconds else 0 end), 6) as target_seconds,
  round(sum(case when host = 'signup' then seconds else 0 end), 6) as mobile_seconds, count(*) filter (where host = 'click') as target_visits, count(*) filter (where host = 'click' and prev_host is not null) as transitions_in,
  round(coalesce(sum(prev_seconds) filter (where host = 'click'), 0), 6) as transition_seconds from s group by 1""")
def user_browsing_stats(spark, d):
    df = K.user_stats(sessions(spark, d), TARGET, MOBILE)
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("seconds")})


_HOST = "count(*) as visits, count(distinct user) as visitors, count(next_host) as transitions, round(coalesce(sum(cast(round(seconds * 1000000) as hugeint)) filter (where next_host is not null), 0) / 1000000.0, 6) as transition_seconds from s"


@query("host_stats", BASE + f"select host, {_HOST} group by 1 union all select 'global', {_HOST} union all select 'mobile', {_HOST} where host = 'signup'")
def host_stats(spark, d):
    return K.host_stats(stored_sessions(spark, d), MOBILE).withColumn("transition_seconds", F.round("transition_seconds", 6))


@query("host_user_visits", BASE + """select host, user, count(*) as visits, round(sum(seconds), 6) as total_seconds, round(avg(seconds), 1) as mean_seconds,
  count(next_host) as transitions, round(sum(seconds) / greatest(1.0, count(next_host)), 4) as seconds_per_transition from s group by 1, 2""")
def host_user_visits(spark, d):
    df = K.host_user_visits(sessions(spark, d))
    return df.withColumns({"total_seconds": F.round("total_seconds", 6), "mean_seconds": F.round("mean_seconds", 1), "seconds_per_transition": F.round("seconds_per_transition", 4)})


@query("leading_pages", BASE + "select lead, led, users, paying_users, round(mean_seconds, 1) as mean_seconds from led")
def leading_pages(spark, d):
    return K.leading_pages(sessions(spark, d), TARGET, payers(spark, d)).withColumn("mean_seconds", F.round("mean_seconds", 1))


@query("cross_page_totals", BASE + "select count(prev_host) as transitions, count(distinct user) filter (where host = 'click') as target_visitors, round(count(*) / count(distinct user), 6) as mean_visits from s")
def cross_page_totals(spark, d):
    return sessions(spark, d).agg(F.count("prev_host").alias("transitions"), F.count_distinct(F.when(F.col("host") == TARGET, F.col("user"))).alias("target_visitors"), F.round(F.count("*") / F.count_distinct("user"), 6).alias("mean_visits"))


def ratings(spark, d, s=None):
    return K.page_ratings(stored_sessions(spark, d) if s is None else s, TARGET, payers(spark, d))


@query("page_rating", BASE + "select lead, round(rating, 8) as rating from rating")
def page_rating(spark, d):
    return ratings(spark, d).withColumn("rating", F.round("rating", 8))


@query("mean_rating", BASE + "select user, round(avg(rating), 8) as mean_rating, count(*) as rated_hosts from (select distinct user, host from s) join rating on host = lead group by 1")
def mean_rating(spark, d):
    s = stored_sessions(spark, d)
    return K.mean_rating(s, ratings(spark, d, s)).withColumn("mean_rating", F.round("mean_rating", 8))


@query("high_rank_features", BASE + """, top as (select lead, row_number() over (order by rating desc, lead) as rank from rating order by rating desc, lead limit 2)
select user, round(sum(case when rank = 1 then seconds else 0 end), 6) as rank_1_seconds, round(sum(case when rank = 2 then seconds else 0 end), 6) as rank_2_seconds from s left join top on host = lead group by 1""")
def high_rank_features(spark, d):
    s = stored_sessions(spark, d)
    df = K.high_rank_features(s, ratings(spark, d, s), 2)
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c != "user"})


@query("demographic_counts", BASE + "select age, gender, count(*) as visitors, count(payers.user) as buyers from people join visitors using (user) left join payers on people.user = payers.user group by grouping sets ((age, gender), (age), (gender), ())")
def demographic_counts(spark, d):
    return K.demographic_counts(people(spark, d), visitors(spark, d), payers(spark, d))


def _rates(by: str) -> str:
    return f"select '{by}' as kind, cast({by} as varchar) as grp, round(count(v.user) / greatest(1.0, count(*)), 6) as p_visit, round(count(*) filter (where v.user is not null and p.user is not null) / greatest(1.0, count(v.user)), 6) as p_buy from people left join visitors v on people.user = v.user left join payers p on people.user = p.user group by 2"


@query("conditional_rates", BASE + _rates("age") + " union all " + _rates("gender"))
def conditional_rates(spark, d):
    who, seen, paid = people(spark, d), visitors(spark, d), payers(spark, d)
    part = lambda by: K.conditional_rates(who, seen, paid, by).select(F.lit(by).alias("kind"), F.col(by).cast("string").alias("grp"), F.round("p_visit", 6).alias("p_visit"), F.round("p_buy", 6).alias("p_buy"))
    return part("age").union(part("gender"))


@query("buy_visit_probability", BASE + """, v as (select user, count(*) as n from s where host = 'click' group by 1), b as (select user, count(*) as n from e where host = 'purchase' group by 1),
x as (select age, gender, v.n as visits, coalesce(b.n, 0) as buys, count(*) over (partition by age, gender) as same, count(*) over () as total from people join v using (user) left join b on people.user = b.user)
select round(sum(buys / greatest(1.0, visits) * same / greatest(1.0, total)), 6) as probability from x""")
def buy_visit_probability(spark, d):
    visits = sessions(spark, d).where(F.col("host") == TARGET).groupBy("user").agg(F.count("*").alias("n"))
    buys = events(spark, d).where(F.col("host") == "purchase").groupBy("user").agg(F.count("*").alias("n"))
    return K.buy_visit_probability(people(spark, d), visits, buys).select(F.round("probability", 6).alias("probability"))


@query("purchase_windows", BASE + f""", k as (select user, case when cast(ts as date) > date '2024-01-28' - 7 then 'week' when cast(ts as date) > date '2023-12-28' then 'month'
  when cast(ts as date) > date '2023-01-28' then 'year' when month(ts) = 1 then 'this_month' when {HOLIDAY} then 'holiday' when {BEFORE} then 'before_holiday'
  when dayofweek(ts) in (0, 6) then 'weekend' when dayofweek(ts) = 5 then 'before_weekend' else 'none' end as kind from e where host = 'purchase')
select user, count(*) as purchases, """ + ", ".join(f"round(count(*) filter (where kind = '{k}') / count(*), 6) as share_{k}" for k in K.PURCHASE_WINDOWS) + " from k group by 1")
def purchase_windows(spark, d):
    df = K.purchase_windows(table(spark, d, "events"), "user_id", "ts", is_buy(), "2024-01-28", calendar(spark))
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith("share")})


@query("visit_ratios", BASE + """, x as (select user, day, count(*) filter (where host = 'click') as t, count(*) filter (where host = 'signup') as m, max(case when host = 'view' then 1 else 0 end) as p from s group by 1, 2)
select user, round(sum(m) / greatest(1.0, sum(t)), 6) as mobile_ratio, round(count(*) filter (where t > 0) / greatest(1.0, count(*)), 6) as day_ratio, cast(max(p) as integer) as saw_promotion from x group by 1""")
def visit_ratios(spark, d):
    df = K.visit_ratios(sessions(spark, d), TARGET, MOBILE, PROMOTION)
    return df.withColumns({c: F.round(c, 6) for c in ("mobile_ratio", "day_ratio")})


@query("top_values_onehot", """with p as (select user_id as user, event_type || '_' || props as pair from events), top as (select pair, row_number() over (order by count(*) desc, pair) as rank from p group by pair order by count(*) desc, pair limit 3)
select user, """ + ", ".join(f"cast(max(case when rank = {i} then 1 else 0 end) as integer) as top_{i}" for i in (1, 2, 3)) + " from p left join top using (pair) group by 1")
def top_values_onehot(spark, d):
    return K.top_values_one_hot(table(spark, d, "events"), "user_id", "event_type", "props", 3)


#: Chains of sites, their prefixes as text, and their nodes as in ``paths.nodes``; trees over all, the first and the second half.
PATHS = BASE + """, c as (select user, day, list(host order by run) as sites, list(seconds order by run) as times from s group by 1, 2),
x as (select user, day, sites, times, unnest(range(1, len(sites) + 1)) as depth from c),
p as (select user, day, array_to_string(sites[1:depth], '>') as prefix, depth, times[depth] as seconds from x),
tree as (select prefix, depth, count(*) as visits, avg(seconds) as mean_seconds from p group by 1, 2),
early as (select prefix, depth, count(*) as visits, avg(seconds) as mean_seconds from p where day < 19738 group by 1, 2),
late as (select prefix, depth, count(*) as visits, avg(seconds) as mean_seconds from p where day >= 19738 group by 1, 2),
o as (select user, day, run, host as site, seconds, row_number() over (partition by user, day order by run) as depth from s),
m as (select *, md5(concat_ws(':', depth, site)) as m from o),
n0 as (select *, cast(sum(cast('0x' || m[1:15] as bigint)) over w as varchar) || ':' || cast(sum(cast('0x' || m[16:30] as bigint)) over w as varchar) as node from m window w as (partition by user, day order by run)),
n as (select *, lag(node) over (partition by user, day order by run) as parent from n0) """
HALF = "2024-01-16"


def nodes(spark, d):
    return written(T.nodes(sessions(spark, d)), "nodes")


_TREE = PATHS + "select node, parent, site, cast(depth as integer) as depth, count(*) as visits, round(avg(seconds), 1) as mean_seconds from n group by all"


@query("path_prefixes", _TREE)
@query("whole_path_prefixes", _TREE)
def path_prefixes(spark, d):
    return T.tree(T.nodes(sessions(spark, d))).drop("chain").withColumn("mean_seconds", F.round("mean_seconds", 1))


_LONGEST = PATHS + "select prefix, cast(depth as integer) as depth, visits from tree order by depth desc, visits desc, prefix desc limit 1"


@query("longest_path", _LONGEST)
@query("whole_longest_path", _LONGEST)
def longest_path(spark, d):
    rows = nodes(spark, d)
    return T.longest(T.tree(rows), rows).select("prefix", "depth", "visits")


def _halves(spark, d):
    rows = nodes(spark, d)
    cut = F.lit(HALF).cast("date")
    return rows.where(F.col("day") < cut), rows.where(F.col("day") >= cut)


@query("common_path", PATHS + """select prefix, cast(early.depth as integer) as depth, early.visits as visits, late.visits as visits_b from early join late using (prefix)
order by early.depth desc, early.visits desc, prefix desc limit 1""")
def common_path(spark, d):
    a, b = _halves(spark, d)
    return T.longest_common(T.tree(a), a, T.tree(b))


@query("whole_common_path", PATHS + """select node, min(site) as site, cast(depth as integer) as depth, count(*) filter (where day < 19738) as visits, count(*) filter (where day >= 19738) as visits_b
from n group by node, depth having count(distinct day < 19738) = 2""")
def whole_common_path(spark, d):
    return T.shared(*map(T.tree, _halves(spark, d))).select("node", "site", "depth", "visits", "visits_b")


def _ic(rows: str, weight: str = "visits") -> str:
    """SQL of the entropy of the weights along the longest path of a tree."""
    deepest = f"(select prefix from {rows} order by depth desc, visits desc, prefix desc limit 1)"
    return f"(select coalesce(case when sum({weight}) > 0 then ln(sum({weight})) - sum({weight} * ln({weight})) / sum({weight}) else 0 end, 0) from {rows} where starts_with({deepest} || '>', prefix || '>'))"


def _lin(weight: str) -> str:
    top, bottom = _ic("shared", weight), f"({_ic('early', weight)} + {_ic('late', weight)})"
    return PATHS + f", shared as (select * from early where prefix in (select prefix from late)) select round(2 * {top} / {bottom}, 6) as similarity"


def _of_halves(spark, d, weight):
    a, b = _halves(spark, d)
    return T.lin_similarity(T.tree(a), a, T.tree(b), b, weight=weight).select(F.round("similarity", 6).alias("similarity"))


@query("lin_similarity", _lin("visits"))
@query("whole_lin_similarity", _lin("visits"))
def lin_similarity(spark, d):
    return _of_halves(spark, d, "visits")


@query("lin_similarity_time", _lin("mean_seconds"))
def lin_similarity_time(spark, d):
    return _of_halves(spark, d, "mean_seconds")


def _by_user(rows: str, weight: str = "visits") -> str:
    return f"""select user, case when sum({weight}) > 0 then ln(sum({weight})) - sum({weight} * ln({weight})) / sum({weight}) else 0 end as ic
  from (select *, first_value(prefix) over (partition by user order by depth desc, visits desc, prefix desc) as deepest from {rows}) where starts_with(deepest || '>', prefix || '>') group by 1"""


def _scores(cohort: str, weight: str = "visits") -> str:
    """SQL of each user's similarity with a tree."""
    return f"""select a.user, round(case when a.ic + {_ic(cohort, weight)} > 0 then 2 * coalesce(k.ic, 0) / (a.ic + {_ic(cohort, weight)}) else 0 end, 6) as similarity
  from ({_by_user("t", weight)}) a left join ({_by_user(f"(select * from t where prefix in (select prefix from {cohort}))", weight)}) k on a.user = k.user"""


_COHORT = PATHS + """, cohort as (select prefix, depth, count(*) as visits from p where user in (select user from payers) group by 1, 2),
t as (select user, prefix, depth, count(*) as visits from p group by 1, 2, 3) """ + _scores("cohort")


@query("cohort_similarity", _COHORT)
@query("whole_cohort_similarity", _COHORT)
def cohort_similarity(spark, d):
    rows = nodes(spark, d)
    cohort = rows.join(payers(spark, d), "user", "left_semi")
    return T.lin_similarity(T.tree(rows, "user"), rows, T.tree(cohort), cohort, "user").withColumn("similarity", F.round("similarity", 6))


_COHORT_TREES = PATHS + """select case when payers.user is null then 'other' else 'paying' end as cohort, node, parent, site, cast(depth as integer) as depth, count(*) as visits
from n left join payers on n.user = payers.user group by all"""


@query("cohort_trees", _COHORT_TREES)
@query("whole_cohort_trees", _COHORT_TREES)
def cohort_trees(spark, d):
    rows = T.nodes(sessions(spark, d)).join(payers(spark, d).withColumn("pays", F.lit(1)), "user", "left")
    rows = rows.withColumn("cohort", F.when(F.col("pays") == 1, "paying").otherwise("other"))
    return T.tree(rows, "cohort").select("cohort", "node", "parent", "site", "depth", "visits")


#: Cohorts of days: those that pay, and those of the week from SINCE on, without and with a payment.
SINCE = "2024-01-16"
COHORTS = ("paying", "not_paying_since", "paying_since")
_PAID = """, paid as (select user, day, max(case when host = 'purchase' then 1 else 0 end) as paying from e group by 1, 2),
dc as (select user, day, unnest(list_filter([case when paying = 1 then 'paying' end, case when paying = 0 and day between 19738 and 19745 then 'not_paying_since' end,
  case when paying = 1 and day between 19738 and 19745 then 'paying_since' end], lambda x: x is not null)) as cohort from paid) """


def _dated(spark, d, rows):
    """The nodes of every cohort of days."""
    days = events(spark, d).groupBy("user", "day").agg(F.max((F.col("host") == "purchase").cast("int")).alias("paying"))
    week = F.col("day").between(F.lit(SINCE).cast("date"), F.date_add(F.lit(SINCE).cast("date"), 7))
    pays = F.col("paying") == 1
    kinds = F.array_compact(F.array(F.when(pays, COHORTS[0]), F.when(~pays & week, COHORTS[1]), F.when(pays & week, COHORTS[2])))
    return rows.join(days.select("user", "day", F.explode(kinds).alias("cohort")), ["user", "day"])


@query("dated_cohort_trees", PATHS + _PAID + "select cohort, node, parent, site, cast(depth as integer) as depth, count(*) as visits from n join dc using (user, day) group by all")
def dated_cohort_trees(spark, d):
    return T.tree(_dated(spark, d, T.nodes(sessions(spark, d))), "cohort").select("cohort", "node", "parent", "site", "depth", "visits")


@query("dated_cohort_similarity", PATHS + _PAID + ", t as (select user, prefix, depth, count(*) as visits, avg(seconds) as mean_seconds from p group by 1, 2, 3), "
       + ", ".join(f"k{i} as (select prefix, depth, count(*) as visits, avg(seconds) as mean_seconds from p join dc using (user, day) where cohort = '{c}' group by 1, 2)" for i, c in enumerate(COHORTS))
       + " union all ".join(f" select '{c}' as cohort, '{w}' as weight, * from ({_scores(f'k{i}', w)})" for i, c in enumerate(COHORTS) for w in ("visits", "mean_seconds")))
def dated_cohort_similarity(spark, d):
    """Each user against each cohort of days, by visits and by time."""
    rows = nodes(spark, d)
    own, dated = written(T.tree(rows, "user"), "user-trees"), written(_dated(spark, d, rows), "dated-nodes")
    out = None
    for cohort in COHORTS:
        members = dated.where(F.col("cohort") == cohort)
        for weight in ("visits", "mean_seconds"):
            part = T.lin_similarity(own, rows, T.tree(members), members, "user", weight=weight)
            part = part.select(F.lit(cohort).alias("cohort"), F.lit(weight).alias("weight"), "user", F.round("similarity", 6).alias("similarity"))
            out = part if out is None else out.union(part)
    return out


def _share(column: str, n: str, name: str) -> str:
    return f"round(coalesce({column}, 0) / greatest(1.0, coalesce({n}, 0)), 6) as {name}"


def _sum_of(flag: str, name: str) -> str:
    return f"count(*) filter (where {flag}) as {name}"


#: Feature rows as of a year after the events, so that some purchases are in the windows behind the first three.
_USER_ROWS = BASE + f"""
, b as (select user, count(*) as events, floor((max(tus) - min(tus)) / 86400000000.0) as period, max(case when host = 'purchase' then 1 else 0 end) as is_paying, max(case when host = 'click' then 1 else 0 end) as visited_target,
  max(case when host = 'signup' then 1 else 0 end) as is_from_mobile, max(case when host = 'view' then 1 else 0 end) as saw_promotion from e group by 1),
vd as (select distinct user, cast(ts as date) as ts from e where host = 'click'),
vk as (select user, case when dayofweek(ts) = 5 then 'before_weekend' when dayofweek(ts) in (0, 6) then 'weekend' when {BEFORE} then 'before_holiday' when {HOLIDAY} then 'holiday' else 'none' end as kind from vd),
v as (select user, count(*) as days_visited, {", ".join(_sum_of(f"kind = '{k}'", f"visits_{k}") for k in U.DAY_KINDS)} from vk group by 1),
pk as (select user, prev_host, case when cast(ts as date) > date '2025-01-28' - 7 then 'week' when cast(ts as date) > date '2024-12-28' then 'month' when cast(ts as date) > date '2024-01-28' then 'year' when month(ts) = 1 then 'this_month'
  when {HOLIDAY} then 'holiday' when {BEFORE} then 'before_holiday' when dayofweek(ts) in (0, 6) then 'weekend' when dayofweek(ts) = 5 then 'before_weekend' else 'none' end as kind from f where host = 'purchase'),
k as (select user, count(*) as purchases, {_sum_of("prev_host = 'signup'", "mobile_buys")}, {", ".join(_sum_of(f"kind = '{k}'", f"bought_{k}") for k in K.PURCHASE_WINDOWS)} from pk group by 1),
ef as (select user, host, coalesce(max(case when host = 'signup' then 1 else 0 end) over (partition by user, day order by tus, event rows between unbounded preceding and 1 preceding), 0) as earlier from e),
mb as (select user, max(earlier) as mobile_before_target from ef where host = 'click' group by 1),
tm as (select user, count(*) as sessions, sum(active_seconds) as online, count(*) filter (where dayofweek(make_timestamp(start)) in (0, 6)) as weekend_sessions, {_sum_of("host = 'signup'", "mobile_sessions")}, {_sum_of("host = 'click'", "target_visits")},
  sum(case when host = 'click' then seconds else 0 end) as target_seconds, sum(case when host = 'signup' then seconds else 0 end) as mobile_seconds, coalesce(sum(prev_seconds), 0) / greatest(count(prev_seconds), 1) as gap from s group by 1),
best as (select lead from rating order by rating desc, lead limit 5),
bs as (select user, sum(seconds) as best_seconds from s where host in (select lead from best) group by 1),
mr as (select user, avg(rating) as page_rank from (select distinct user, host from s) join rating on host = lead group by 1),
mv as (select count(*) / greatest(1, count(distinct user)) as mean_visits from s),
g as (select p.user, age, gender, case when v.user is null then 0 else 1 end as sees, case when y.user is null then 0 else 1 end as buys from people p left join visitors v on p.user = v.user left join payers y on p.user = y.user),
ga as (select age, sum(buys) / count(*) as p_buy_age, sum(sees) / (select count(*) from people) as p_visit_age from g group by 1),
gg as (select gender, sum(buys) / count(*) as p_buy_gender, sum(sees) / (select count(*) from people) as p_visit_gender from g group by 1)
select b.user, is_paying, visited_target, is_from_mobile, saw_promotion, coalesce(mobile_before_target, 0) as mobile_before_target, {_share("events", "period", "visits_per_day")}, {_share("days_visited", "period", "days_visited")},
  {", ".join(_share(f"visits_{k}", "period", f"visits_{k}") for k in U.DAY_KINDS)}, {", ".join(_share(f"bought_{k}", "purchases", f"bought_{k}") for k in K.PURCHASE_WINDOWS)}, {_share("mobile_buys", "purchases", "mobile_purchases")},
  {_share("mobile_sessions", "target_visits", "mobile_visits")}, {_share("target_seconds", "target_visits", "time_before_leaving")}, round(online / 86400 * 7, 6) as time_online, {_share("mobile_seconds", "online", "share_mobile")},
  {_share("target_seconds", "online", "share_target")}, {_share("best_seconds", "online", "share_best_rated")}, {_share("weekend_sessions", "sessions", "p_online_weekend")}, {_share("target_visits", "mean_visits", "p_to_go_online")},
  {_share("purchases", "target_visits", "buys_per_visit")}, round(coalesce(page_rank, 0), 6) as page_rank, round(case when gap = 0 then 0.0 else 1 - gap / 604800 end, 6) as between_visits,
  {", ".join(f"round(coalesce({p}, 0), 6) as {p}" for p in ("p_buy_age", "p_visit_age", "p_buy_gender", "p_visit_gender"))}
from b left join v on b.user = v.user left join k on b.user = k.user left join mb on b.user = mb.user left join tm on b.user = tm.user left join bs on b.user = bs.user left join mr on b.user = mr.user cross join mv
  left join people on b.user = people.user left join ga on people.age = ga.age left join gg on people.gender = gg.gender"""


@query("user_features", _USER_ROWS)
def user_features(spark, d):
    s = stored_sessions(spark, d)
    hosts = {"target": TARGET, "mobile": MOBILE, "promotion": PROMOTION, "pay": "purchase"}
    df = U.user_features(events(spark, d), s, people(spark, d), ratings(spark, d, s), calendar(spark), hosts, "2025-01-28")
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("ratio_max", BASE + "select round(max(t / b), 6) as best from (select user, sum(case when host = 'click' then seconds else 0 end) as t, sum(seconds) as b from s group by 1) where user in (select user from payers)")
def ratio_max(spark, d):
    stats = K.user_stats(sessions(spark, d), TARGET, MOBILE).join(payers(spark, d), "user", "left_semi")
    return stats.agg(F.round(F.max(F.col("target_seconds") / F.col("browsing_seconds")), 6).alias("best"))


@query("flat_session_export", BASE + "select user, host as domain, round(seconds, 6) as duration, start from s where user in (select user from payers)")
def flat_session_export(spark, d):
    rows = sessions(spark, d).join(payers(spark, d), "user", "left_semi")
    return rows.select("user", F.col("host").alias("domain"), F.round("seconds", 6).alias("duration"), "start")


@query("appended_visits", BASE + "select user, day, string_agg(host, ',' order by tus, event) || ',end' as hosts from e group by 1, 2")
def appended_visits(spark, d):
    """The visits of a day, so that no list is as long as a history."""
    rows = events(spark, d).groupBy("user", "day").agg(F.array_sort(F.collect_list(F.struct("at", "event", "host"))).alias("v"))
    return rows.select("user", F.unix_date("day").alias("day"), F.array_join(F.array_append("v.host", F.lit("end")), ",").alias("hosts"))
