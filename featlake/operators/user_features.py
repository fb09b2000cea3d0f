"""The feature row of a user: visits, purchases, time and ratings in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import guarded
from ..functions.times import before_weekend, is_weekend, with_holidays
from .clickstream import PURCHASE_WINDOWS, group_rates, mean_rating, purchase_kinds, user_stats
from .sessions import SECOND, between_sessions_of, running_flag, with_previous

#: Kinds of days, in the order in which they are tried.
DAY_KINDS = ("before_weekend", "weekend", "before_holiday", "holiday")


def _day_kind(day: Column) -> Column:
    kind = F.when(before_weekend(day), DAY_KINDS[0]).when(is_weekend(day), DAY_KINDS[1])
    return kind.when(F.col("before_holiday"), DAY_KINDS[2]).when(F.col("is_holiday"), DAY_KINDS[3]).otherwise("none")


def user_features(events: DataFrame, sessions: DataFrame, people: DataFrame, ratings: DataFrame, calendar: DataFrame, hosts: dict[str, str], as_of: str, best: int = 5) -> DataFrame:
    """A row per user of ``events`` (see ``sessions.ordered_events``).

    ``hosts`` names the ``target``, ``mobile``, ``promotion`` and ``pay`` hosts,
    ``people`` has user, age and gender, ``ratings`` lead and rating. Ratios have
    divisors of 1 at least; what a user has not done is 0. Every part is one
    aggregation by user, and parts are joined by user.
    """
    at_host = lambda k: F.col("host") == hosts[k]
    seen = lambda k: F.max(at_host(k).cast("int"))
    days = F.floor((F.max("at") - F.min("at")) / (86_400 * SECOND))
    base = events.groupBy("user").agg(
        F.count("*").alias("events"), days.cast("long").alias("period_days"), seen("pay").alias("is_paying"), seen("target").alias("visited_target"),
        seen("mobile").alias("is_from_mobile"), seen("promotion").alias("saw_promotion"),
    )
    period = F.greatest(F.lit(1.0), F.col("period_days").cast("double"))

    # Days with a visit of the target, by kind.
    visited = with_holidays(events.where(at_host("target")).select("user", "day").distinct(), "day", calendar)
    visited = visited.select("user", _day_kind(F.col("day")).alias("kind"))
    visits = visited.groupBy("user").agg(F.count("*").alias("days_visited"), *[F.count_if(F.col("kind") == k).alias(f"visits_{k}") for k in DAY_KINDS])

    # Purchases by window, and those right behind a visit of the mobile site.
    bought = with_holidays(with_previous(events).where(at_host("pay")), "day", calendar)
    bought = bought.select("user", purchase_kinds(F.col("day"), as_of).alias("kind"), (F.col("prev_host") == hosts["mobile"]).alias("mobile"))
    buys = bought.groupBy("user").agg(F.count("*").alias("purchases"), F.count_if("mobile").alias("mobile_buys"), *[F.count_if(F.col("kind") == k).alias(f"bought_{k}") for k in PURCHASE_WINDOWS])

    first_mobile = running_flag(events, at_host("mobile"), "after_mobile", same_day=True, include_current=False)
    order = first_mobile.where(at_host("target")).groupBy("user").agg(F.max("after_mobile").alias("mobile_before_target"))

    weekend = is_weekend(F.timestamp_micros("start"))
    time = user_stats(sessions, hosts["target"], hosts["mobile"])
    more = sessions.groupBy("user").agg(
        F.count("*").alias("sessions"), F.sum("active_seconds").alias("online_seconds"), F.count_if(weekend).alias("weekend_sessions"), F.count_if(at_host("mobile")).alias("mobile_sessions")
    )
    top = ratings.orderBy(F.desc("rating"), "lead").limit(best)
    on_top = sessions.join(F.broadcast(top.select(F.col("lead").alias("host"))), "host").groupBy("user").agg(F.sum("seconds").alias("best_seconds"))
    rated = mean_rating(sessions, ratings).select("user", "mean_rating")
    mean_visits = sessions.agg((F.count("*") / F.greatest(F.lit(1), F.count_distinct("user"))).alias("mean_visits"))

    who = people
    visitors, payers = base.where("visited_target = 1").select("user"), base.where("is_paying = 1").select("user")
    for by in ("age", "gender"):
        who = who.join(group_rates(people, visitors, payers, by), by, "left")
    rates = [f"{p}_{by}" for by in ("age", "gender") for p in ("p_buy", "p_visit")]

    rows = base
    for part in (visits, buys, order, time, more, on_top, rated, between_sessions_of(sessions).select("user", "closeness"), who.select("user", *rates)):
        rows = rows.join(part, "user", "left")
    rows = rows.join(F.broadcast(mean_visits))
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    online, purchases = F.greatest(F.lit(1.0), n("online_seconds")), F.greatest(F.lit(1.0), n("purchases"))
    return rows.select(
        "user", "is_paying", "visited_target", "is_from_mobile", "saw_promotion", F.coalesce("mobile_before_target", F.lit(0)).alias("mobile_before_target"),
        (F.col("events") / period).alias("visits_per_day"), (n("days_visited") / period).alias("days_visited"),
        *[(n(f"visits_{k}") / period).alias(f"visits_{k}") for k in DAY_KINDS],
        *[(n(f"bought_{k}") / purchases).alias(f"bought_{k}") for k in PURCHASE_WINDOWS],
        (n("mobile_buys") / purchases).alias("mobile_purchases"), guarded(n("mobile_sessions"), n("target_visits")).alias("mobile_visits"),
        guarded(n("target_seconds"), n("target_visits")).alias("time_before_leaving"), (n("online_seconds") / 86_400 * 7).alias("time_online"),
        (n("mobile_seconds") / online).alias("share_mobile"), (n("target_seconds") / online).alias("share_target"), (n("best_seconds") / online).alias("share_best_rated"),
        guarded(n("weekend_sessions"), n("sessions")).alias("p_online_weekend"), guarded(n("target_visits"), F.col("mean_visits")).alias("p_to_go_online"),
        guarded(n("purchases"), n("target_visits")).alias("buys_per_visit"), n("mean_rating").alias("page_rank"), n("closeness").alias("between_visits"),
        *[n(r).alias(r) for r in rates],
    )
