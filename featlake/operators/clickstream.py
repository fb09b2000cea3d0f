"""Clickstream features over events and sessions (see ``sessions``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import guarded
from ..functions.times import before_weekend, is_weekend, with_holidays


def purchase_classes(df: DataFrame, ts: str, pays: Column, calendar: DataFrame) -> DataFrame:
    """Purchases with exactly one class: holiday, before_holiday, before_weekend, weekend or none, in that order."""
    rows = with_holidays(df.where(pays), ts, calendar)
    kind = F.when(F.col("is_holiday"), "holiday").when(F.col("before_holiday"), "before_holiday").when(before_weekend(F.col(ts)), "before_weekend").when(is_weekend(F.col(ts)), "weekend").otherwise("none")
    return rows.withColumn("purchase_class", kind).drop("is_holiday", "before_holiday")


def purchase_rates(classed: DataFrame, user: str) -> DataFrame:
    """Share of each class in all purchases, and its users."""
    out = classed.groupBy("purchase_class").agg(F.count("*").alias("n"), F.count_distinct(user).alias("users"))
    total = classed.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    return out.join(F.broadcast(total)).select("purchase_class", "n", "users", (F.col("n") / F.col("total")).alias("rate"))


def user_stats(sessions: DataFrame, target: str, mobile: str) -> DataFrame:
    """Per user: browsing, target and mobile seconds, target visits, transitions into the target and their seconds."""
    at_target, moved = F.col("host") == target, (F.col("host") == target) & F.col("prev_host").isNotNull()
    return sessions.groupBy("user").agg(
        F.sum("seconds").alias("browsing_seconds"), F.sum(F.when(at_target, F.col("seconds")).otherwise(0.0)).alias("target_seconds"),
        F.sum(F.when(F.col("host") == mobile, F.col("seconds")).otherwise(0.0)).alias("mobile_seconds"),
        F.count_if(at_target).alias("target_visits"), F.count_if(moved).alias("transitions_in"),
        F.coalesce(F.sum(F.when(moved, F.col("prev_seconds"))), F.lit(0.0)).alias("transition_seconds"),
    )


def host_stats(sessions: DataFrame, mobile: str) -> DataFrame:
    """Per host visits, visitors, transitions away and their seconds; extra rows ``global`` and ``mobile``, all by one aggregation over users' sums."""
    moved = F.col("next_host").isNotNull()
    micros = F.round(F.col("seconds") * 1_000_000).cast("long")  # so that the sum of all is exact
    by_user = sessions.groupBy("host", "user").agg(F.count("*").alias("visits"), F.count_if(moved).alias("moves"), F.sum(F.when(moved, micros)).alias("micros"))
    out = by_user.groupingSets([["host"], []], "host").agg(
        F.grouping("host").alias("_all"), F.sum("visits").alias("visits"), F.count_distinct("user").alias("visitors"), F.sum("moves").alias("transitions"),
        F.coalesce(F.sum("micros") / 1_000_000, F.lit(0.0)).alias("transition_seconds"),
    )
    # The row of the mobile host is given twice; a table without sessions has no row of it, as no host has.
    names = F.when(F.col("_all") == 1, F.array(F.lit("global"))).when(F.col("host") == mobile, F.array("host", F.lit("mobile"))).otherwise(F.array("host"))
    return out.select(F.explode(names).alias("host"), F.coalesce("visits", F.lit(0)).alias("visits"), "visitors", F.coalesce("transitions", F.lit(0)).alias("transitions"), "transition_seconds")


def host_user_visits(sessions: DataFrame) -> DataFrame:
    """Per host and user: visits, total and mean seconds, transitions away and the seconds before one of them."""
    moves = F.count("next_host")
    return sessions.groupBy("host", "user").agg(
        F.count("*").alias("visits"), F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("mean_seconds"), moves.alias("transitions"),
        guarded(F.sum("seconds"), moves).alias("seconds_per_transition"),
    )


def leading_pages(sessions: DataFrame, target: str, payers: DataFrame) -> DataFrame:
    """Per host that leads to the target: visits led, users, paying users, mean seconds of the transition."""
    led = sessions.where((F.col("host") == target) & F.col("prev_host").isNotNull()).join(payers.select("user", F.lit(1).alias("pays")), "user", "left")
    return led.groupBy(F.col("prev_host").alias("lead")).agg(F.count("*").alias("led"), F.count_distinct("user").alias("users"), F.count_distinct(F.when(F.col("pays") == 1, F.col("user"))).alias("paying_users"), F.avg("prev_seconds").alias("mean_seconds"))


def page_ratings(sessions: DataFrame, target: str, payers: DataFrame) -> DataFrame:
    """Rating of each leading host: traffic x weight x decay.

    Traffic is target visitors over the host's visitors, weight is buyers over
    the paying users that it led, decay is one over the mean transition seconds;
    each divisor is at least 1.
    """
    visitors = sessions.groupBy("host").agg(F.count_distinct("user").alias("visitors"))
    buyers = payers.agg(F.count("*").alias("buyers"))
    goal = sessions.where(F.col("host") == target).agg(F.count_distinct("user").alias("goal_visitors"))
    rows = leading_pages(sessions, target, payers).join(visitors, F.col("lead") == F.col("host")).join(F.broadcast(buyers)).join(F.broadcast(goal))
    rating = guarded(F.col("goal_visitors"), F.col("visitors")) * guarded(F.col("buyers"), F.col("paying_users")) / F.greatest(F.lit(1.0), "mean_seconds")
    return rows.select("lead", rating.alias("rating"))


def mean_rating(sessions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean rating of the hosts that a user has visited."""
    visited = sessions.select("user", "host").distinct()
    return visited.join(ratings, F.col("host") == F.col("lead")).groupBy("user").agg(F.avg("rating").alias("mean_rating"), F.count("*").alias("rated_hosts"))


def high_rank_features(sessions: DataFrame, ratings: DataFrame, k: int) -> DataFrame:
    """Seconds of each user on the ``k`` best-rated hosts, a column for each rank."""
    top = ratings.orderBy(F.desc("rating"), "lead").limit(k).withColumn("rank", F.row_number().over(W.orderBy(F.desc("rating"), "lead")))
    rows = sessions.join(F.broadcast(top), F.col("host") == F.col("lead"), "left")
    return rows.groupBy("user").agg(*[F.sum(F.when(F.col("rank") == i, F.col("seconds")).otherwise(0.0)).alias(f"rank_{i}_seconds") for i in range(1, k + 1)])


def demographic_counts(people: DataFrame, visitors: DataFrame, payers: DataFrame) -> DataFrame:
    """Visitors and buyers by age, by gender and by both (``people``: user, age, gender); only users that visited the target count."""
    rows = people.join(visitors.select("user"), "user").join(payers.select("user", F.lit(1).alias("pays")), "user", "left")
    return rows.groupingSets([["age", "gender"], ["age"], ["gender"], []], "age", "gender").agg(F.count("*").alias("visitors"), F.count("pays").alias("buyers"))


def conditional_rates(people: DataFrame, visitors: DataFrame, payers: DataFrame, by: str) -> DataFrame:
    """Probability of a visit, and of a purchase, given a group of ``by``; divisors are at least 1."""
    rows = people.join(visitors.select("user", F.lit(1).alias("visits")), "user", "left").join(payers.select("user", F.lit(1).alias("pays")), "user", "left")
    out = rows.groupBy(by).agg(F.count("*").alias("people"), F.count("visits").alias("v"), F.count_if((F.col("visits") == 1) & (F.col("pays") == 1)).alias("b"))
    return out.select(by, guarded(F.col("v"), F.col("people")).alias("p_visit"), guarded(F.col("b"), F.col("v")).alias("p_buy"))


def buy_visit_probability(people: DataFrame, visits: DataFrame, purchases: DataFrame) -> DataFrame:
    """Sum over users of purchases per target visit times the share of visitors with the user's age and gender (``visits``, ``purchases``: user, n)."""
    seen = visits.select("user", F.col("n").alias("visits"))
    rows = people.join(seen, "user").join(purchases.select("user", F.col("n").alias("purchases")), "user", "left")
    same = rows.groupBy("age", "gender").agg(F.count("*").alias("same"))
    total = rows.agg(F.count("*").alias("total"))
    rows = rows.join(same, ["age", "gender"]).join(F.broadcast(total))
    return rows.agg(F.sum(guarded(F.coalesce("purchases", F.lit(0)), F.col("visits")) * guarded(F.col("same"), F.col("total"))).alias("probability"))


#: Windows of purchases, in the order in which they are tried.
PURCHASE_WINDOWS = ("week", "month", "year", "this_month", "holiday", "before_holiday", "weekend", "before_weekend")


def purchase_kinds(day: Column, as_of: str) -> Column:
    """The first window before ``as_of`` that fits a day with ``is_holiday`` and ``before_holiday``; ``this_month`` is that month of any year."""
    now = F.lit(as_of).cast("date")
    fits = (
        day > F.date_sub(now, 7), day > F.add_months(now, -1), day > F.add_months(now, -12), F.month(day) == F.month(now),
        F.col("is_holiday"), F.col("before_holiday"), is_weekend(day), before_weekend(day),
    )
    return F.coalesce(*[F.when(fit, k) for k, fit in zip(PURCHASE_WINDOWS, fits, strict=True)], F.lit("none"))


def purchase_windows(df: DataFrame, user: str, ts: str, pays: Column, as_of: str, calendar: DataFrame) -> DataFrame:
    """Share of a user's purchases in each of PURCHASE_WINDOWS."""
    rows = with_holidays(df.where(pays), ts, calendar)
    rows = rows.select(F.col(user).alias("user"), purchase_kinds(F.to_date(ts), as_of).alias("kind"))
    share = lambda k: guarded(F.count_if(F.col("kind") == k), F.count("*")).alias(f"share_{k}")
    return rows.groupBy("user").agg(F.count("*").alias("purchases"), *[share(k) for k in PURCHASE_WINDOWS])


def group_rates(people: DataFrame, visitors: DataFrame, payers: DataFrame, by: str) -> DataFrame:
    """Per group of ``by``: buyers in it over its people, and its visitors over all people, as ``p_buy_<by>`` and ``p_visit_<by>``."""
    rows = people.join(visitors.select("user", F.lit(1).alias("visits")), "user", "left").join(payers.select("user", F.lit(1).alias("pays")), "user", "left")
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.count("visits").alias("v"), F.count("pays").alias("b"))
    total = people.agg(F.count("*").alias("total"))
    return out.join(F.broadcast(total)).select(by, guarded(F.col("b"), F.col("n")).alias(f"p_buy_{by}"), guarded(F.col("v"), F.col("total")).alias(f"p_visit_{by}"))


def visit_ratios(sessions: DataFrame, target: str, mobile: str, promotion: str) -> DataFrame:
    """Mobile visits per target visit, the share of the user's days that have a target visit, and whether a promotion was visited."""
    day = F.to_date(F.timestamp_micros("start"))
    rows = sessions.select("user", "host", day.alias("day")).groupBy("user", "day").agg(
        F.count_if(F.col("host") == target).alias("t"), F.count_if(F.col("host") == mobile).alias("m"), F.max((F.col("host") == promotion).cast("int")).alias("p")
    )
    return rows.groupBy("user").agg(
        guarded(F.sum("m"), F.sum("t")).alias("mobile_ratio"), guarded(F.count_if(F.col("t") > 0), F.count("*")).alias("day_ratio"), F.max("p").alias("saw_promotion")
    )


def top_values_one_hot(df: DataFrame, user: str, kind: str, value: str, k: int) -> DataFrame:
    """The first ``k`` most frequent ``kind_value`` pairs as 0/1 columns per user."""
    rows = df.select(F.col(user).alias("user"), F.concat_ws("_", kind, value).alias("pair"))
    top = [r["pair"] for r in rows.groupBy("pair").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(k).collect()]
    return rows.groupBy("user").agg(*[F.max((F.col("pair") == p).cast("int")).alias(f"top_{i}") for i, p in enumerate(top, 1)])
