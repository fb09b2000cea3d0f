"""Calendar parts, date parsing and holiday calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The exact forms that dates may have, tried in order after the general parse.
DATE_FORMATS = (
    "dd-MM-yy", "dd/MM/yyyy H:mm:ss", "dd/MM/yyyy H:mm", "dd/MM/yy H:mm:ss", "dd/MM/yy H:mm", "dd-MM-yyyy H:mm:ss",
    "dd-MM-yy H:mm:ss", "dd-MM-yy H:mm", "dd-MM-yy HH:mm:ss", "dd-MM-yy HH:mm",
)
#: Forms of the general parse besides ISO: month first.
GENERAL_FORMATS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")


def weekday(ts: Column) -> Column:
    """1 is Sunday."""
    return F.dayofweek(ts)


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(ts))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def week_start(ts: Column) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", ts.cast("timestamp")))


def week_end(ts: Column) -> Column:
    """The Monday after, as a date (exclusive)."""
    return F.date_add(week_start(ts), 7)


def week_number(ts: Column) -> Column:
    """Weeks since the Monday of 1969-12-29, so that the next week is one more across years."""
    return F.floor((day_number(ts) + 3) / 7).cast("int")


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The general parse (ISO, then month first), then the exact forms, as UTC; null if nothing fits.

    A number is no date. Years of two digits are those from 2000 on.
    """
    forms = [F.try_to_timestamp(text, F.lit(f)) for f in (*GENERAL_FORMATS, *formats)]
    return F.when(text.try_cast("double").isNotNull(), F.lit(None)).otherwise(F.coalesce(text.try_cast("timestamp"), *forms))


def is_weekend(ts: Column) -> Column:
    """Saturday or Sunday."""
    return F.dayofweek(ts).isin(1, 7)


def before_weekend(ts: Column) -> Column:
    return F.dayofweek(ts) == 6


def with_holidays(df: DataFrame, ts: str, calendar: DataFrame) -> DataFrame:
    """Flags ``is_holiday`` and ``before_holiday`` by a calendar (day date), compared by date.

    A calendar has a row for a day at most, so it stays small; it is made distinct here and the planner broadcasts it.
    """
    days = calendar.select(F.to_date("day").alias("_day")).distinct()
    both = days.select("_day", F.lit(1).alias("_on")).union(days.select(F.date_sub("_day", 1), F.lit(0)))
    flags = both.groupBy("_day").agg(F.bool_or(F.col("_on") == 1).alias("is_holiday"), F.bool_or(F.col("_on") == 0).alias("before_holiday"))
    out = df.join(flags, F.to_date(df[ts]) == F.col("_day"), "left").drop("_day")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_holiday", "before_holiday")})


#: Public holidays of one country, as month and day.
HOLIDAYS = {
    "new year": (1, 1), "liberation day": (3, 3), "saint george": (5, 6), "culture and letters": (5, 24), "unification": (9, 6),
    "independence": (9, 22), "enlighteners": (11, 1), "christmas eve": (12, 24), "christmas": (12, 25), "second day of christmas": (12, 26),
}
#: Holidays on the first Monday from a day on.
MONDAYS = {"labour day": (5, 1)}


def _whole(x: Column, by: int) -> Column:
    return F.floor(x / by).cast("int")


def western_easter(year: Column) -> Column:
    """Easter Sunday by the Gregorian calendar's full moon."""
    golden, century = year % 19, _whole(year, 100)
    moon = (19 * golden + century - _whole(century, 4) - _whole(century - _whole(century + 8, 25) + 1, 3) + 15) % 30
    back = (32 + 2 * (century % 4) + 2 * _whole(year % 100, 4) - moon - year % 4) % 7
    late = _whole(golden + 11 * moon + 22 * back, 451)
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), moon + back - 7 * late)


def orthodox_easter(year: Column) -> Column:
    """Easter Sunday by the Julian calendar's full moon, as a Gregorian date."""
    moon = (19 * (year % 19) + 15) % 30
    sunday = (2 * (year % 4) + 4 * (year % 7) - moon + 34) % 7
    between = _whole(year, 100) - _whole(year, 400) - 2  # days between the calendars
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), moon + sunday + between)


def off_weekend(day: Column) -> Column:
    """Saturdays move to the day before, Sundays to the day after."""
    return F.date_add(day, F.when(F.dayofweek(day) == 7, -1).when(F.dayofweek(day) == 1, 1).otherwise(0))


def holiday_calendar(
    spark: SparkSession, first_year: int, last_year: int, easter: str | None = "orthodox", fixed: dict[str, tuple[int, int]] | None = None, mondays: dict[str, tuple[int, int]] | None = None, shifted: bool = True
) -> DataFrame:
    """``day`` and ``name`` of the holidays of some years, by rule: fixed days, ``orthodox`` or ``western`` Easter, first Mondays. With ``shifted`` none is on a weekend.

    A calendar of the user's own, of whatever days, serves ``with_holidays`` as well.
    """
    year = F.col("year").cast("int")
    move = off_weekend if shifted else (lambda day: day)
    days = {name: move(F.make_date(year, F.lit(m), F.lit(d))) for name, (m, d) in (HOLIDAYS if fixed is None else fixed).items()}
    if easter is not None:
        days["easter"] = move({"orthodox": orthodox_easter, "western": western_easter}[easter](year))
    for name, (m, d) in (MONDAYS if mondays is None else mondays).items():
        start = move(F.make_date(year, F.lit(m), F.lit(d)))
        days[name] = F.date_add(start, (9 - F.dayofweek(start)) % 7)
    rows = [F.struct(day.alias("day"), F.lit(name).alias("name")) for name, day in days.items()]
    return spark.range(first_year, last_year + 1).toDF("year").select(F.inline(F.array(*rows)))
