"""US equity market calendar as two small tables, made from rules for any range of years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.bars import OPEN_MINUTE

EARLY_CLOSE_MINUTE = 13 * 60
#: First and last year of the tables unless others are asked for.
YEARS = (2000, 2040)
#: First year in which 19 June is a market holiday.
JUNETEENTH_FROM = 2022

# Days the exchange closed for a single occasion (attacks, a hurricane, days of mourning).
CLOSED_ONCE = [
    "2001-09-11",
    "2001-09-12",
    "2001-09-13",
    "2001-09-14",
    "2004-06-11",
    "2007-01-02",
    "2012-10-29",
    "2012-10-30",
    "2018-12-05",
    "2025-01-09",
]

_YEAR = "year"


def _date(month: int, day: int) -> Column:
    return F.make_date(F.col(_YEAR), F.lit(month), F.lit(day))


def _nth(month: int, weekday: str, n: int) -> Column:
    """The n-th such weekday of a month."""
    return F.date_add(F.next_day(F.date_sub(_date(month, 1), 1), weekday), 7 * (n - 1))


def _observed(day: Column) -> Column:
    """Friday for a Saturday, Monday for a Sunday."""
    week_day = F.weekday(day)
    return F.when(week_day == 5, F.date_sub(day, 1)).when(week_day == 6, F.date_add(day, 1)).otherwise(day)


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar: the Sunday after the full moon that the golden number and the
    corrections of the century give."""
    whole = lambda x, n: F.floor(x / n).cast("int")
    golden, century = year % 19, whole(year, 100)
    moon = (century - whole(century, 4) - whole(8 * century + 13, 25) + 19 * golden + 15) % 30
    moon = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon.cast("int"))
    return F.next_day(full, "SUN")


def _table(spark: SparkSession, years: tuple[int, int], rules: Sequence[Column], fixed: Sequence[str]) -> DataFrame:
    by_rule = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias(_YEAR))
    days = by_rule.select(F.explode(F.array(*rules)).alias("day")).where("day is not null")
    if fixed:
        once = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in fixed])).alias("day"))
        days = days.unionByName(once.select(F.to_date("day").alias("day")))
    return days.distinct()


def _holiday_rules() -> list[Column]:
    new_year = _date(1, 1)
    return [
        # a New Year's Day on a Saturday is not made up for: the old year ends on a trading day
        F.when(F.weekday(new_year) != 5, _observed(new_year)),
        _nth(1, "MON", 3),
        _nth(2, "MON", 3),
        F.date_sub(easter(F.col(_YEAR)), 2),
        F.next_day(_date(5, 24), "MON"),
        F.when(F.col(_YEAR) >= JUNETEENTH_FROM, _observed(_date(6, 19))),
        _observed(_date(7, 4)),
        _nth(9, "MON", 1),
        _nth(11, "THU", 4),
        _observed(_date(12, 25)),
    ]


def holidays(spark: SparkSession, extra: Sequence[str] = (), years: tuple[int, int] = YEARS) -> DataFrame:
    """Days without trading, weekends aside."""
    once = [d for d in CLOSED_ONCE if years[0] <= int(d[:4]) <= years[1]]
    return _table(spark, years, _holiday_rules(), [*once, *extra])


def early_closes(
    spark: SparkSession, extra: Sequence[str] = (), minute: int = EARLY_CLOSE_MINUTE, years: tuple[int, int] = YEARS
) -> DataFrame:
    """Trading days that end early: the eves of Independence Day and Christmas and the day after Thanksgiving."""
    trades = lambda eve, holiday: F.when((F.weekday(eve) < 5) & (_observed(holiday) != eve), eve)
    rules = [
        trades(_date(7, 3), _date(7, 4)),
        F.date_add(_nth(11, "THU", 4), 1),
        trades(_date(12, 24), _date(12, 25)),
    ]
    return _table(spark, years, rules, list(extra)).withColumn("close_min", F.lit(minute))


def sessions(closed: DataFrame, early: DataFrame) -> DataFrame:
    """(day, closed, last_minute): one row for each day in ``closed(day)`` or ``early(day, close_min)``; minutes count
    from the opening."""
    shut = closed.select("day", F.lit(True).alias("closed")).distinct()
    short = early.groupBy("day").agg((F.min("close_min") - OPEN_MINUTE).cast("int").alias("last_minute"))
    return shut.join(short, "day", "full").select("day", F.coalesce("closed", F.lit(False)).alias("closed"), "last_minute")
