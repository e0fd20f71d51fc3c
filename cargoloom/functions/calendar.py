"""Number series and the calendar dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def number_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """``i`` from start to stop inclusive; generated in parallel by the range source."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").cast("int").alias("i"))


def date_dimension(spans: DataFrame, first: str, last: str) -> DataFrame:
    """25-column calendar of every date within the spans ``first..last`` of a DataFrame, each date once.

    The spans' dates are spread over their years before the sequence is built,
    so one row never expands beyond one year of dates.
    """
    years = spans.select(F.explode(F.sequence(F.year(first), F.year(last))).alias("_y"), F.col(first).alias("_a"), F.col(last).alias("_b"))
    years = years.groupBy("_y").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    start = F.greatest(F.make_date("_y", F.lit(1), F.lit(1)), F.col("_a"))
    stop = F.least(F.make_date("_y", F.lit(12), F.lit(31)), F.col("_b"))
    days = years.select(F.explode(F.sequence(start.cast("date"), stop.cast("date"))).alias("Date"))
    return days.select(*calendar_columns("Date"))


def calendar_columns(c: str):
    d = F.col(c)
    day, month, year = F.dayofmonth(d), F.month(d), F.year(d)
    month_start, quarter_start, year_start = F.trunc(d, "MM"), F.trunc(d, "QUARTER"), F.trunc(d, "YEAR")
    suffix = F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    quarter_name = F.element_at(F.array(*map(F.lit, ("First", "Second", "Third", "Fourth"))), F.quarter(d))
    return [
        (year * 10000 + month * 100 + day).alias("DateKey"), d.alias("Date"), day.alias("Day"), suffix.alias("DaySuffix"),
        F.dayofweek(d).alias("Weekday"), F.date_format(d, "EEEE").alias("WeekDayName"), F.dayofyear(d).alias("DayOfYear"),
        # weeks start on Sunday, as the weekday number does
        F.floor((day + F.dayofweek(month_start) - 2) / 7 + 1).cast("int").alias("WeekOfMonth"),
        F.floor((F.dayofyear(d) + F.dayofweek(year_start) - 2) / 7 + 1).cast("int").alias("WeekOfYear"),
        F.weekofyear(d).alias("ISOWeekOfYear"), month.alias("Month"), F.date_format(d, "MMMM").alias("MonthName"), F.quarter(d).alias("Quarter"),
        quarter_name.alias("QuarterName"), year.alias("Year"), F.date_format(d, "MMyyyy").alias("MMYYYY"),
        F.date_format(d, "MMM-yyyy").alias("MonthYear"), month_start.alias("FirstDayOfMonth"), F.last_day(d).alias("LastDayOfMonth"),
        quarter_start.alias("FirstDayOfQuarter"), F.last_day(F.add_months(quarter_start, 2)).alias("LastDayOfQuarter"),
        year_start.alias("FirstDayOfYear"), F.last_day(F.add_months(year_start, 11)).alias("LastDayOfYear"),
        F.add_months(month_start, 1).alias("FirstDayOfNextMonth"), F.add_months(year_start, 12).alias("FirstDayOfNextYear"),
    ]


def numbers_of(df: DataFrame, start, stop, step: int = 1, out: str = "i") -> DataFrame:
    """Each row once per number from start to stop by step; rows whose start lies beyond stop give none."""
    first, last = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (start, stop))
    return df.where(first <= last if step > 0 else first >= last).withColumn(out, F.explode(F.sequence(first, last, F.lit(step))))
