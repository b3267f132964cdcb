"""Calendar arithmetic of the daily jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of_previous_month(day: Column) -> Column:
    return F.add_months(F.trunc(day, "month"), -1)


def first_of_next_month(day: Column) -> Column:
    return F.add_months(F.trunc(day, "month"), 1)


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter")


def last_days(day: Column, n: int) -> Column:
    """The n days before `day`, oldest first."""
    return F.sequence(F.date_sub(day, n), F.date_sub(day, 1))


def days_between(first: Column, last: Column, closed: bool = True) -> Column:
    """All days from first to last, with the last one if closed; an empty array if there are none."""
    end = last if closed else F.date_sub(last, 1)
    return F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<date>"))


def hourly_windows(first: Column, last: Column) -> Column:
    """array<struct<begin, end>>: windows of an hour from first, while they begin before last."""
    starts = F.sequence(first, last - F.expr("interval 1 second"), F.expr("interval 1 hour"))
    found = F.transform(starts, lambda t: F.struct(t.alias("begin"), (t + F.expr("interval 1 hour")).alias("end")))
    return F.when(last > first, found).otherwise(F.slice(F.array(F.struct(first.alias("begin"), first.alias("end"))), 1, 0))
