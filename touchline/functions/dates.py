"""Column functions on days and kickoffs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_first(s: Column) -> Column:
    """dd/mm/yyyy or dd/mm/yy; anything else is null."""
    full = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "d/M/yyyy"))
    short = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(s, "d/M/yy"))
    return F.coalesce(full, short)


def uk_to_utc(day: Column, clock: Column) -> Column:
    """UTC instant of a London wall clock; a missing time is 15:00."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.coalesce(clock, F.lit("15:00"))), "yyyy-MM-dd HH:mm"), "Europe/London")


def local_window(now: Column, hours: int = 7) -> tuple[Column, Column]:
    """UTC bounds, both inclusive, from local midnight to the later of tomorrow's last second and 48 hours on."""
    shift = F.make_interval(hours=F.lit(hours))
    midnight = F.date_trunc("day", now + shift) - shift
    tomorrow = midnight + F.expr("INTERVAL 2 DAYS") - F.expr("INTERVAL 1 SECOND")
    return midnight, F.greatest(tomorrow, now + F.expr("INTERVAL 48 HOURS"))


def season_start(day: Column) -> Column:
    """First year of a season that turns in July."""
    return F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)


def season_code(start: Column) -> Column:
    """2024 reads ``2425``."""
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    return F.concat(two(start), two(start + 1))


def day_label(day: Column, today: Column) -> Column:
    gap = F.date_diff(day, today)
    return F.when(gap == 0, "today").when(gap == 1, "tomorrow").otherwise(F.date_format(day, "EEEE"))


def kickoff_passed(kickoff: Column, day: Column, now: Column, grace: str = "INTERVAL 120 MINUTES") -> Column:
    """Kickoff plus grace is over; a bare day counts from its fifteenth hour."""
    return F.coalesce(kickoff, day.cast("timestamp") + F.expr("INTERVAL 15 HOURS")) + F.expr(grace) <= now
