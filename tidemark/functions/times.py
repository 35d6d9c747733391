"""Moments, clocks and sessions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(text: Column, zone: str = "UTC") -> Column:
    """A timestamp from RFC 2822, ISO 8601 (up to nine fraction digits, cut to six) or US local text; null for a date alone."""
    t = F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1")
    dated = F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}/\d{1,2}/\d{4}$"))
    rfc = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|UT)$", "+0000")
    us = F.to_utc_timestamp(F.try_to_timestamp(t, F.lit("M/d/yyyy h:mm:ss a")), zone)
    iso = F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")), t.try_cast("timestamp"))
    return F.when(~dated, F.coalesce(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm Z")), iso, us))


def session(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 7, "asia").when(h < 13, "london").when(h < 21, "new_york").otherwise("late")


def week_part(ts: Column) -> Column:
    return F.when(F.weekday(ts) >= 5, "weekend").otherwise("weekday")


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def clocks(ts: Column, offsets=(("new_york", -5), ("london", 0), ("tokyo", 9))) -> Column:
    """The moment as HH:mm on clocks of fixed offset."""
    return F.struct(*[F.date_format(ts + F.expr(f"INTERVAL {h} HOURS"), "HH:mm").alias(n) for n, h in offsets])


def local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def covering(first: Column, last: Column, step: str) -> Column:
    """The starts of the hours, days or ISO weeks that touch a span, both ends included."""
    return F.sequence(F.date_trunc(step, first), F.date_trunc(step, last), F.expr(f"INTERVAL 1 {step}"))


def conference_start(release: Column, zone: str = "America/New_York") -> Column:
    """Thirty minutes after a release from 2013 on, before that 14:15 local time of its day."""
    day = F.from_utc_timestamp(release, zone)
    early = F.to_utc_timestamp(F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.lit(14), F.lit(15), F.lit(0)), zone)
    return F.when(F.year(day) >= 2013, release + F.expr("INTERVAL 30 MINUTES")).otherwise(early)


def quarter_steps(change: Column) -> Column:
    return F.bround(change / 0.25).cast("int")
