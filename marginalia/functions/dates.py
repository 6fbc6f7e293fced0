"""Calendar expressions in UTC or in a row's own time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.math import col


def week_start(ts) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", col(ts)))


def iso_week(ts) -> Column:
    """YYYY-Www; the year is the ISO year."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), col(ts)), F.weekofyear(col(ts)))


def zone_or_utc(zone) -> Column:
    """A zone's name if it is one: UTC, GMT, or a region's; null and others count as UTC. The names come from the runtime's own list, kept as a literal set."""
    from zoneinfo import available_timezones

    z = F.coalesce(col(zone), F.lit("UTC"))
    return F.when(z.isin(*sorted(n for n in available_timezones() if "/" in n and not n.startswith(("posix/", "right/", "SystemV/")))), z).otherwise("UTC")


def local_date(ts, zone) -> Column:
    """The calendar day in a zone; a null or unknown zone counts as UTC."""
    return F.to_date(F.from_utc_timestamp(col(ts).cast("timestamp"), zone_or_utc(zone)))


def local_hour(ts, zone) -> Column:
    """The hour in a zone; a null or unknown zone counts as UTC."""
    return F.hour(F.from_utc_timestamp(col(ts).cast("timestamp"), zone_or_utc(zone)))


def local_day_start(ts, zone) -> Column:
    """The moment at which the local day began."""
    z = zone_or_utc(zone)
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(col(ts).cast("timestamp"), z)), z)


def session_date(ts, profile_zone, request_zone) -> Column:
    """The local day by the profile's zone, else that of the request, else UTC; unknown zones are passed over."""
    known = lambda z: F.when((zone_or_utc(z) != "UTC") | (col(z) == "UTC"), zone_or_utc(z))
    return local_date(ts, F.coalesce(known(profile_zone), known(request_zone), F.lit("UTC")))


def safe_timestamp(c) -> Column:
    """A time from a text in one of the usual forms; null for anything else."""
    forms = ["yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy"]
    return F.coalesce(*[F.try_to_timestamp(F.trim(col(c)), F.lit(f)) for f in forms])


def short_date(ts) -> Column:
    """Jan 5, 2024; a dash for null."""
    return F.coalesce(F.date_format(col(ts), "MMM d, yyyy"), F.lit("—"))


def month_year(ts) -> Column:
    return F.date_format(col(ts), "MMM yyyy")


def lock_age(ms) -> Column:
    """Seconds, minutes or hours, each rounded; a dash for null."""
    s = F.floor(col(ms) / 1000 + 0.5)
    m = F.floor(s / 60 + 0.5)
    return F.when(col(ms).isNull(), "—").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(m / 60 + 0.5).cast("string"), F.lit("h")))


def relative_time(ts, now) -> Column:
    """How long ago, in words, up to a week; then the month and day."""
    s = F.unix_timestamp(col(now).cast("timestamp")) - F.unix_timestamp(col(ts).cast("timestamp"))
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86_400)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(s < 60, "Just now").when(m < 60, text(m, " min ago")).when(h < 24, text(h, "h ago")).when(d == 1, "Yesterday").when(d < 7, text(d, " days ago")).otherwise(F.date_format(col(ts), "MMM d"))


def dollars(c) -> Column:
    """Four decimals below a dollar, else two."""
    return F.concat(F.lit("$"), F.when(col(c) < 1, F.format_string("%.4f", col(c).cast("double"))).otherwise(F.format_string("%.2f", col(c).cast("double"))))


def calendar(spark: SparkSession, first: str, last: str, step: str = "1 day") -> DataFrame:
    """One row a step between two dates, column day."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval {step})")).alias("day"))


def window_start(ts, seconds: int) -> Column:
    """Start of the tumbling window, counted from the epoch, in seconds."""
    return (F.floor(F.unix_timestamp(col(ts).cast("timestamp")) / seconds) * seconds).cast("long")


def is_stale(ts, now, days: int = 90) -> Column:
    return col(ts) < col(now) - F.make_dt_interval(F.lit(days))


def quiet(hour, start, end) -> Column:
    """Whether an hour lies in quiet hours, which may wrap midnight; equal bounds mean none."""
    h, s, e = col(hour), col(start), col(end)
    return F.when(s.isNull() | e.isNull() | (s == e), F.lit(False)).when(s < e, (h >= s) & (h < e)).otherwise((h >= s) | (h < e))
