"""Timestamps in many spellings, and labels of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss 'UTC'", "yyyy-MM-dd"]
#: Epoch numbers above this are milliseconds.
MILLIS = 10_000_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(c) -> Column:
    """An instant from ISO 8601, EXIF, date-only, epoch seconds or epoch milliseconds; null if none fits."""
    t = F.trim(_col(c))
    n = F.when(t.rlike(r"^[0-9]{9,13}$"), t.try_cast("long"))
    epoch = F.timestamp_seconds(F.when(n > MILLIS, F.floor(n / 1000)).otherwise(n).cast("long"))
    return F.coalesce(epoch, *[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS])


def normalise_timestamp(c) -> Column:
    """UTC text with milliseconds and a Z; unreadable text stays as it is."""
    t = F.trim(_col(c))
    return F.coalesce(F.date_format(parse_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), t)


def day_label(d) -> Column:
    return F.date_format(_col(d), "MMM d, yyyy")


def range_label(a, b) -> Column:
    """One day, or two with an en dash; the year once if both share it."""
    first, last = _col(a), _col(b)
    same_year = F.year(first) == F.year(last)
    return F.when(first == last, day_label(first)).when(same_year, F.concat(F.date_format(first, "MMM d"), F.lit(" – "), day_label(last))).otherwise(F.concat(day_label(first), F.lit(" – "), day_label(last)))


def search_words(ts) -> Column:
    """Weekday and month names for text search."""
    return F.lower(F.concat_ws(" ", F.date_format(_col(ts), "EEEE"), F.date_format(_col(ts), "MMMM")))


def ago_label(ts, now) -> Column:
    """just now, or minutes, hours or days ago, rounded down."""
    minutes = F.floor((F.unix_millis(_col(now)) - F.unix_millis(_col(ts))) / 60000)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "m")).when(minutes < 1440, said(F.floor(minutes / 60), "h")).otherwise(said(F.floor(minutes / 1440), "d"))


def uptime_label(seconds) -> Column:
    """Days, hours and minutes where there are any, and seconds: 2d 5h 12m 3s."""
    n = _col(seconds).cast("long")
    part = lambda value, unit: F.when(value > 0, F.concat(value.cast("string"), F.lit(unit)))
    return F.concat_ws(" ", part(F.floor(n / 86400), "d"), part(F.floor(n % 86400 / 3600), "h"), part(F.floor(n % 3600 / 60), "m"), F.concat((n % 60).cast("string"), F.lit("s")))


def eta_label(seconds) -> Column:
    """HH:MM:SS of seconds rounded up, at least zero; hours may have more than two digits."""
    n = F.greatest(F.ceil(_col(seconds)), F.lit(0))
    hours = F.floor(n / 3600).cast("string")
    two = lambda value: F.lpad(value.cast("string"), 2, "0")
    return F.concat_ws(":", F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), two(F.floor(n % 3600 / 60)), two(n % 60))
