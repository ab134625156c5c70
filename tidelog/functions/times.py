"""Clock expressions over nanoseconds since 1970, free of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
MINUTE_NS = 60_000_000_000


def int_div(a: Column, n: int) -> Column:
    """Whole-number division, towards zero: doubles can't hold nanoseconds."""
    return F.call_function("div", a, F.lit(n).cast("long"))


def ns_of_naive(ts: Column) -> Column:
    """A timestamp without zone, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) * 1000


def epoch_hour(ns: Column) -> Column:
    return int_div(floor_ns(ns, HOUR_NS), HOUR_NS)


def floor_ns(ns: Column, step: int) -> Column:
    return ns - F.pmod(ns, F.lit(step))


def format_hour(ns: Column) -> Column:
    """YYYY-MM-DDTHH of the event hour."""
    hours = epoch_hour(ns)
    day = F.date_from_unix_date(int_div(hours - F.pmod(hours, F.lit(24)), 24).cast("int"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.lpad(F.pmod(hours, F.lit(24)).cast("string"), 2, "0"))


def parse_hour(text: Column) -> Column:
    """Epoch hour of YYYY-MM-DDTHH, null if it isn't one. Any day up to 31 is taken in
    any month; days past the month's end run on into the next."""
    ok = text.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3])$")
    month = F.to_date(F.when(ok, F.concat(F.substring(text, 1, 7), F.lit("-01"))))
    days = F.unix_date(month) + F.substring(text, 9, 2).try_cast("int") - 1
    return F.when(ok, days.cast("long") * 24 + F.substring(text, 12, 2).try_cast("long"))


_CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3}|\.\d{6}|\.\d{9})?Z$"


def canonical_ns(text: Column) -> Column:
    """Nanoseconds of a canonical UTC timestamp with the shortest fraction of 0, 3, 6 or
    9 digits, years 1678 to 2261; null for any other text."""
    fraction = F.regexp_extract(text, r"\.(\d+)Z$", 1)
    short = (F.length(fraction) == 0) | ~fraction.rlike("000$")
    year = F.substring(text, 1, 4).try_cast("int")
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    clock = [F.substring(text, p, 2).try_cast("long") for p in (12, 15, 18)]
    ok = text.rlike(_CANONICAL) & short & year.between(1678, 2261) & day.isNotNull() & (F.date_format(day, "yyyy-MM-dd") == F.substring(text, 1, 10))
    ok = ok & (clock[0] < 24) & (clock[1] < 60) & (clock[2] < 60)
    seconds = F.unix_date(day).cast("long") * 86_400 + clock[0] * 3600 + clock[1] * 60 + clock[2]
    return F.when(ok, seconds * 1_000_000_000 + F.coalesce(F.rpad(fraction, 9, "0").try_cast("long"), F.lit(0)))


def format_canonical(ns: Column) -> Column:
    """The inverse of canonical_ns."""
    seconds = int_div(floor_ns(ns, 1_000_000_000), 1_000_000_000)
    day = F.date_from_unix_date(int_div(seconds - F.pmod(seconds, F.lit(86_400)), 86_400).cast("int"))
    left = F.pmod(seconds, F.lit(86_400))
    part = F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0")
    shortest = F.regexp_replace(F.regexp_replace(F.concat(F.lit("."), part), "(000)+$", ""), r"^\.$", "")
    two = [F.lpad(x.cast("long").cast("string"), 2, "0") for x in (int_div(left, 3600), int_div(F.pmod(left, F.lit(3600)), 60), F.pmod(left, F.lit(60)))]
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), two[0], F.lit(":"), two[1], F.lit(":"), two[2], shortest, F.lit("Z"))
