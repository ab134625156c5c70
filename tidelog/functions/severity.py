"""Severity numbers, names, classes and buckets as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACE, DEBUG, INFO, WARN, ERROR, FATAL = 1, 5, 9, 13, 17, 21

#: Level words and their numbers.
WORDS = {
    TRACE: ["trace", "trc", "verbose"],
    DEBUG: ["debug", "dbg"],
    INFO: ["info", "inf", "information", "notice"],
    WARN: ["warn", "warning", "wrn"],
    ERROR: ["error", "err", "severe"],
    FATAL: ["fatal", "critical", "crit", "panic", "emergency", "alert"],
}
ALL_WORDS = frozenset(w for words in WORDS.values() for w in words)


def from_text(word: Column) -> Column:
    """The number of a level word; null for any other text."""
    low = F.lower(F.trim(word))
    out = F.lit(None).cast("smallint")
    for n, words in WORDS.items():
        out = F.when(low.isin(words), F.lit(n).cast("smallint")).otherwise(out)
    return out


def level_class(severity: Column) -> Column:
    return F.when(severity <= 8, "debug").when(severity <= 12, "info").otherwise("warn_plus")


def vendor_level(severity: Column) -> Column:
    return F.when(severity <= 8, "debug").when(severity <= 12, "info").when(severity <= 16, "warning").when(severity <= 20, "error").otherwise("fatal")


@dataclass(frozen=True)
class Bucket:
    name: str
    min_severity: int
    retention_secs: int


DAY = 86_400
#: The default cover of severities, and how long each part is kept.
DEFAULT_BUCKETS = (Bucket("debug", 0, 1 * DAY), Bucket("info", 9, 7 * DAY), Bucket("warn_plus", 13, 30 * DAY))


def check_buckets(buckets: tuple[Bucket, ...]) -> None:
    """Buckets cover 0 to 255 without gaps, in order, under distinct names."""
    if not buckets or buckets[0].min_severity != 0:
        raise ValueError("the first bucket starts at severity 0")
    if any(a.min_severity >= b.min_severity for a, b in zip(buckets, buckets[1:])):
        raise ValueError("buckets rise by severity")
    if len({b.name for b in buckets}) != len(buckets) or any(b.retention_secs <= 0 for b in buckets):
        raise ValueError("names are distinct and retention is positive")


def bucket_for(severity: Column, buckets: tuple[Bucket, ...] = DEFAULT_BUCKETS) -> Column:
    """The last bucket whose minimum the severity reaches."""
    out = F.lit(buckets[0].name)
    for b in buckets[1:]:
        out = F.when(severity >= b.min_severity, b.name).otherwise(out)
    return out


def names_from(least: int, buckets: tuple[Bucket, ...] = DEFAULT_BUCKETS) -> list[str]:
    """Buckets that can hold a severity of at least `least`."""
    above = [*(b.min_severity for b in buckets[1:]), 256]
    return [b.name for b, top in zip(buckets, above, strict=True) if top > least]


def retention_secs(level: Column, buckets: tuple[Bucket, ...] = DEFAULT_BUCKETS) -> Column:
    out = F.lit(None).cast("long")
    for b in buckets:
        out = F.when(level == b.name, F.lit(b.retention_secs).cast("long")).otherwise(out)
    return out
