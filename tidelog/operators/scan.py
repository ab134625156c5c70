"""The filtered scan: time window, service, least severity, body text, limit.

Filters on time and severity also become filters on the path's columns (hour, level),
which Spark prunes by; it can't derive them from the time itself.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import DEFAULT_BUCKETS, Bucket, names_from
from ..functions.times import HOUR_NS, parse_hour

#: Order of rows in a file, and of files in a scan.
IN_FILE = ["service", "trace_id", "timestamp_ns", "event_id"]
PATH = ["tenant", "index", "hour", "level", "node"]


@dataclass(frozen=True)
class Query:
    from_ns: int | None = None
    until_ns: int | None = None
    service: str | None = None
    min_severity: int | None = None
    contains: str | None = None
    limit: int = 10_000


def partition_filter(q: Query, buckets: tuple[Bucket, ...] = DEFAULT_BUCKETS) -> Column:
    """What the query says about the path. A level is pruned only if its name is one of
    the buckets given."""
    out = F.lit(True)
    if q.from_ns is not None:
        out = out & ((parse_hour(F.col("hour")) + 1) * HOUR_NS > q.from_ns)
    if q.until_ns is not None:
        out = out & (parse_hour(F.col("hour")) * HOUR_NS < q.until_ns)
    if q.min_severity is not None:
        low = [b.name for b in buckets if b.name not in names_from(q.min_severity, buckets)]
        out = out & ~F.col("level").isin(low) if low else out
    return out


def hour_range(q: Query) -> Column:
    """The hours as plain string bounds, which reach the file index."""
    from datetime import datetime, timezone

    out = F.lit(True)
    stamp = lambda ns: datetime.fromtimestamp(ns // HOUR_NS * 3600, timezone.utc).strftime("%Y-%m-%dT%H")
    if q.from_ns is not None:
        out = out & (F.col("hour") >= stamp(q.from_ns))
    if q.until_ns is not None:
        out = out & (F.col("hour") <= stamp(max(0, q.until_ns - 1)))
    return out


def row_filter(q: Query) -> Column:
    out = F.lit(True)
    if q.from_ns is not None:
        out = out & (F.col("timestamp_ns") >= q.from_ns)
    if q.until_ns is not None:
        out = out & (F.col("timestamp_ns") < q.until_ns)
    if q.service is not None:
        out = out & (F.col("service") == q.service)
    if q.min_severity is not None:
        out = out & (F.col("severity") >= q.min_severity)
    if q.contains is not None:
        out = out & F.col("body").contains(q.contains)
    return out


def matches(logs: DataFrame, q: Query) -> DataFrame:
    return logs.where(hour_range(q) & partition_filter(q) & row_filter(q))


def scan(logs: DataFrame, q: Query) -> DataFrame:
    """At most `limit` matches (one at least, if there is a match): newest hour first, by
    path, in file order; then by time."""
    order = [F.col("hour").desc(), *(F.col(c).desc() for c in PATH), *(F.col(c).asc_nulls_first() for c in IN_FILE)]
    return matches(logs, q).orderBy(*order).limit(max(1, q.limit)).orderBy("timestamp_ns", "event_id")


def truncated(logs: DataFrame, q: Query) -> DataFrame:
    """One row: n and truncated, which says that the matches reach the limit."""
    return scan(logs, q).agg(F.count("*").alias("n")).withColumn("truncated", F.col("n") >= q.limit)


def scan_each(logs: DataFrame, q: Query) -> DataFrame:
    """All matches, oldest hour first, each file by time; for toLocalIterator."""
    return matches(logs, q).orderBy("hour", *PATH, "timestamp_ns", "event_id")


def numbered(logs: DataFrame, q: Query) -> DataFrame:
    """All matches with `at`, their place in scan_each()'s order from 1; counted by hours
    first, so no task orders the table."""
    rows = matches(logs, q)
    per = rows.groupBy(F.col("hour").alias("__h")).agg(F.count("*").alias("__c"))
    per = per.withColumn("__base", F.coalesce(F.sum("__c").over(Window.orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")  # a row an hour
    inside = Window.partitionBy("hour").orderBy(*PATH, "timestamp_ns", "event_id")
    return rows.join(per, F.col("hour") == F.col("__h")).withColumn("at", F.col("__base") + F.row_number().over(inside)).drop("__h", "__base")


def recent(logs: DataFrame, now_ns: int, window_secs: int, service: str | None = None, min_severity: int | None = None, limit: int = 10_000) -> DataFrame:
    return scan(logs, Query(max(0, now_ns - window_secs * 1_000_000_000), None, service, min_severity, None, limit))


def page(rows: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit of an order; no more than those reach one task."""
    return rows.orderBy(*order).offset(offset).limit(limit)


#: The longest range that a backfill may ask for.
MOST_DAYS = 31


def backfill(logs: DataFrame, from_ms: int, to_ms: int, min_severity: int = 0) -> DataFrame:
    """Everything of a range again, oldest first, of at least a severity."""
    if to_ms <= from_ms:
        raise ValueError("the range must end after it begins")
    if to_ms - from_ms > MOST_DAYS * 86_400_000:
        raise ValueError(f"a backfill covers {MOST_DAYS} days at most")
    return scan_each(logs, Query(from_ms * 1_000_000, to_ms * 1_000_000, min_severity=min_severity or None))


def file_table(logs: DataFrame) -> DataFrame:
    """A row for each partition: rows and the bounds of both clocks."""
    return logs.groupBy(*PATH).agg(
        F.count("*").alias("rows"), F.min("timestamp_ns").alias("min_ts"), F.max("timestamp_ns").alias("max_ts"), F.min("observed_ns").alias("min_observed"), F.max("observed_ns").alias("max_observed")
    )


def plan(files: DataFrame, q: Query) -> DataFrame:
    """The partitions that a scan would open, in its order."""
    return files.where(hour_range(q) & partition_filter(q)).select(*PATH).distinct().orderBy(F.col("hour").desc(), *(F.col(c).desc() for c in PATH))


def scan_stats(logs: DataFrame, q: Query) -> DataFrame:
    """One row: files considered and pruned, rows scanned and matched."""
    opened = hour_range(q) & partition_filter(q)
    per = logs.groupBy(*PATH).agg(F.count("*").alias("n"), F.count_if(row_filter(q)).alias("m")).withColumn("open", opened)
    return per.agg(
        F.count("*").alias("files_considered"),
        F.count_if(~F.col("open")).alias("files_pruned"),
        F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0)).alias("rows_scanned"),
        F.coalesce(F.sum(F.when(F.col("open"), F.col("m"))), F.lit(0)).alias("rows_matched"),
    )


def files_in_order(files: DataFrame) -> DataFrame:
    """Files by (epoch hour, path), numbered; a row for each file, so one task will do."""
    path = F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.col(c)) for c in PATH))
    return files.select(path.alias("path"), parse_hour(F.col("hour")).alias("epoch_hour")).withColumn("at", F.row_number().over(Window.orderBy("epoch_hour", "path")).cast("long"))


def without_limit(q: Query) -> Query:
    return replace(q, limit=2**31 - 1)
