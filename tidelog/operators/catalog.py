"""Catalog questions: files, parts, pages, differences of listings, accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(files: DataFrame, from_ns: int, to_ns: int, buckets: list[str] | None = None) -> DataFrame:
    """Files whose time overlaps, both ends included (a scan's end is not)."""
    out = files.where((F.col("max_ts") >= from_ns) & (F.col("min_ts") <= to_ns))
    return out if buckets is None else out.where(F.col("level").isin(buckets))


def totals(files: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return files.agg(F.coalesce(F.sum("rows"), zero).alias("rows"), F.coalesce(F.sum("bytes"), zero).alias("bytes"))


def parts_list(parts: DataFrame, node: str | None = None, tier: str | None = None, from_ns: int | None = None, to_ns: int | None = None, newest_before: int | None = None, limit: int = 1000) -> DataFrame:
    out = parts
    for test in (
        node is not None and F.col("node") == node,
        tier is not None and F.col("tier") == tier,
        from_ns is not None and F.col("max_observed") >= from_ns,
        to_ns is not None and F.col("min_observed") <= to_ns,
        newest_before is not None and F.col("max_observed") < newest_before,
    ):
        if test is not False:
            out = out.where(test)
    return out.orderBy("max_observed", "node", "name").limit(limit)


def page_after(parts: DataFrame, after: tuple[str, str] | None, limit: int) -> DataFrame:
    """The next page by (node, name)."""
    out = parts if after is None else parts.where(F.struct("node", "name") > F.struct(F.lit(after[0]).alias("node"), F.lit(after[1]).alias("name")))
    return out.orderBy("node", "name").limit(limit)


def difference(here: DataFrame, there: DataFrame, on: list[str]) -> DataFrame:
    """Rows of either listing that the other lacks, with `side`: fetch or only_here."""
    fetch = there.select(*on).join(here.select(*on), on, "left_anti").withColumn("side", F.lit("fetch"))
    return fetch.unionByName(here.select(*on).join(there.select(*on), on, "left_anti").withColumn("side", F.lit("only_here")))


def not_merged(segments: DataFrame, merged: DataFrame) -> DataFrame:
    return segments.join(merged.select("uuid"), "uuid", "left_anti")


def gave_up(unconfirmed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Of the files that were never confirmed, those deleted anyway."""
    gone = unconfirmed.join(deleted.select("path"), "path", "left_semi")
    return gone.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def accounted(received: int, committed: int, in_log: int, dropped: int, tolerance: int = 0) -> tuple[int, bool]:
    """What is missing (negative: counters are stale), and whether the sum holds."""
    missing = received - committed - in_log - dropped
    return missing, abs(missing) <= tolerance


def routed(logs: DataFrame, tenancy: DataFrame, default: str = "main") -> DataFrame:
    """Logs with index (tenancy: known indexes of the tenant) and route: known, defaulted
    (nothing was asked for) or refused."""
    t = tenancy.select(F.col("index").alias("k")).distinct().withColumn("ok", F.lit(True))
    out = logs.join(t, F.col("requested") == F.col("k"), "left").drop("k")
    route = F.when(F.col("requested").isNull(), "defaulted").when(F.col("ok"), "known").otherwise("refused")
    return out.withColumn("route", route).withColumn("index", F.when(route == "known", F.col("requested")).when(route == "defaulted", F.lit(default))).drop("ok")


def admitted(logs: DataFrame, tenant: str, indexes: list[str], whole: bool = False, key: str = "tenant_claim") -> DataFrame:
    """A principal's records: the tenant they claim must be the principal's (or none), the
    index one of its own. With `whole`, one refused record refuses the batch."""
    ok = F.coalesce(F.col(key) == tenant, F.lit(True)) & (F.col("requested").isNull() | F.col("requested").isin(indexes))
    out = logs.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    if whole:
        out = out.join(out.where("not __ok").select(F.lit(1).alias("x")).limit(1), F.lit(True), "left_anti")
    return out.where("__ok").drop("__ok").withColumn("tenant", F.lit(tenant))


def object_listing(paths: DataFrame, prefix: str = "", delimiter: str | None = None, after: str | None = None, most: int = 1000) -> DataFrame:
    """A page of keys under a prefix, with their common prefixes up to the delimiter as one
    entry each, in order after a marker."""
    rest = F.substr("path", F.lit(len(prefix) + 1))
    out = paths.where(F.col("path").startswith(prefix))
    if delimiter:
        cut = F.instr(rest, delimiter)
        entry = F.when(cut > 0, F.concat(F.lit(prefix), F.substr(rest, F.lit(1), cut + len(delimiter) - 1))).otherwise(F.col("path"))
        out = out.select(entry.alias("key"), (cut > 0).alias("is_prefix")).distinct()
    else:
        out = out.select(F.col("path").alias("key"), F.lit(False).alias("is_prefix"))
    if after is not None:
        out = out.where(F.col("key") > after)
    return out.orderBy("key").limit(most)


def in_scope(logs: DataFrame, scopes: list[tuple[str, str | None]]) -> DataFrame:
    """What a reader may see: (tenant, index) pairs, index None for all of a tenant."""
    ok = F.lit(False)
    for tenant, index in scopes:
        ok = ok | ((F.col("tenant") == tenant) & (F.lit(True) if index is None else F.col("index") == index))
    return logs.where(ok)


def unconfirmed(files: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Files whose (path, bytes) was never confirmed as uploaded."""
    return files.join(uploaded.select("path", "bytes"), ["path", "bytes"], "left_anti")


def pending_retires(files: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Uploads whose file is gone here."""
    return uploaded.join(files.select("path"), "path", "left_anti")


def audit_history(audit: DataFrame, limit: int) -> DataFrame:
    """The newest entries of an append-only audit."""
    return audit.orderBy(F.desc("at_ms"), F.desc("seq")).limit(limit)


def node_info(files: DataFrame, budget: int) -> DataFrame:
    """One row per index: files, rows, bytes and the share of the disk budget."""
    by = files.groupBy("tenant", "index").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return by.withColumn("disk_fraction", F.col("bytes") / F.lit(float(budget)) if budget else F.lit(0.0))


def shed(logs: DataFrame, capacity: int, pressure: str = "normal") -> DataFrame:
    """Adds `admitted` per arrival second: at critical pressure debug records are refused;
    beyond the capacity of a second debug and then info records are, never warnings."""
    from pyspark.sql import Window

    from ..functions.severity import level_class
    from ..functions.times import int_div

    rank = F.when(F.col("severity") >= 13, 0).when(F.col("severity") >= 9, 1).otherwise(2)
    second = Window.partitionBy(int_div(F.col("observed_ns"), 1_000_000_000)).orderBy(rank, "observed_ns", "event_id")
    fits = (F.row_number().over(second) <= capacity) | (rank == 0)
    calm = F.lit(pressure != "critical") | (level_class(F.col("severity")) != "debug")
    return logs.withColumn("admitted", fits & calm)


def inventory(parts: DataFrame, node: str | None = None) -> DataFrame:
    """What a catalog says its parts are: name, size, rows; of one node, if given."""
    rows = parts if node is None else parts.where(F.col("node") == node)
    return rows.select("name", F.col("bytes").alias("size"), "rows")


def acknowledged(requests: DataFrame, synced: int, kept: int = 10_000) -> DataFrame:
    """Requests (channel, ack_id, last: the number of their last record) with `acked`: true
    once all records up to `last` are written. A channel remembers its newest `kept` ids;
    what it has forgotten isn't acknowledged."""
    newest = requests.groupBy(F.col("channel").alias("c")).agg(F.max("ack_id").alias("newest"))
    out = requests.join(newest, F.col("channel").eqNullSafe(F.col("c"))).drop("c")
    return out.withColumn("acked", (F.col("last") <= synced) & (F.col("ack_id") > F.col("newest") - kept)).drop("newest")
