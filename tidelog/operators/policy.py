"""Retention, disk reclaim, pins and previews over the list of a store's files.

Files are rows (path, tenant, index, hour, level, node, bytes, min_ts, max_ts ...): a file
list is small beside the data, and stays a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import DEFAULT_BUCKETS, Bucket, retention_secs
from ..functions.times import parse_hour

IDENT = r"^(?=.*[A-Za-z])[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}$"


def valid_ident(name: Column) -> Column:
    """1 to 64 of letters, digits and ._-, with a letter and no leading dot."""
    return name.rlike(IDENT)


def valid_part(name: Column) -> Column:
    return name.rlike(r"^[0-9a-f]{64}\.parquet$")


def path_of() -> Column:
    return F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.col(c)) for c in ("tenant", "index", "hour", "level", "node")))


def key_of_path(path: Column) -> Column:
    """The five parts of a store path in their order, null for any other path."""
    pattern = "".join(f"{c}=([^/]+)/" for c in ("tenant", "index", "hour", "level", "node"))
    got = F.struct(*(F.regexp_extract(path, pattern, i + 1).alias(c) for i, c in enumerate(("tenant", "index", "hour", "level", "node"))))
    return F.when(path.rlike(pattern) & parse_hour(F.regexp_extract(path, pattern, 3)).isNotNull(), got)


def retention(files: DataFrame, now_secs: int, buckets: tuple[Bucket, ...] = DEFAULT_BUCKETS, scopes: list[tuple[str, str]] | None = None, pins: DataFrame | None = None) -> DataFrame:
    """Files with `verdict`: expired once the hour's end plus the bucket's time has come,
    orphan where tenant, index or bucket is unknown (never deleted), pinned if in `pins`
    (paths) though expired, else kept."""
    keep = retention_secs(F.col("level"), buckets)
    known = keep.isNotNull()
    if scopes is not None:
        known = known & F.concat_ws("/", "tenant", "index").isin([f"{t}/{i}" for t, i in scopes])
    due = (parse_hour(F.col("hour")) + 1) * 3600 + keep <= now_secs
    verdict = F.when(~F.coalesce(known, F.lit(False)), "orphan").when(due, "expired").otherwise("kept")
    out = files.withColumn("verdict", verdict)
    if pins is None:
        return out
    marked = pins.select(F.col("path").alias("p")).distinct().withColumn("pin", F.lit(True))
    out = out.join(marked, F.col("path") == F.col("p"), "left")
    return out.withColumn("verdict", F.when((F.col("verdict") == "expired") & F.col("pin"), "pinned").otherwise(F.col("verdict"))).drop("p", "pin")


def per_bucket(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def pressure(used: Column, budget: Column) -> Column:
    """critical from 95 % of the budget, high from 80 %; a budget of 0 is none."""
    share = F.when(budget > 0, used / budget).otherwise(F.lit(0.0))
    return F.when(share >= 0.95, "critical").when(share >= 0.80, "high").otherwise("normal")


def reclaim(files: DataFrame, used: int, budget: int, buckets: tuple[Bucket, ...] = DEFAULT_BUCKETS, target: float = 0.70) -> DataFrame:
    """The files to delete, shortest-kept bucket first, then oldest, then by path; buckets
    that aren't known last; until what is used is at most the target share. Sums are taken
    per (order, hour) first; the window over those is small."""
    goal = int(budget * target)
    files = files.withColumn("__rank", F.coalesce(retention_secs(F.col("level"), buckets), F.lit(2**62)))
    per = files.groupBy("__rank", "min_ts").agg(F.sum("bytes").alias("b"))
    all_before = Window.orderBy("__rank", "min_ts").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.coalesce(F.sum("b").over(all_before), F.lit(0))).select(F.col("__rank").alias("r"), F.col("min_ts").alias("m"), "base")
    inside = Window.partitionBy("__rank", "min_ts").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("__in", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    out = files.join(per, (F.col("__rank") == F.col("r")) & F.col("min_ts").eqNullSafe(F.col("m")))
    return out.where(F.lit(used) - (F.col("base") + F.col("__in")) > goal).drop("__rank", "__in", "r", "m", "base")


def impact(files: DataFrame, now_secs: int, budget: int, buckets: tuple[Bucket, ...] = DEFAULT_BUCKETS, trigger: float = 0.95) -> DataFrame:
    """What a policy would delete now, by path: first what has expired, then, if the rest
    is still critical, what reclaim takes of it."""
    judged = retention(files, now_secs, buckets)
    gone = judged.where("verdict = 'expired'").select("path", "level", "bytes", F.lit("retention").alias("why"))
    left = judged.where("verdict <> 'expired'").drop("verdict")
    used = left.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if budget <= 0 or used < trigger * budget:
        return gone
    return gone.unionByName(reclaim(left, used, budget, buckets).select("path", "level", "bytes", F.lit("reclaim").alias("why")))


def beyond(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """Paths that a proposed policy deletes and the current one doesn't."""
    return proposed.join(current.select("path"), "path", "left_anti")


def orphan_levels(files: DataFrame, buckets: tuple[Bucket, ...]) -> DataFrame:
    """Levels with data that a bucket set doesn't name."""
    return files.where(~F.col("level").isin([b.name for b in buckets])).groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def pins(unconfirmed: DataFrame, pin_bytes: int, disk_budget: int) -> DataFrame:
    """Newest files whose running sum fits min(pin_bytes, budget / 4); the first that
    doesn't fit ends the run, so what follows it isn't pinned."""
    limit = min(pin_bytes, disk_budget // 4) if disk_budget else pin_bytes
    w = Window.orderBy(F.desc("max_ts"), F.desc("path")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return unconfirmed.withColumn("__sum", F.sum("bytes").over(w)).where(F.col("__sum") <= limit).drop("__sum")


def sweep(parts: DataFrame, now_ms: int, warm_secs: int, cold_secs: int, most: int = 1000) -> DataFrame:
    """Parts whose tier's time is over by their newest record; at most `most` a tier, the
    oldest first."""
    keep = F.when(F.col("tier") == "warm", warm_secs).when(F.col("tier") == "cold", cold_secs)
    due = parts.where(F.floor(F.col("max_observed") / 1_000_000) + keep * 1000 <= now_ms)
    w = Window.partitionBy("tier").orderBy("max_observed", "node", "name")
    return due.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def compactable(files: DataFrame, now_secs: int, min_files: int = 4, small: int = 32 << 20, target: int = 128 << 20, quiet: int = 600, most: int = 4) -> DataFrame:
    """Files to rewrite together: partitions oldest first that are quiet and have enough
    small files; of each, by path, those that fit the target size."""
    key = ["tenant", "index", "hour", "level", "node"]
    per = files.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("bytes") < small).alias("s"), F.max("written_secs").alias("newest"))
    per = per.where((F.col("n") >= min_files) & (F.col("s") >= min_files) & (F.col("newest") + quiet <= now_secs)).orderBy("hour", *key).limit(most).select(*key)
    w = Window.partitionBy(*key).orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = files.where(F.col("bytes") < small).join(per, key).withColumn("__sum", F.sum("bytes").over(w)).withColumn("__first", F.row_number().over(Window.partitionBy(*key).orderBy("path")) == 1)
    stop = F.max(F.when((F.col("__sum") > target) & ~F.col("__first"), 1).otherwise(0)).over(w)
    return some.withColumn("__stop", stop).where("__stop = 0").drop("__sum", "__first", "__stop")
