"""Queries over what the store has written, over streams that have run dry, and over the
smaller operators. They are part of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.times import ns_of_naive
from ..operators import catalog, context, dictionary, forward, mining, policy, scan, typed
from ..scratch import forget_at_exit, scratch_path
from ..sources import receivers, records, recovery, store
from ..streaming import jobs
from . import findings_sql as f
from . import sqltext as s
from . import views
from .catalogue import HI, LO, NS, hex_, ids_sql, labelled, logs, query, stormy

_written: dict[tuple[str, str], str] = {}
TYPED = [typed.TypedColumn("attr_n", "n", "int64", "")]


def written(spark: SparkSession, d: str) -> str:
    """The storm view in a store of its own, written once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _written:
        path = scratch_path(spark, "store")
        store.write(stormy(spark, d).drop("template"), path, TYPED, batch="b1")
        forget_at_exit(spark, path)
        _written[key] = path
    return _written[key]


_HOUR = "strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H')"
_STORED = f"h AS (SELECT *, {_HOUR} AS hour FROM l)"


@query(f.storm_sql("SELECT id, ts_ns, hour, level, seq AS n FROM (SELECT * FROM h WHERE severity >= 13 ORDER BY hour DESC, level DESC, service NULLS FIRST, trace NULLS FIRST, ts_ns, id LIMIT 137)", _STORED))
def store_scan_limited(spark: SparkSession, d: str) -> DataFrame:
    rows = store.scan(spark, written(spark, d), scan.Query(min_severity=13, limit=137), TYPED)
    return rows.select(hex_("event_id", "id"), F.col("timestamp_ns").alias("ts_ns"), "hour", "level", F.col("attr_n").alias("n"))


@query(f.storm_sql("SELECT hour, level, count(*) AS rows, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts, min(ts_ns) AS min_observed, max(ts_ns) AS max_observed FROM h GROUP BY ALL", _STORED))
def store_footers(spark: SparkSession, d: str) -> DataFrame:
    return store.footers(spark, written(spark, d)).drop("tenant", "index", "node")


@query(f.storm_sql("SELECT DISTINCT 'default' AS tenant, 'main' AS index_, hour, level, 'n0' AS node FROM h", _STORED))
def store_listing(spark: SparkSession, d: str) -> DataFrame:
    return store.listing(spark, written(spark, d)).select("tenant", F.col("index").alias("index_"), "hour", "level", "node").distinct()


@query(f.storm_sql("SELECT hour, level, service, count(*) AS n, sum(seq)::BIGINT AS total FROM h GROUP BY ALL", _STORED))
def store_after_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Written in three batches, one of them twice, then compacted; nothing is lost or doubled."""
    path = scratch_path(spark, "compacted")
    forget_at_exit(spark, path)
    rows = stormy(spark, d).drop("template")
    for k in (0, 1, 2, 1):
        store.write(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k), path, TYPED, batch=f"b{k}")
    store.compact(spark, path, 4_000_000_000, TYPED, min_files=2, most=1000)
    return store.read(spark, path, TYPED).groupBy("hour", "level", "service").agg(F.count("*").alias("n"), F.sum("attr_n").alias("total"))


@query(f.storm_sql("SELECT service, template_id, count(*) AS rows, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM l GROUP BY ALL"))
def store_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return recovery.rebuilt_dictionary(spark, written(spark, d)).drop("tenant", "index", "text")


# --- streams ---------------------------------------------------------------------------


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream has given when its input ends."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    for p in (path, state):
        forget_at_exit(spark, p)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The records of the storm view as a stream of the store's files."""
    schema = store.read(spark, written(spark, d), TYPED).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(written(spark, d))
    return rows.withColumn("attributes", records.attr_of_json(F.col("attributes")))


_OPEN = "z AS (SELECT max(ts_ns) AS last FROM l)"


@query(f.storm_sql(f"SELECT minute_ms, service, template_id, class, count, first_ns, last_ns, max_severity FROM (SELECT ts_ns // 60000000000 * 60000 AS minute_ms, service, template_id, CASE WHEN severity <= 12 THEN 'info' ELSE 'warn_plus' END AS class, count(*) AS count, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, max(severity) AS max_severity FROM l GROUP BY ALL), z WHERE (minute_ms + 60000) * 1000000 <= last - {5 * NS}", _OPEN))
def stream_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Minutes that the watermark has closed."""
    return _drained(jobs.minute_rollups(_stream(spark, d)), "rollups")


@query(f.storm_sql(f"SELECT service, bucket, total, errors, warns FROM (SELECT service, ts_ns // 10000000000 AS bucket, count(*) AS total, count(*) FILTER (WHERE severity >= 17) AS errors, count(*) FILTER (WHERE severity >= 13) AS warns FROM l GROUP BY ALL), z WHERE (bucket + 1) * 10000000000 <= last - {10 * NS}", _OPEN))
def stream_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _drained(jobs.bucket_counts(_stream(spark, d)), "buckets")


@query(f.storm_sql("SELECT id FROM l"))
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each record comes twice and is given once."""
    rows = _stream(spark, d)
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _drained(jobs.deduped(twice).select("event_id"), "once").select(hex_("event_id", "id"))


@query(f.storm_sql("SELECT id, template, template_id, row_number() OVER (PARTITION BY coalesce(service, ''), template ORDER BY ts_ns, id) = 1 AS is_new FROM l"))
def stream_mined(spark: SparkSession, d: str) -> DataFrame:
    """One batch, so lines are in order for every miner."""
    return _drained(jobs.mined(_stream(spark, d).drop("template_id"), "service"), "mined").select(hex_("event_id", "id"), "template", "template_id", "is_new")


# --- smaller operators -------------------------------------------------------------------


@query(s.with_logs(f"SELECT id, ts_ns < {HI} - 7200000000000 AS late FROM logs WHERE ts_ns >= {LO} AND ts_ns < {HI}"))
def late_records(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.matches(records.with_partitions(logs(spark, d)), scan.Query(LO, HI))
    return store.late(rows, HI).select(hex_("event_id", "id"), "late")


@query(ids_sql("SELECT template_id, count(*) AS rows FROM l GROUP BY ALL"))
def rows_by_template(spark: SparkSession, d: str) -> DataFrame:
    seen = dictionary.sightings(labelled(spark, d))
    return seen.groupBy("template_id").agg(F.sum("rows").alias("rows"))


@query(s.with_logs("SELECT id, coalesce((sum(octet_length(encode(body)) + 1) OVER (PARTITION BY service ORDER BY ts_ns, body, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) // 2048 AS frame FROM logs"))
def peer_frames(spark: SparkSession, d: str) -> DataFrame:
    lines = logs(spark, d).select("event_id", "service", "observed_ns", F.col("body").alias("value"))
    return forward.frames(lines, size=2048).select(hex_("event_id", "id"), "frame")


@query(s.with_logs("SELECT id, CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'edge' END AS origin, CASE WHEN seq % 2 = 0 THEN least(seq % 11 + 1, 8) ELSE 1 END AS hops FROM logs"))
def stamped_records(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    n = F.conv(F.hex(F.substring("event_id", 9, 8)), 16, 10).cast("long")
    came = F.array(records.attr("tidelog.origin", "Str", F.lit("a")), records.attr("tidelog.hops", "I64", n % 11))
    rows = rows.withColumn("attributes", F.when(n % 2 == 0, F.concat("attributes", came)).otherwise(F.col("attributes")))
    a = F.col("attributes")
    out = forward.stamped(rows, "edge")
    return out.select(hex_("event_id", "id"), records.first_value(a, "tidelog.origin", "Str").alias("origin"), records.first_value(a, "tidelog.hops", "I64").cast("long").alias("hops"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'normal' WHEN value / 40 >= 0.95 THEN 'critical' WHEN value / 40 >= 0.8 THEN 'high' ELSE 'normal' END AS pressure FROM events")
def disk_pressure(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", policy.pressure(F.col("value"), F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(40.0)).alias("pressure"))


@query(s.with_logs("SELECT id, 'acme' AS tenant FROM logs WHERE (service IS NULL OR service IN ('svc-1', 'svc-2')) AND (seq % 4 = 0 OR seq % 4 = 1)"))
def principal_admission(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    n = F.conv(F.hex(F.substring("event_id", 9, 8)), 16, 10).cast("long") % 4
    rows = rows.withColumn("requested", F.col("service")).withColumn("tenant_claim", F.when(n == 0, "acme").when(n != 1, "other"))
    return catalog.admitted(rows, "acme", ["svc-1", "svc-2"]).select(hex_("event_id", "id"), "tenant")


@query("SELECT event_id AS at_ms, event_type AS actor FROM events ORDER BY event_id DESC LIMIT 20")
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("at_ms"), F.col("event_type").alias("actor"), F.col("event_id").alias("seq"))
    return catalog.audit_history(e, 20).select("at_ms", "actor")


@query("SELECT sha256('{' || event_type) AS body_hash, octet_length(encode('{' || event_type))::BIGINT AS bytes FROM events WHERE event_id % 3 = 0")
def refused_bodies(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), "event_type")).otherwise(F.lit('{"event": "fine"}'))
    return receivers.refused(e.select(body.alias("value")), lambda t: receivers.collector_events(t, 1)).select("body_hash", "bytes")


@query(
    f"WITH {views.LINES}, h AS (SELECT template, {s.shape_hash('template')} AS hash FROM (SELECT DISTINCT template FROM lines WHERE template IS NOT NULL)) SELECT id, CASE WHEN f = 0 THEN 42 ELSE hash END AS template_id FROM lines JOIN h USING (template)"
)
def mined_missing(spark: SparkSession, d: str) -> DataFrame:
    """Records that come with a template keep it; the others are mined."""
    rows = views.mixed_lines(spark, d).where("not startswith(body, 'the nightly')")
    rows = rows.withColumn("template_id", F.when(F.col("body").startswith("user "), F.lit(42)).cast("long"))
    return mining.mine_missing(rows, ["service"], ["observed_ns", "event_id"]).select(hex_("event_id", "id"), "template_id")


@query("SELECT 'svc' AS service, event_type || '!' AS text FROM events WHERE event_id % 5 = 0")
def rewrapped_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of the older form, wrapped as envelopes and read again."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_id % 5 = 0")
    body = F.to_json(F.struct(F.concat("event_type", F.lit("!")).alias("message"), F.lit("svc").alias("server_name"), F.struct(F.col("event_id").cast("string").alias("n")).alias("tags")))
    wrap = lambda b: receivers.envelope_records(receivers.wrap_store_body(bytes(b), "0" * 32), 1, "7")
    got = receivers.decoded(e.select(F.encode(body, "UTF-8").alias("value"), "event_id"), wrap, request="event_id")
    return got.select("service", F.col("body").alias("text"))


@query(s.with_logs("SELECT id, hour FROM (SELECT printf('%032x', event_id) AS id, strftime(ts, '%Y-%m-%dT%H') AS hour FROM events)"))
def arrival_hours(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.unhex(F.lpad(F.hex("event_id"), 32, "0")).alias("event_id"), ns_of_naive(F.col("ts")).alias("observed_ns"))
    return jobs.arrival(rows).select(hex_("event_id", "id"), F.date_format(F.col("observed_at"), "yyyy-MM-dd'T'HH").alias("hour"))


@query(f"WITH {views.STORM} SELECT id, trace AS key, 'trace' AS key_tier FROM storm")
def storm_keys(spark: SparkSession, d: str) -> DataFrame:
    return context.correlation_key(views.storm(spark, d)).select(hex_("event_id", "id"), "key", "key_tier")


@query(f.storm_sql("SELECT template, template_id FROM sids"))
def storm_templates(spark: SparkSession, d: str) -> DataFrame:
    rows = mining.mine_templates(views.storm(spark, d), ["service"], ["observed_ns", "event_id"]).select("template").distinct()
    return rows.withColumn("template_id", hashing.shape_hash(F.col("template")))
