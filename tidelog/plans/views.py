"""Log views over the events table that exercise what plain bodies don't: lines of many
forms, and a storm after quiet traffic. Each is written twice, for Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import bucket_for
from ..functions.times import format_hour, ns_of_naive
from ..sources import records

NS = 1_000_000_000
#: When the storm view begins, and how far its cycles of 4,000 records are apart.
BEGIN, CYCLE_NS, CYCLE = 1_700_000_000 * NS, 8_000 * NS, 4_000


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _record(e: DataFrame, at: Column, severity: Column, body: Column, service: Column, trace: Column, origin: Column) -> DataFrame:
    given = F.array(records.attr("n", "I64", F.col("event_id")))
    rows = e.select(
        F.unhex(F.lpad(F.hex("event_id"), 32, "0")).alias("event_id"), at.alias("timestamp_ns"), at.alias("observed_ns"), severity.cast("short").alias("severity"), F.lit(None).cast("string").alias("severity_text"),
        body.alias("body"), service.alias("service"), trace.alias("trace_id"), F.lit(None).cast("binary").alias("span_id"), F.lit(None).cast("long").alias("template_id"), given.alias("attributes"), origin.alias("origin"),
    )
    return rows


def mixed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Eight forms of lines: asides, units, components, paths, quotes, pairs, hashes, and
    one that widens."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    n, user, k = F.col("event_id"), F.col("user_id"), F.col("k")
    volume = F.when((n / 24).cast("long") % 3 == 0, "alpha").otherwise("beta")
    forms = [
        _text("user ", user, " logged in from 10.0.", user % 250, ".7 (attempt ", k, ")"),
        _text("[worker] job ", n, " done in ", F.col("value"), " ms"),
        _text("open /var/data/", user, "/f", k, ".bin failed"),
        _text('state "q', k, '" reached after ', k, " retries"),
        _text("the nightly backup of volume ", volume, " finished without errors on every node"),
        _text("cfg timeout=", k, "s, retries=", user, "; mode=fast"),
        _text("id 0x", F.lower(F.lpad(F.hex(n), 16, "0")), " at 2024-01-02T03:04:05Z"),
        _text("request ", F.lower(F.lpad(F.hex(user), 8, "0")), "-0000-4000-8000-", F.lower(F.lpad(F.hex(n), 12, "0")), " size ", k, " KB"),
    ]
    body = forms[7]
    for i in range(7):
        body = F.when(n % 8 == i, forms[i]).otherwise(body)
    return _record(e, ns_of_naive(F.col("ts")), F.lit(9), body, _text("svc-", n % 3), F.lit(None).cast("binary"), F.lit("node-0"))


#: The same lines with the template and the parameters that each has, apart from the one
#: that widens: f = 4, with its word in `volume`.
LINES = """lines AS (SELECT *, CASE f WHEN 0 THEN 'user ' || user_id || ' logged in from 10.0.' || (user_id % 250) || '.7 (attempt ' || k || ')'
    WHEN 1 THEN '[worker] job ' || seq || ' done in ' || value || ' ms' WHEN 2 THEN 'open /var/data/' || user_id || '/f' || k || '.bin failed'
    WHEN 3 THEN 'state "q' || k || '" reached after ' || k || ' retries' WHEN 4 THEN 'the nightly backup of volume ' || volume || ' finished without errors on every node'
    WHEN 5 THEN 'cfg timeout=' || k || 's, retries=' || user_id || '; mode=fast' WHEN 6 THEN 'id 0x' || printf('%016x', seq) || ' at 2024-01-02T03:04:05Z'
    ELSE 'request ' || printf('%08x', user_id) || '-0000-4000-8000-' || printf('%012x', seq) || ' size ' || k || ' KB' END AS body,
  CASE f WHEN 0 THEN 'user <NUM> logged in from <IP>' WHEN 1 THEN '<COMP> job <NUM> done in <NUM>' WHEN 2 THEN 'open <PATH> failed' WHEN 3 THEN 'state <STR> reached after <NUM> retries'
    WHEN 5 THEN 'cfg timeout=<NUM>, retries=<NUM>; mode=fast' WHEN 6 THEN 'id <HEX> at <TIME>' WHEN 7 THEN 'request <UUID> size <NUM>' END AS template,
  CASE f WHEN 0 THEN [user_id::VARCHAR, '10.0.' || (user_id % 250) || '.7'] WHEN 1 THEN ['[worker]', seq::VARCHAR, value::VARCHAR] WHEN 2 THEN ['/var/data/' || user_id || '/f' || k || '.bin']
    WHEN 3 THEN ['"q' || k || '"', k] WHEN 5 THEN [k || 's', user_id::VARCHAR] WHEN 6 THEN ['0x' || printf('%016x', seq), '2024-01-02T03:04:05Z']
    WHEN 7 THEN [printf('%08x', user_id) || '-0000-4000-8000-' || printf('%012x', seq), k] ELSE [] END AS params
  FROM (SELECT event_id AS seq, printf('%032x', event_id) AS id, epoch_us(ts) * 1000 AS ts_ns, 'svc-' || (event_id % 3) AS service, event_id % 8 AS f,
    CASE WHEN event_id // 24 % 3 = 0 THEN 'alpha' ELSE 'beta' END AS volume, user_id, value, props->>'$.k' AS k FROM events))"""


def storm(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of ten-second buckets: 60 of 40 records, 5 of 200 with many errors and slow
    requests, 15 of 40 in which a service and a template are silent; then two hours of nothing."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    n = F.col("event_id")
    p = n % CYCLE
    calm, wild = p < 2400, (p >= 2400) & (p < 3400)
    whole = lambda a, m: ((a - a % m) / m).cast("long")
    bucket = F.when(calm, whole(p, 40)).when(wild, whole(p - 2400, 200) + 60).otherwise(whole(p - 3400, 40) + 65)
    q = F.when(calm, p % 40).when(wild, (p - 2400) % 200).otherwise((p - 3400) % 40)
    at = F.lit(BEGIN) + whole(n, CYCLE) * CYCLE_NS + bucket * (10 * NS) + q * 50_000_000
    quiet, t = ~calm & ~wild, q % 20
    api = q % 2 == 0
    service = F.when(api, "api").when(~quiet & (q % 4 == 1), "db")
    failed = api & ((t == 0) | (wild & t.isin(2, 4, 8)))
    cached = api & ~quiet & t.isin(6, 10)
    body = F.when(failed, _text("upstream ", n, " failed with code 50", q % 3)).when(cached, _text("cache hit after ", q, " probes"))
    body = body.when(api, _text("request ", n, " took ", F.when(wild, 900 + q % 5).otherwise(100 + q % 5), "ms")).when(service == "db", _text("query ", n, " read ", q, " rows")).otherwise("tick")
    trace = F.unhex(F.lpad(F.hex(whole(n + 9, 20)), 32, "0"))
    return _record(e, at, F.when(failed, 17).otherwise(9), body, service, trace, _text("node-", whole(n, 2000) % 2))


STORM = f"""storm AS (SELECT *, CASE WHEN failed THEN 17 ELSE 9 END::SMALLINT AS severity, CASE WHEN failed THEN 'warn_plus' ELSE 'info' END AS level,
  CASE WHEN failed THEN 'upstream ' || seq || ' failed with code 50' || q % 3 WHEN cached THEN 'cache hit after ' || q || ' probes' WHEN api THEN 'request ' || seq || ' took ' || took || 'ms' WHEN service = 'db' THEN 'query ' || seq || ' read ' || q || ' rows' ELSE 'tick' END AS body,
  CASE WHEN failed THEN 'upstream <NUM> failed with code <NUM>' WHEN cached THEN 'cache hit after <NUM> probes' WHEN api THEN 'request <NUM> took <NUM>' WHEN service = 'db' THEN 'query <NUM> read <NUM> rows' ELSE 'tick' END AS template,
  CASE WHEN failed THEN [seq, 500 + q % 3] WHEN cached THEN [q] WHEN api THEN [seq, took] WHEN service = 'db' THEN [seq, q] ELSE [] END AS numbers
  FROM (SELECT *, q % 2 = 0 AS api, CASE WHEN q % 2 = 0 THEN 'api' WHEN part < 2 AND q % 4 = 1 THEN 'db' END AS service, q % 2 = 0 AND (q % 20 = 0 OR part = 1 AND q % 20 IN (2, 4, 8)) AS failed,
    part < 2 AND q % 20 IN (6, 10) AS cached, CASE WHEN part = 1 THEN 900 + q % 5 ELSE 100 + q % 5 END AS took, {BEGIN} + seq // {CYCLE} * {CYCLE_NS} + b * {10 * NS} + q * 50000000 AS ts_ns
    FROM (SELECT event_id AS seq, printf('%032x', event_id) AS id, printf('%032x', (event_id + 9) // 20) AS trace, 'node-' || (event_id // 2000 % 2) AS origin, p,
      CASE WHEN p < 2400 THEN 0 WHEN p < 3400 THEN 1 ELSE 2 END AS part, CASE WHEN p < 2400 THEN p // 40 WHEN p < 3400 THEN 60 + (p - 2400) // 200 ELSE 65 + (p - 3400) // 40 END AS b,
      CASE WHEN p < 2400 THEN p % 40 WHEN p < 3400 THEN (p - 2400) % 200 ELSE (p - 3400) % 40 END AS q FROM (SELECT event_id, event_id % {CYCLE} AS p FROM events))))"""


def with_paths(rows: DataFrame) -> DataFrame:
    """Adds hour and level as the store has them."""
    return rows.withColumn("hour", format_hour(F.col("timestamp_ns"))).withColumn("level", bucket_for(F.col("severity")))
