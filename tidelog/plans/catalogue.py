"""Every registered query of the log engine with its SQL counterpart.

Queries run over whole tables through the operators; the SQL is written against the raw
tables and shares no code with them but fixed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, masking, severity, times
from ..operators import catalog, context, dictionary, forward, mining, planner, policy, reports, rollup, scan, shapes, signals, suggestions, typed
from ..sources import lines, receivers, records
from . import findings_sql as f
from . import sqltext as s
from . import views

Run = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Run] = {}
_sql: dict[str, str] = {}

#: A window of two days and one of an hour.
LO, HI = 1_704_844_800_000_000_000, 1_705_017_600_000_000_000
ONE_HOUR = LO + s.HOUR
NOW = 1_706_745_600
NS = 1_000_000_000


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def add(f: Run) -> Run:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Run]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def logs(spark: SparkSession, d: str) -> DataFrame:
    return records.event_logs(spark, d)


def stored(spark: SparkSession, d: str) -> DataFrame:
    return records.with_partitions(logs(spark, d))


def hex_(c: str, name: str | None = None):
    return F.lower(F.hex(c)).alias(name or c)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Stored records with the id of their masked text."""
    return hashing.with_shape_hash(shapes.with_text(stored(spark, d)), "template")


def stormy(spark: SparkSession, d: str) -> DataFrame:
    """The storm view with the ids of its masked texts."""
    return hashing.with_shape_hash(shapes.with_text(views.storm(spark, d)), "template")


def ids_sql(select: str, *more: str) -> str:
    """With `logs` and `l`, logs labelled by template_id."""
    ids = f"ids AS (SELECT template, {s.shape_hash('template')} AS template_id FROM (SELECT DISTINCT template FROM logs))"
    return s.with_logs(select, ids, "l AS (SELECT * FROM logs JOIN ids USING (template))", *more)


# --- scans -----------------------------------------------------------------------------


@query(s.with_logs(f"SELECT id, ts_ns, severity, service, body FROM logs WHERE ts_ns >= {LO} AND ts_ns < {HI} AND service = 'svc-3' AND severity >= 9 AND contains(body, 'user=1')"))
def scan_filtered(spark: SparkSession, d: str) -> DataFrame:
    q = scan.Query(LO, HI, "svc-3", 9, "user=1")
    return scan.matches(stored(spark, d), q).select(hex_("event_id", "id"), F.col("timestamp_ns").alias("ts_ns"), "severity", "service", "body")


_ORDER = "hour DESC, level DESC, service NULLS FIRST, trace NULLS FIRST, ts_ns, id"


@query(s.with_logs(f"SELECT id, ts_ns, hour, level FROM (SELECT * FROM logs WHERE severity >= 9 AND ts_ns < {HI} ORDER BY {_ORDER} LIMIT 137)"))
def scan_limited(spark: SparkSession, d: str) -> DataFrame:
    q = scan.Query(None, HI, None, 9, None, 137)
    return scan.scan(stored(spark, d), q).select(hex_("event_id", "id"), F.col("timestamp_ns").alias("ts_ns"), "hour", "level")


@query(s.with_logs(f"SELECT count(*) AS n, count(*) >= 50 AS truncated FROM (SELECT * FROM logs WHERE ts_ns >= {LO} ORDER BY {_ORDER} LIMIT 50)"))
def scan_truncated(spark: SparkSession, d: str) -> DataFrame:
    return scan.truncated(stored(spark, d), scan.Query(from_ns=LO, limit=50))


@query(s.with_logs(f"SELECT id, row_number() OVER (ORDER BY hour, level, ts_ns, id) AS at FROM logs WHERE ts_ns >= {LO} AND ts_ns < {LO + 6 * s.HOUR}"))
def scan_streaming(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.numbered(stored(spark, d), scan.Query(LO, LO + 6 * s.HOUR))
    return rows.select(hex_("event_id", "id"), F.col("at").cast("long").alias("at"))


@query(s.with_logs(f"SELECT id, ts_ns FROM (SELECT * FROM logs WHERE ts_ns >= {HI - 7200 * NS} AND severity >= 13 ORDER BY {_ORDER} LIMIT 20)"))
def scan_recent(spark: SparkSession, d: str) -> DataFrame:
    return scan.recent(stored(spark, d), HI, 7200, None, 13, 20).select(hex_("event_id", "id"), F.col("timestamp_ns").alias("ts_ns"))


@query(s.with_logs(f"SELECT DISTINCT hour, level FROM logs WHERE level IN ('info', 'warn_plus') AND hour >= '2024-01-10T00' AND hour < '2024-01-12T00'"))
def scan_plan(spark: SparkSession, d: str) -> DataFrame:
    return scan.plan(scan.file_table(stored(spark, d)), scan.Query(LO, HI, min_severity=9)).select("hour", "level")


@query(
    s.with_logs(
        "SELECT count(*) AS files_considered, count(*) FILTER (WHERE NOT open) AS files_pruned, sum(n) FILTER (WHERE open)::BIGINT AS rows_scanned, sum(m) FILTER (WHERE open)::BIGINT AS rows_matched "
        f"FROM (SELECT hour, level, count(*) AS n, count(*) FILTER (WHERE ts_ns >= {LO} AND ts_ns < {HI} AND severity >= 17) AS m, level = 'warn_plus' AND hour >= '2024-01-10T00' AND hour < '2024-01-12T00' AS open FROM logs GROUP BY ALL)"
    )
)
def scan_statistics(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_stats(stored(spark, d), scan.Query(LO, HI, min_severity=17))


@query(s.with_logs("SELECT hour, level, count(*) AS rows, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts, min(ts_ns) AS min_observed, max(ts_ns) AS max_observed FROM logs GROUP BY ALL"))
def file_statistics(spark: SparkSession, d: str) -> DataFrame:
    return scan.file_table(stored(spark, d)).drop("tenant", "index", "node")


@query(
    s.with_logs(
        "SELECT path, epoch_hour, row_number() OVER (ORDER BY epoch_hour, path) AS at FROM (SELECT DISTINCT 'tenant=default/index=main/hour=' || hour || '/level=' || level || '/node=n0' AS path, ts_ns // 3600000000000 AS epoch_hour FROM logs)"
    )
)
def file_order(spark: SparkSession, d: str) -> DataFrame:
    return scan.files_in_order(scan.file_table(stored(spark, d)))


# --- counts ----------------------------------------------------------------------------


@query(ids_sql("SELECT service, template, template_id, count(*) AS n FROM l GROUP BY ALL"))
def spine(spark: SparkSession, d: str) -> DataFrame:
    return shapes.spine(logs(spark, d))


@query(s.with_logs("SELECT count(*) AS n FROM logs WHERE severity >= 17"))
def count_errors(spark: SparkSession, d: str) -> DataFrame:
    return shapes.errors(logs(spark, d))


@query(ids_sql("SELECT template, template_id, count(*) AS n FROM l GROUP BY ALL ORDER BY n DESC, template LIMIT 3"))
def top_templates(spark: SparkSession, d: str) -> DataFrame:
    return shapes.top_templates(logs(spark, d), 3)


@query(s.with_logs("SELECT service, count(*) AS n FROM logs WHERE level = 'warn_plus' GROUP BY service"))
def level_group(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).where("level = 'warn_plus'").groupBy("service").agg(F.count("*").alias("n"))


@query(ids_sql(f"SELECT service, template, template_id, count(*) AS n FROM l WHERE ts_ns >= {LO} AND ts_ns < {HI} GROUP BY ALL"))
def window_spine(spark: SparkSession, d: str) -> DataFrame:
    return shapes.spine(shapes.in_window(logs(spark, d), LO, HI))


@query(s.with_logs(f"SELECT count(*) AS n FROM logs WHERE ts_ns >= {LO} AND ts_ns < {HI}"))
def window_count(spark: SparkSession, d: str) -> DataFrame:
    return shapes.in_window(logs(spark, d), LO, HI).agg(F.count("*").alias("n"))


@query(s.with_logs("SELECT level, count(*) AS n FROM logs GROUP BY level"))
def count_by_level(spark: SparkSession, d: str) -> DataFrame:
    return shapes.by_level(stored(spark, d))


@query(s.with_logs("SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) - count(DISTINCT id) AS duplicates FROM (SELECT id FROM logs UNION ALL SELECT id FROM logs WHERE seq % 7 = 0)"))
def duplicate_count(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    again = rows.where(F.conv(F.hex(F.substring("event_id", 9, 8)), 16, 10).cast("long") % 7 == 0)
    return shapes.duplicates(rows.union(again))


@query(s.with_logs(f"SELECT service, template, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, max(severity) AS severity FROM logs WHERE ts_ns >= {LO} AND ts_ns < {ONE_HOUR} AND severity >= 13 GROUP BY ALL"))
def issue_list(spark: SparkSession, d: str) -> DataFrame:
    return shapes.issue_list(logs(spark, d), LO, ONE_HOUR)


@query(s.with_logs("SELECT id, ts_ns, body FROM logs WHERE trace = (SELECT trace FROM logs WHERE trace IS NOT NULL GROUP BY trace ORDER BY count(*) DESC, trace LIMIT 1)"))
def trace_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    top = rows.where("trace_id is not null").groupBy("trace_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "trace_id").limit(1).select("trace_id")
    return rows.join(F.broadcast(top), "trace_id").select(hex_("event_id", "id"), F.col("timestamp_ns").alias("ts_ns"), "body")  # one row


@query(s.with_logs(f"SELECT id, ts_ns, body FROM logs WHERE trace = printf('%032x', 7 * 1000000 + {LO} // 3600000000000 + 5) AND ts_ns >= {LO - 1800 * NS} AND ts_ns < {LO + 12 * s.HOUR}"))
def trace_with_hint(spark: SparkSession, d: str) -> DataFrame:
    trace = F.unhex(F.lit(f"{7 * 1_000_000 + LO // s.HOUR + 5:032x}"))
    rows = scan.matches(stored(spark, d), scan.Query(LO - 1800 * NS, LO + 12 * s.HOUR)).where(F.col("trace_id") == trace)
    return rows.select(hex_("event_id", "id"), F.col("timestamp_ns").alias("ts_ns"), "body")


@query(ids_sql(f"SELECT id, ts_ns, service, body FROM l WHERE template_id = {hashing.shape_hash_of('error user=<NUM> took <NUM>')} AND ts_ns >= {LO} AND ts_ns < {HI}"))
def template_in_window(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.in_window(labelled(spark, d), LO, HI).where(F.col("template_id") == hashing.shape_hash_of("error user=<NUM> took <NUM>"))
    return rows.select(hex_("event_id", "id"), F.col("timestamp_ns").alias("ts_ns"), "service", "body")


@query(s.with_logs(f"SELECT ts_ns, severity, template, body FROM logs WHERE service = 'svc-5' AND level = 'warn_plus' AND ts_ns >= {LO} AND ts_ns < {HI}"))
def service_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = shapes.with_text(scan.matches(stored(spark, d), scan.Query(LO, HI, "svc-5", 13)))
    return rows.select(F.col("timestamp_ns").alias("ts_ns"), "severity", "template", "body")


@query(s.with_logs("SELECT trace, count(*) AS n FROM logs WHERE trace IS NOT NULL GROUP BY trace HAVING count(*) > 1"))
def busy_traces(spark: SparkSession, d: str) -> DataFrame:
    return shapes.busy_traces(logs(spark, d), 1).select(hex_("trace_id", "trace"), "n")


@query(s.with_logs("SELECT any_value(level) AS level, count(DISTINCT service) AS services FROM logs WHERE level = 'info'"))
def any_level(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).where("level = 'info'").agg(F.any_value("level").alias("level"), F.countDistinct("service").alias("services"))


@query(s.with_logs("SELECT string_agg(level || '=' || n, ',' ORDER BY level) AS counts FROM (SELECT level, count(*) AS n FROM logs GROUP BY level)"))
def counts_as_text(spark: SparkSession, d: str) -> DataFrame:
    by = shapes.by_level(stored(spark, d)).withColumn("t", F.concat("level", F.lit("="), "n"))
    return by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "t"))), lambda x: x["t"]), ",").alias("counts"))


@query(ids_sql("SELECT coalesce(CASE WHEN severity >= 9 THEN template_id::VARCHAR END, 'none') AS template, count(*) AS n FROM l GROUP BY ALL"))
def count_with_none(spark: SparkSession, d: str) -> DataFrame:
    key = F.coalesce(F.when(F.col("severity") >= 9, F.col("template_id").cast("string")), F.lit("none"))
    return labelled(spark, d).groupBy(key.alias("template")).agg(F.count("*").alias("n"))


@query(s.with_logs("SELECT median(n) AS median, max(n) AS max FROM (SELECT hour, level, count(*) AS n FROM logs GROUP BY ALL)"))
def partition_sizes(spark: SparkSession, d: str) -> DataFrame:
    return scan.file_table(stored(spark, d)).agg(F.median("rows").alias("median"), F.max("rows").alias("max"))


@query(s.with_logs("SELECT service, min(ts_ns) FILTER (WHERE severity >= 17) AS first_error, max(value) FILTER (WHERE severity < 9) AS slowest_debug FROM logs GROUP BY service"))
def filtered_aggregates(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d).withColumn("value", F.get("attributes", 1)["value"]["F64"])
    return rows.groupBy("service").agg(F.min(F.when(F.col("severity") >= 17, F.col("timestamp_ns"))).alias("first_error"), F.max(F.when(F.col("severity") < 9, F.col("value"))).alias("slowest_debug"))


_GAPS = "g AS (SELECT template, ts_ns - lag(ts_ns) OVER (PARTITION BY template ORDER BY ts_ns, id) AS gap FROM logs), gaps AS (SELECT template, gap FROM g WHERE gap IS NOT NULL)"


@query(s.with_logs("SELECT template, list_sort(list(gap))[floor((count(*) - 1) * 0.5)::BIGINT + 1] AS p50, list_sort(list(gap))[floor((count(*) - 1) * 0.9)::BIGINT + 1] AS p90, list_sort(list(gap))[floor((count(*) - 1) * 0.99)::BIGINT + 1] AS p99 FROM gaps GROUP BY template", _GAPS))
def gap_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return shapes.percentiles(shapes.gaps(logs(spark, d)), "gap_ns", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, "template")


@query(s.with_logs(f"SELECT round(count(*) FILTER (WHERE gap <= {60 * NS}) * 100.0 / count(*), 4) AS within_60s, round(count(*) FILTER (WHERE gap <= {600 * NS}) * 100.0 / count(*), 4) AS within_600s FROM gaps", _GAPS))
def gap_shares(spark: SparkSession, d: str) -> DataFrame:
    out = shapes.share_within(shapes.gaps(logs(spark, d)), [60 * NS, 600 * NS])
    return out.select(*(F.col(c).cast("double").alias(c) for c in out.columns))


@query(s.with_logs(f"SELECT first_ns - first_ns % {s.MINUTE} AS minute_ns, count(*) AS n FROM (SELECT template, min(ts_ns) AS first_ns FROM logs GROUP BY template) GROUP BY ALL"))
def new_templates_per_minute(spark: SparkSession, d: str) -> DataFrame:
    return shapes.new_per_minute(logs(spark, d))


@query(
    s.with_logs(
        "SELECT coalesce(sum(n) FILTER (WHERE n = np AND n = nt), 0) / sum(n) AS accuracy, count(*) FILTER (WHERE n = np AND n = nt) AS groups FROM (SELECT n, sum(n) OVER (PARTITION BY template) AS np, sum(n) OVER (PARTITION BY truth) AS nt FROM (SELECT template, CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE event_type END AS truth, count(*) AS n FROM logs GROUP BY ALL))"
    )
)
def parsing_accuracy(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get("attributes", 2)["value"]["Str"]
    rows = shapes.with_text(logs(spark, d)).withColumn("truth", F.when(kind.isin("view", "click"), "read").otherwise(kind))
    return shapes.parsing_accuracy(rows, "template", "truth")


@query(s.with_logs("SELECT id, (row_number() OVER (ORDER BY ts_ns, id) - 1) // 500 AS segment FROM logs"))
def row_segments(spark: SparkSession, d: str) -> DataFrame:
    return shapes.segments(logs(spark, d), 500).select(hex_("event_id", "id"), "segment")


@query(
    s.with_logs(
        "SELECT service, previous, template, min(ts_ns) AS first_ns, count(*) AS n FROM (SELECT *, lag(template) OVER (PARTITION BY trace ORDER BY ts_ns, id) AS previous FROM logs WHERE trace IS NOT NULL) WHERE previous <> template GROUP BY ALL"
    )
)
def flow_steps(spark: SparkSession, d: str) -> DataFrame:
    return shapes.flows(logs(spark, d))


@query(s.with_logs("SELECT service, template, first_ns, first_ns = min(first_ns) OVER (PARTITION BY template) AS first_ever FROM (SELECT service, template, min(ts_ns) AS first_ns FROM logs GROUP BY ALL)"))
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return shapes.first_seen(logs(spark, d))


@query(s.with_logs(f"SELECT template, service, ts_ns - ts_ns % {s.MINUTE} AS minute_ns, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, count(DISTINCT trace) AS traces, min(body) AS exemplar FROM logs GROUP BY ALL"))
def spine_payload(spark: SparkSession, d: str) -> DataFrame:
    return shapes.spine_payload(logs(spark, d))


@query(s.with_logs("SELECT template, count(*) AS n, true AS close FROM logs GROUP BY template"))
def sketch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Whether the estimated number of distinct bodies is within three standard errors."""
    sketch = shapes.sketch_counts(logs(spark, d))
    exact = shapes.with_text(logs(spark, d)).groupBy(F.col("template").alias("t")).agg(F.countDistinct("body").alias("true_bodies"))
    close = F.abs(F.col("bodies") - F.col("true_bodies")) <= F.greatest(0.06 * F.col("true_bodies"), F.lit(1.0))
    return sketch.join(exact, F.col("template") == F.col("t")).select("template", "n", close.alias("close"))


# --- expressions -----------------------------------------------------------------------

_TOKENS = "t AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS token FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark UNION ALL SELECT body FROM logs)), tokens AS (SELECT token FROM t WHERE token <> '')"


@query(s.with_logs(f"SELECT token, {s.classify('token')} AS class FROM tokens", _TOKENS))
def token_classes(spark: SparkSession, d: str) -> DataFrame:
    text = [spark.read.parquet(f"{d}/{t}.parquet").select("text") for t in ("conversations", "benchmark")] + [logs(spark, d).select(F.col("body").alias("text"))]
    tokens = text[0].union(text[1]).union(text[2]).select(F.explode(masking.words_of(F.col("text"))).alias("token")).distinct()
    return tokens.withColumn("class", masking.classify_expr(F.col("token")))


@query(s.with_logs(f"SELECT template, {s.unsigned_hash('template')}::VARCHAR AS template_id FROM (SELECT DISTINCT template FROM logs)"))
def template_hashes(spark: SparkSession, d: str) -> DataFrame:
    texts = shapes.with_text(logs(spark, d)).select("template").distinct()
    return texts.withColumn("template_id", hashing.unsigned(hashing.shape_hash(F.col("template"))).cast("string"))


@query(s.with_logs(f"SELECT id, {s.sample('id')} % 100 < 10 AS selected, severity >= 17 OR {s.sample('id')} % 100 < 10 AS sent FROM logs"))
def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).select(hex_("event_id", "id"), hashing.selected(F.col("event_id"), 10).alias("selected"), rollup.sent_live(10).alias("sent"))


@query(s.with_logs(f"SELECT user_id, {s.unsigned_hash(chr(39) + 'txn-' + chr(39) + ' || user_id')} % 10000 < 2500 AS kept FROM (SELECT DISTINCT user_id FROM logs)"))
def transaction_sample(spark: SparkSession, d: str) -> DataFrame:
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    return users.withColumn("kept", hashing.transaction_kept(F.concat(F.lit("txn-"), "user_id"), 0.25))


@query(
    "SELECT word, CASE WHEN lower(trim(word)) IN ('trace','trc','verbose') THEN 1 WHEN lower(trim(word)) IN ('debug','dbg') THEN 5 WHEN lower(trim(word)) IN ('info','inf','information','notice') THEN 9 WHEN lower(trim(word)) IN ('warn','warning','wrn') THEN 13 WHEN lower(trim(word)) IN ('error','err','severe') THEN 17 WHEN lower(trim(word)) IN ('fatal','critical','crit','panic','emergency','alert') THEN 21 END::SMALLINT AS severity FROM (SELECT DISTINCT upper(event_type) AS word FROM events UNION SELECT ' Severe ' UNION SELECT 'notice' UNION SELECT 'crit' UNION SELECT 'loud')"
)
def severity_words(spark: SparkSession, d: str) -> DataFrame:
    words = spark.read.parquet(f"{d}/events.parquet").select(F.upper("event_type").alias("word")).distinct()
    words = words.union(spark.range(1).select(F.explode(F.array(*map(F.lit, [" Severe ", "notice", "crit", "loud"])))))
    return words.withColumn("severity", severity.from_text(F.col("word")))


@query("SELECT n, CASE WHEN n <= 8 THEN 'debug' WHEN n <= 12 THEN 'info' ELSE 'warn_plus' END AS class, CASE WHEN n >= 13 THEN 'warn_plus' WHEN n >= 9 THEN 'info' ELSE 'debug' END AS bucket, CASE WHEN n <= 8 THEN 'debug' WHEN n <= 12 THEN 'info' WHEN n <= 16 THEN 'warning' WHEN n <= 20 THEN 'error' ELSE 'fatal' END AS vendor FROM (SELECT unnest(range(0, 256)) AS n)")
def severity_classes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return spark.range(256).select(F.col("id").alias("n")).select("n", severity.level_class(n).alias("class"), severity.bucket_for(n).alias("bucket"), severity.vendor_level(n).alias("vendor"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H') AS hour, epoch_us(ts) // 3600000000 AS epoch_hour, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN '.' || printf('%03d', epoch_us(ts) % 1000000 // 1000) ELSE '.' || printf('%06d', epoch_us(ts) % 1000000) END || 'Z' AS canonical, epoch_us(ts) * 1000 AS back FROM events")
def clock_forms(spark: SparkSession, d: str) -> DataFrame:
    ns = times.ns_of_naive(F.col("ts"))
    out = spark.read.parquet(f"{d}/events.parquet").select("event_id", times.format_hour(ns).alias("hour"), times.format_canonical(ns).alias("canonical"))
    return out.withColumn("epoch_hour", times.parse_hour(F.col("hour"))).withColumn("back", times.canonical_ns(F.col("canonical")))


@query(s.with_logs("SELECT id, [user_id::DOUBLE, value] AS numbers FROM logs"))
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).select(hex_("event_id", "id"), masking.numbers_expr(F.col("body")).alias("numbers"))


@query("SELECT event_id, event_type AS kind, 'svc a' AS service, '' AS flag FROM events")
def query_strings(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    pairs = e.select("event_id", lines.query_pairs(F.concat(F.lit("kind="), "event_type", F.lit("&service=svc+%61&&flag"))).alias("q"))
    return pairs.select("event_id", F.col("q")[0]["value"].alias("kind"), F.col("q")[1]["value"].alias("service"), F.col("q")[2]["value"].alias("flag"))


@query(
    s.with_logs(
        "SELECT DISTINCT path, 'default' AS tenant, 'main' AS index_, hour, level, 'n0' AS node FROM (SELECT 'tenant=default/index=main/hour=' || hour || '/level=' || level || '/node=n0/f.parquet' AS path, hour, level FROM logs)"
    )
)
def path_keys(spark: SparkSession, d: str) -> DataFrame:
    paths = stored(spark, d).select(F.concat(policy.path_of(), F.lit("/f.parquet")).alias("path")).distinct()
    got = paths.withColumn("k", policy.key_of_path(F.col("path")))
    return got.select("path", "k.tenant", F.col("k.index").alias("index_"), "k.hour", "k.level", "k.node")


# --- dictionary ------------------------------------------------------------------------

_SEEN = "seen AS (SELECT template_id, template, service, count(*) AS rows, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM l GROUP BY ALL)"


def _dictionary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = labelled(spark, d).withColumn("lineage_id", F.col("template_id"))
    return dictionary.sightings(rows), dictionary.shapes(rows, ["observed_ns", "event_id"])


@query(ids_sql("SELECT template_id, service, rows, first_ns, last_ns FROM seen", _SEEN))
def template_sightings(spark: SparkSession, d: str) -> DataFrame:
    return _dictionary(spark, d)[0].drop("tenant", "index")


@query(ids_sql("SELECT template_id, template AS text, service, rows AS count, first_ns, last_ns, template_id AS lineage_id FROM seen", _SEEN))
def template_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.dictionary(*_dictionary(spark, d)).drop("tenant", "index")


@query("SELECT 'default' AS tenant, 'main' AS index_")
def dictionary_scopes(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.scopes(dictionary.dictionary(*_dictionary(spark, d))).withColumnRenamed("index", "index_")


@query(ids_sql("SELECT template_id, template_id AS lineage_id, template AS text, sum(rows)::BIGINT AS count, min(first_ns) AS first_ns, max(last_ns) AS last_ns FROM seen GROUP BY ALL", _SEEN))
def shape_history(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.shape_history(*_dictionary(spark, d)).drop("tenant", "index")


@query(ids_sql("SELECT template_id, service, count(*) AS rows, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM l GROUP BY ALL"))
def merged_dictionary(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    parts = [dictionary.sightings(rows.where(F.col("origin") == f"node-{i}")) for i in range(3)]
    return dictionary.merged_sightings(*parts).drop("tenant", "index")


@query(ids_sql("SELECT template AS text, service, count(*) AS n FROM l GROUP BY ALL"))
def named_logs(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    named = dictionary.named(rows.drop("template"), dictionary.dictionary(*_dictionary(spark, d)))
    return named.groupBy("text", "service").agg(F.count("*").alias("n"))


@query(ids_sql("SELECT template_id AS lineage_id, count(*) AS n FROM l GROUP BY ALL"))
def fold_by_lineage(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.by_lineage(labelled(spark, d), dictionary.shape_history(*_dictionary(spark, d)))


@query(ids_sql("SELECT CASE WHEN event_type <> 'view' THEN template_id END AS template_id, count(*) AS n FROM l GROUP BY ALL"))
def rekeyed(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).drop("template_id").withColumn("template_id", F.crc32("template"))
    counters = rows.select("template").distinct().where("template not like 'view%'").select(F.crc32("template").alias("counter"), hashing.shape_hash(F.col("template")).alias("template_id"))
    return dictionary.rekeyed(rows, counters).groupBy("template_id").agg(F.count("*").alias("n"))


@query(ids_sql("SELECT (SELECT count(DISTINCT template) FROM l WHERE event_type IN ('view', 'click')) AS new, 0::BIGINT AS widened, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS events_on_changed, count(*) AS events FROM l"))
def release_churn(spark: SparkSession, d: str) -> DataFrame:
    per = labelled(spark, d).groupBy("template", "template_id").agg(F.count("*").alias("n")).withColumn("lineage_id", F.col("template_id"))
    return dictionary.churn(per.where("template not like 'view%' and template not like 'click%'"), per)


# --- sampling and rollups --------------------------------------------------------------

_SENT = f"severity >= 17 OR {s.sample('id')} % 100 < 10"
_ROLL = f"rolls AS (SELECT ts_ns // 1000000 // 60000 * 60000 AS minute_ms, service, template_id, CASE WHEN severity <= 8 THEN 'debug' WHEN severity <= 12 THEN 'info' ELSE 'warn_plus' END AS class, count(*) AS count, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, max(severity) AS max_severity FROM l WHERE NOT ({_SENT}) GROUP BY ALL)"


@query(ids_sql("SELECT * FROM rolls", _ROLL))
def minute_rollups(spark: SparkSession, d: str) -> DataFrame:
    return rollup.minute_rollups(labelled(spark, d).where(~rollup.sent_live(10)))


_LE = "list_reduce(list_transform(range(0, 8), lambda i: substr(printf('%016x', {0}), (15 - 2 * i)::BIGINT, 2)), lambda a, b: a || b)"


@query(
    ids_sql(
        "SELECT substr(sha256(unhex(hex(encode('edge-1')) || "
        + _LE.format("minute_ms")
        + " || hex(encode(coalesce(service, ''))) || "
        + _LE.format("template_id")
        + " || hex(encode(class)))), 1, 32) AS id, minute_ms * 1000000 AS ts_ns, max_severity AS severity, count || ' similar records were left out of sync (' || class || ')' AS body, service, template_id FROM rolls",
        _ROLL,
    )
)
def rollup_records(spark: SparkSession, d: str) -> DataFrame:
    rows = rollup.rollup_records(rollup.minute_rollups(labelled(spark, d).where(~rollup.sent_live(10))), "edge-1")
    return rows.select(hex_("event_id", "id"), F.col("timestamp_ns").alias("ts_ns"), "severity", "body", "service", "template_id")


@query(ids_sql("SELECT template_id, count(*) AS total FROM l GROUP BY ALL"))
def shape_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    return rollup.shape_totals(rows.where(rollup.sent_live(10)), rollup.minute_rollups(rows.where(~rollup.sent_live(10))), F.lit(False))


@query(s.with_logs("SELECT service, template, count(*) AS count, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, arg_min(body, ts_ns) AS example FROM logs GROUP BY ALL"))
def vendor_rollups(spark: SparkSession, d: str) -> DataFrame:
    return rollup.vendor_rollups(shapes.with_text(logs(spark, d)))


@query(s.with_logs(f"SELECT sum(octet_length(encode(body)))::BIGINT AS seen, sum(octet_length(encode(body))) FILTER (WHERE {_SENT})::BIGINT AS sent, sum(octet_length(encode(body))) FILTER (WHERE NOT ({_SENT}))::BIGINT AS avoided FROM logs"))
def bytes_avoided(spark: SparkSession, d: str) -> DataFrame:
    return rollup.bytes_avoided(logs(spark, d), rollup.sent_live(10))


# --- joins -----------------------------------------------------------------------------


@query(s.with_logs("SELECT tier, count(*) AS n, sum(k)::BIGINT AS k FROM logs JOIN (VALUES ('low', 0.0, 10.0), ('mid', 10.0, 30.0), ('high', 30.0, 1e9)) t(tier, lo, hi) ON value >= lo AND value < hi GROUP BY tier"))
def range_join(spark: SparkSession, d: str) -> DataFrame:
    tiers = spark.createDataFrame([("low", 0.0, 10.0), ("mid", 10.0, 30.0), ("high", 30.0, 1e9)], "tier string, lo double, hi double")
    rows = logs(spark, d).select(F.get("attributes", 0)["value"]["I64"].alias("k"), F.get("attributes", 1)["value"]["F64"].alias("value"))
    return rows.join(F.broadcast(tiers), (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))).groupBy("tier").agg(F.count("*").alias("n"), F.sum("k").alias("k"))  # three rows


@query(s.with_logs("SELECT l.service, count(*) AS n, count(i.service) AS during FROM logs l LEFT JOIN (SELECT service, hour FROM logs WHERE severity >= 17 GROUP BY ALL HAVING count(*) > 1) i ON l.service = i.service AND l.hour = i.hour GROUP BY ALL"))
def incident_join(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(spark, d)
    bad = rows.where("severity >= 17 and service is not null").groupBy("service", "hour").agg(F.count("*").alias("c")).where("c > 1").select(F.col("service").alias("is"), F.col("hour").alias("ih"))
    return rows.join(bad, (F.col("service") == F.col("is")) & (F.col("hour") == F.col("ih")), "left").groupBy("service").agg(F.count("*").alias("n"), F.count("is").alias("during"))


@query(s.with_logs("SELECT id, 'fetch' AS side FROM logs WHERE seq % 3 = 1 AND seq % 5 <> 0 UNION ALL SELECT id, 'only_here' FROM logs WHERE seq % 5 = 0 AND seq % 3 <> 1"))
def replica_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.lpad(F.lower(F.hex("event_id")), 32, "0").alias("id"))
    return catalog.difference(rows.where("seq % 5 = 0"), rows.where("seq % 3 = 1"), ["id"])


@query(s.with_logs("SELECT seq AS uuid FROM logs WHERE seq % 4 <> 0"))
def not_merged(spark: SparkSession, d: str) -> DataFrame:
    seq = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("uuid"))
    return catalog.not_merged(seq, seq.where("uuid % 4 = 0"))


@query(s.with_logs("SELECT id, origin FROM (SELECT id, 'a' AS origin FROM logs UNION ALL SELECT id, 'b' FROM logs WHERE seq % 2 = 0) WHERE NOT id LIKE '%f' QUALIFY row_number() OVER (PARTITION BY id ORDER BY origin) = 1"))
def event_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    low = F.conv(F.hex(F.substring("event_id", 16, 1)), 16, 10).cast("int")
    both = rows.withColumn("origin", F.lit("a")).union(rows.where(low % 2 == 0).withColumn("origin", F.lit("b")))
    return context.dedupe_events(both, rows.where(low % 16 == 15)).select(hex_("event_id", "id"), "origin")


_PAIRS = "x AS (SELECT template, n, row_number() OVER (ORDER BY n DESC, template) AS r, list_distinct(list_filter(string_split_regex(lower(template), '[^a-z0-9_<>]+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$'))) AS w FROM (SELECT template, count(*) AS n FROM logs GROUP BY template))"


@query(s.with_logs("SELECT a.r::INTEGER AS i, b.r::INTEGER AS j, a.template AS a, b.template AS b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS jaccard FROM x a JOIN x b ON a.r < b.r WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.1 ORDER BY jaccard DESC, i, j LIMIT 60", _PAIRS))
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return suggestions.candidate_pairs(shapes.with_text(logs(spark, d)).groupBy("template").agg(F.count("*").alias("n")))


# --- context ---------------------------------------------------------------------------

_KEY = "k AS (SELECT *, coalesce(trace, '/' || coalesce(service, '')) AS key_, CASE WHEN trace IS NULL THEN 'service' ELSE 'trace' END AS tier FROM logs)"


@query(s.with_logs("SELECT tier AS key_tier, key_ AS key, count(*) AS n FROM k GROUP BY ALL", _KEY))
def correlation_keys(spark: SparkSession, d: str) -> DataFrame:
    return context.correlation_key(logs(spark, d)).groupBy("key_tier", "key").agg(F.count("*").alias("n"))


@query(
    s.with_logs(
        f"SELECT e.id AS error, c.id AS line FROM k e JOIN k c ON e.tier = c.tier AND e.key_ = c.key_ AND c.ts_ns >= e.ts_ns - {1800 * NS} AND (c.ts_ns < e.ts_ns OR c.ts_ns = e.ts_ns AND c.id < e.id) AND NOT (c.body = e.body AND c.ts_ns = e.ts_ns) WHERE e.severity >= 17 QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY c.ts_ns DESC, c.id DESC) <= 5",
        _KEY,
    )
)
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = context.context_lines(logs(spark, d), age_ns=1800 * NS, lines=5)
    return rows.select(hex_("event_id", "error"), hex_("l_id", "line"))


#: Budgets small enough that the storm meets both.
_LIMITS = {"ceiling": 4, "per_shape": 2}
_WINDOWS = f.windows(1800 * NS, **_LIMITS)


def _captured(spark: SparkSession, d: str) -> DataFrame:
    return context.captured(context.windows(stormy(spark, d), age_ns=1800 * NS), **_LIMITS)


@query(f.storm_sql("SELECT id, status, suppressed, lines::INTEGER AS lines, 'trace' AS key_tier FROM told", *_WINDOWS))
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    return _captured(spark, d).select(hex_("event_id", "id"), "status", "suppressed", F.size("context").alias("lines"), "key_tier")


@query(
    s.with_logs(
        f"SELECT l.id, 'lookback:rate' AS supplement, min(t.ts_ns) AS at_ns FROM logs l JOIN logs t ON l.service IS NOT DISTINCT FROM t.service AND t.severity >= 17 AND l.ts_ns < t.ts_ns AND l.ts_ns >= t.ts_ns - {60 * NS} WHERE l.severity < 9 GROUP BY l.id"
    )
)
def lead_up(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    told = rows.where("severity >= 17").select("service", F.lit("rate").alias("kind"), F.col("observed_ns").alias("at_ns"))
    return context.lead_up(rows.where("severity < 9"), told).select(hex_("event_id", "id"), "supplement", "at_ns")


_SECS = "ts_ns::DOUBLE / 1000000000::DOUBLE"
_FLOW = f.hex16(s.shape_hash("path"))


@query(
    f.storm_sql(
        f"SELECT id, repeat('0', 16) || lower(lpad(hex(xor((('0x' || {_FLOW})::UBIGINT), ts_ns::UBIGINT)), 16, '0')) AS event, true AS sized, {_SECS} AS at, 'error' AS level, 'tidelog:t:' || {f.hex16('template_id')} AS mark, body, service, 'trace' AS key_tier, {_FLOW} AS flow, lines AS context_lines, suppressed AS collapsed, bodies AS crumbs FROM told WHERE status = 'window'",
        *_WINDOWS,
    )
)
def issue_events(spark: SparkSession, d: str) -> DataFrame:
    """What an issue tracker reads from the envelopes."""
    sent = forward.issue_envelopes(_captured(spark, d).where("status = 'window'")).withColumn("p", F.split("envelope", "\n"))
    schema = "event_id string, timestamp double, level string, fingerprint array<string>, message struct<formatted: string>, tags map<string,string>, breadcrumbs struct<values: array<struct<message: string>>>, extra struct<context_lines: bigint, collapsed: bigint>"
    got = sent.withColumn("e", F.from_json(F.col("p")[2], schema))
    sized = (F.get_json_object(F.col("p")[1], "$.length").cast("int") == F.octet_length(F.col("p")[2])) & (F.get_json_object(F.col("p")[0], "$.event_id") == F.col("e.event_id"))
    crumbs = F.array_join(F.transform("e.breadcrumbs.values", lambda c: c["message"]), "/")
    return got.select(
        hex_("event_id", "id"), F.col("e.event_id").alias("event"), sized.alias("sized"), F.col("e.timestamp").alias("at"), F.col("e.level").alias("level"), F.col("e.fingerprint")[0].alias("mark"), F.col("e.message.formatted").alias("body"),
        F.col("e.tags")["service"].alias("service"), F.col("e.tags")["tidelog.key_tier"].alias("key_tier"), F.col("e.tags")["tidelog.flow_hash"].alias("flow"), F.col("e.extra.context_lines").alias("context_lines"), F.col("e.extra.collapsed").alias("collapsed"), crumbs.alias("crumbs"),
    )


@query(f.storm_sql(f"SELECT id, {_SECS} AS at, 'tidelog:error' AS sourcetype, body, severity::INTEGER AS severity, service, template_id, 'trace' AS key_tier, {_FLOW} AS flow, suppressed AS collapsed, lines AS context_lines, bodies AS context FROM told WHERE status = 'window'", *_WINDOWS))
def collector_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What a collector reads from the payloads."""
    sent = forward.collector_events(_captured(spark, d).where("status = 'window'"))
    event = "body: string, severity: int, service: string, template_id: bigint, key_tier: string, flow_hash: string, collapsed: bigint, context_lines: bigint, context: array<struct<body: string>>"
    got = sent.select("event_id", F.from_json("payload", f"time double, sourcetype string, event struct<{event}>").alias("e"))
    return got.select(
        hex_("event_id", "id"), F.col("e.time").alias("at"), F.col("e.sourcetype").alias("sourcetype"), "e.event.body", "e.event.severity", "e.event.service", "e.event.template_id", "e.event.key_tier", F.col("e.event.flow_hash").alias("flow"),
        "e.event.collapsed", "e.event.context_lines", F.array_join(F.transform("e.event.context", lambda c: c["body"]), "/").alias("context"),
    )


@query(s.with_logs("SELECT id, CASE WHEN seq % 3 = 0 THEN true WHEN seq % 10 >= 8 THEN true ELSE false END AS loop FROM logs"))
def loop_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    low = F.conv(F.hex(F.substring("event_id", 9, 8)), 16, 10).cast("long")
    a = F.concat("attributes", F.array(records.attr("tidelog.origin", "Str", F.col("origin")), records.attr("tidelog.hops", "I64", low % 10)))
    return rows.select(hex_("event_id", "id"), context.is_loop(a, "node-0").alias("loop"))


# --- findings --------------------------------------------------------------------------

_BUCKET = f"ts_ns // {signals.BUCKET_NS}"


@query(s.with_logs(f"SELECT service, {_BUCKET} AS bucket, count(*) AS total, count(*) FILTER (WHERE severity >= 17) AS errors, count(*) FILTER (WHERE severity >= 13) AS warns FROM logs GROUP BY ALL"))
def service_buckets(spark: SparkSession, d: str) -> DataFrame:
    return signals.service_counts(logs(spark, d))


@query(ids_sql(f"SELECT service, template_id, {_BUCKET} AS bucket, count(*) AS n, max(severity) AS worst FROM l GROUP BY ALL"))
def template_buckets(spark: SparkSession, d: str) -> DataFrame:
    return signals.template_counts(labelled(spark, d))


@query(ids_sql(f"SELECT service, template_id, slot, bucket, sum(v) AS total, count(*) AS n FROM (SELECT service, template_id, unnest([0, 1]) AS slot, {_BUCKET} AS bucket, unnest([user_id::DOUBLE, value]) AS v FROM l) GROUP BY ALL"))
def slot_buckets(spark: SparkSession, d: str) -> DataFrame:
    return signals.slot_sums(labelled(spark, d))


_START = "st AS (SELECT min(ts_ns) AS t0 FROM logs)"


@query(
    ids_sql(
        f"""SELECT service, template_id, ts_ns AS at_ns, 'novel' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts_ns, id) AS r FROM l), st WHERE r = 1 AND ts_ns >= t0 + {signals.LEARN_NS}
UNION ALL SELECT service, template_id, ts_ns, 'new_pair' FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts_ns, id) AS r, row_number() OVER (PARTITION BY template_id, service ORDER BY ts_ns, id) AS p FROM l), st WHERE p = 1 AND r > 1 AND ts_ns >= t0 + {signals.LEARN_NS}
UNION ALL SELECT service, template_id, ts_ns, 'flow' FROM (SELECT *, row_number() OVER (PARTITION BY service, previous, template_id ORDER BY ts_ns, id) AS f FROM (SELECT *, lag(template_id) OVER (PARTITION BY trace ORDER BY ts_ns, id) AS previous, row_number() OVER (PARTITION BY template_id ORDER BY ts_ns, id) AS r FROM l WHERE trace IS NOT NULL) WHERE previous <> template_id), st, (SELECT template_id AS t, arg_min(id, (ts_ns, id)) AS first_id FROM l GROUP BY ALL) WHERE t = template_id AND f = 1 AND id <> first_id AND ts_ns >= t0 + {signals.LEARN_NS}""",
        _START,
    )
)
def first_findings(spark: SparkSession, d: str) -> DataFrame:
    return signals.first_findings(labelled(spark, d)).select("service", "template_id", F.col("observed_ns").alias("at_ns"), "kind")


@query(f.storm_sql("SELECT * FROM bf", *f.findings()))
def bucket_findings(spark: SparkSession, d: str) -> DataFrame:
    return signals.bucket_findings(stormy(spark, d))


_PLAN = f.planned(signals.LEARN_NS, 10)


@query(f.storm_sql("SELECT service, sent, count(*) AS n FROM pl GROUP BY ALL", *_PLAN))
def planner_sent(spark: SparkSession, d: str) -> DataFrame:
    rows = stormy(spark, d)
    told = planner.triggers(signals.findings(rows))
    return planner.plan(rows, told, 10).groupBy("service", "sent").agg(F.count("*").alias("n"))


@query(f.storm_sql("SELECT id, at_ns, supplement FROM su", *_PLAN))
def planner_supplements(spark: SparkSession, d: str) -> DataFrame:
    rows = stormy(spark, d)
    told = planner.triggers(signals.findings(rows))
    return planner.supplements(planner.plan(rows, told, 10), told).select(hex_("event_id", "id"), "at_ns", "supplement")


@query(
    f.storm_sql(
        "SELECT tr.told AS ts_ns, 13::SMALLINT AS severity, 'anomaly (' || kind || '): ' || detail AS body, service, kind, coalesce(n, 0) AS lookback FROM tr LEFT JOIN (SELECT at_ns, supplement, count(*) AS n FROM su GROUP BY ALL) u ON u.at_ns = tr.told AND u.supplement = 'lookback:' || kind WHERE said",
        *_PLAN,
    )
)
def anomaly_markers(spark: SparkSession, d: str) -> DataFrame:
    rows = stormy(spark, d)
    told = planner.triggers(signals.findings(rows))
    out = planner.markers(told, planner.supplements(planner.plan(rows, told, 10), told))
    a = F.col("attributes")
    return out.select(F.col("timestamp_ns").alias("ts_ns"), "severity", "body", "service", records.first_value(a, "tidelog.anomaly.kind", "Str").alias("kind"), records.first_value(a, "tidelog.anomaly.lookback", "I64").cast("long").alias("lookback"))


# --- mining ----------------------------------------------------------------------------


@query(ids_sql("SELECT service, template_id, template, count(*) AS n, 1::BIGINT AS fresh FROM l GROUP BY ALL"))
def mined_templates(spark: SparkSession, d: str) -> DataFrame:
    rows = mining.mine_templates(logs(spark, d).drop("template_id"), ["service"], ["observed_ns", "event_id"])
    return rows.groupBy("service", "template_id", "template").agg(F.count("*").alias("n"), F.count_if("is_new").alias("fresh"))


@query(s.with_logs("SELECT id, [user_id::VARCHAR, value || 'ms'] AS params FROM logs"))
def mined_params(spark: SparkSession, d: str) -> DataFrame:
    rows = mining.mine_templates(logs(spark, d).drop("template_id"), [], ["observed_ns", "event_id"])
    return rows.select(hex_("event_id", "id"), "params")


_WIDE = "'the nightly backup of volume <*> finished without errors on every node'"
_MINED = f"""v AS (SELECT service, arg_min(volume, (ts_ns, id)) AS first, replace({_WIDE}, '<*>', arg_min(volume, (ts_ns, id))) AS narrow FROM lines WHERE f = 4 GROUP BY service),
  x AS (SELECT service, min((ts_ns, id)) AS widened FROM lines JOIN v USING (service) WHERE f = 4 AND volume <> first GROUP BY service),
  m AS (SELECT id, service, ts_ns, f, coalesce(template, narrow) AS born, CASE WHEN f <> 4 THEN template WHEN (ts_ns, id) < widened THEN narrow ELSE {_WIDE} END AS template, CASE WHEN f = 4 AND (ts_ns, id) >= widened THEN [volume] ELSE params END AS params FROM lines LEFT JOIN v USING (service) LEFT JOIN x USING (service)),
  h AS (SELECT t, {s.shape_hash('t')} AS hash FROM (SELECT DISTINCT unnest([born, template]) AS t FROM m))"""


@query(f"WITH {views.LINES}, {_MINED} SELECT id, a.hash AS template_id, template, b.hash AS lineage_id, row_number() OVER (PARTITION BY service, f ORDER BY ts_ns, id) = 1 AS is_new, params FROM m JOIN h a ON template = a.t JOIN h b ON born = b.t")
def mined_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of eight forms, one of which widens, as after each line."""
    mined = mining.mine_templates(views.mixed_lines(spark, d), ["service"], ["observed_ns", "event_id"])
    return mined.select(hex_("event_id", "id"), "template_id", "template", "lineage_id", "is_new", "params")


@query(f"WITH {views.LINES}, {_MINED} SELECT id, CASE WHEN f = 4 AND volume_ = first THEN narrow WHEN f = 4 THEN {_WIDE} ELSE template END AS template FROM (SELECT m.*, first, narrow, lines.volume AS volume_ FROM m JOIN lines USING (id) LEFT JOIN v ON v.service = m.service)")
def mined_at_first(spark: SparkSession, d: str) -> DataFrame:
    """The quick form: each masked line keeps what it got at its first arrival."""
    mined = mining.mine_templates(views.mixed_lines(spark, d), ["service"], ["observed_ns", "event_id"], exact=False)
    return mined.select(hex_("event_id", "id"), "template")


_UNITS = ", ".join(f"'{u}'" for u in sorted(masking.UNITS))
_FREE = f"""a AS (SELECT conv_id, turn, role, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS x FROM conversations)),
  b AS (SELECT *, CASE WHEN regexp_replace(w, '[,;.)\\]}}:]+$', '') = '' THEN w ELSE regexp_replace(w, '[,;.)\\]}}:]+$', '') END AS core FROM a),
  c AS (SELECT *, substr(w, length(core) + 1) AS tail, CASE WHEN instr(core, '=') > 1 AND instr(core, '=') < length(core) AND NOT regexp_matches(substr(core, 1, instr(core, '=') - 1), '[0-9"]') THEN instr(core, '=') ELSE 0 END AS eq FROM b),
  e AS (SELECT *, {s.classify('v')} AS class FROM (SELECT *, substr(core, eq + 1) AS v FROM c)),
  g AS (SELECT conv_id, turn, role, i, CASE WHEN i <= 2 AND regexp_matches(w, '^\\[[A-Za-z0-9._:/-]+\\]$') AND NOT regexp_matches(lower(w), '^.({'|'.join(sorted(severity.ALL_WORDS))}).$') THEN '<COMP>' WHEN class = '' THEN w ELSE substr(core, 1, eq) || class || tail END AS m, regexp_replace(w, '[^A-Za-z0-9]+$', '') IN ({_UNITS}) AS unit FROM e),
  h AS (SELECT conv_id, turn, role, list_reduce(list({{'m': m, 'unit': unit, 'out': [m]}} ORDER BY i), lambda a, y: CASE WHEN y.unit AND regexp_matches(a.out[-1], '<.*>') THEN a ELSE {{'m': y.m, 'unit': y.unit, 'out': list_append(a.out, y.m)}} END).out AS out FROM g GROUP BY ALL),
  k AS (SELECT *, array_to_string(out, ' ') AS template FROM h), ids AS (SELECT template, {s.shape_hash('template')} AS template_id FROM (SELECT DISTINCT template FROM k))"""


@query(f"WITH {_FREE} SELECT conv_id, turn, template_id, template, row_number() OVER (PARTITION BY role, template ORDER BY conv_id, turn) = 1 AS is_new FROM k JOIN ids USING (template) UNION ALL SELECT conv_id, turn, NULL, NULL, false FROM conversations WHERE trim(coalesce(text, '')) = ''")
def mined_texts(spark: SparkSession, d: str) -> DataFrame:
    """Templates of free text: the turns of conversations, mined in order. Nearly every text is
    a template of its own, so there is no cap. The SQL counts on texts that are too unlike to
    join one another and hold no asides."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", F.col("text").alias("body"))
    return mining.mine_templates(turns, ["role"], ["conv_id", "turn"], config=mining.MinerConfig(max_templates=None)).select("conv_id", "turn", "template_id", "template", "is_new")


# --- typed columns ---------------------------------------------------------------------


@query(
    s.with_logs(
        "SELECT coalesce(service, '') AS service, key, count(*) AS present, count(*) FILTER (WHERE kind = 'i') AS ints, count(*) FILTER (WHERE kind = 'f') AS floats, 0::BIGINT AS bools, 0::BIGINT AS timestamps, count(*) FILTER (WHERE kind = 's') AS strings, coalesce(sum(bytes), 0)::BIGINT AS string_bytes, any_value(n) AS rows, any_value(n) AS sampled FROM (SELECT service, unnest(['k', 'latency_ms', 'event']) AS key, unnest(['i', 'f', 's']) AS kind, unnest([0, 0, octet_length(encode(event_type))]) AS bytes, n FROM (SELECT *, count(*) OVER (PARTITION BY service) AS n FROM logs)) GROUP BY ALL"
    )
)
def key_statistics(spark: SparkSession, d: str) -> DataFrame:
    return typed.key_statistics(logs(spark, d))


@query("SELECT * FROM (VALUES ('attr_event', 'event', 'string'), ('attr_k', 'k', 'int64'), ('attr_latency_ms', 'latency_ms', 'float64')) t(column_, key, type)")
def typed_plan(spark: SparkSession, d: str) -> DataFrame:
    found = typed.plan(logs(spark, d))
    return spark.createDataFrame([(c.column, c.key, c.type) for c in found], "column_ string, key string, type string")


@query(s.with_logs("SELECT id, k, value AS latency_ms, event_type AS event FROM logs WHERE value > 50"))
def typed_predicate(spark: SparkSession, d: str) -> DataFrame:
    columns = [typed.TypedColumn("attr_event", "event", "string", ""), typed.TypedColumn("attr_k", "k", "int64", ""), typed.TypedColumn("attr_latency_ms", "latency_ms", "float64", "")]
    rows = typed.encode(logs(spark, d), columns).where("attr_latency_ms > 50")
    return rows.select(hex_("event_id", "id"), F.col("attr_k").alias("k"), F.col("attr_latency_ms").alias("latency_ms"), F.col("attr_event").alias("event"))


@query(s.with_logs("SELECT id, 3 AS n, k FROM logs"))
def typed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    columns = [typed.TypedColumn("attr_k", "k", "int64", ""), typed.TypedColumn("attr_latency_ms", "latency_ms", "float64", "")]
    rows = typed.decode(typed.encode(logs(spark, d), columns), columns)
    return rows.select(hex_("event_id", "id"), F.size("attributes").alias("n"), records.first_value(F.col("attributes"), "k", "I64").cast("long").alias("k"))


# --- files and policy ------------------------------------------------------------------

_FILES = "f AS (SELECT 'tenant=default/index=main/hour=' || hour || '/level=' || level || '/node=n0' AS path, hour, level, count(*) AS rows, count(*) * 100 AS bytes, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts, min(ts_ns) // 3600000000000 AS eh FROM logs GROUP BY hour, level, min_ts_hour)".replace(", min_ts_hour", "")
_KEEP = "CASE level WHEN 'debug' THEN 86400 WHEN 'info' THEN 604800 ELSE 2592000 END"
_VERDICT = f"CASE WHEN (eh + 1) * 3600 + {_KEEP} <= {NOW} THEN 'expired' ELSE 'kept' END"


def files(spark: SparkSession, d: str) -> DataFrame:
    return scan.file_table(stored(spark, d)).withColumn("path", policy.path_of()).withColumn("bytes", F.col("rows") * 100)


@query(s.with_logs(f"SELECT path, {_VERDICT} AS verdict FROM f", _FILES))
def retention(spark: SparkSession, d: str) -> DataFrame:
    return policy.retention(files(spark, d), NOW).select("path", "verdict")


@query(s.with_logs(f"SELECT level, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM f WHERE {_VERDICT} = 'expired' GROUP BY level", _FILES))
def retention_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return policy.per_bucket(policy.retention(files(spark, d), NOW).where("verdict = 'expired'"))


@query(s.with_logs(f"SELECT path, CASE WHEN {_VERDICT} = 'kept' THEN 'kept' WHEN level = 'info' AND hour LIKE '%T03' THEN 'pinned' ELSE 'expired' END AS verdict FROM f", _FILES))
def pinned_retention(spark: SparkSession, d: str) -> DataFrame:
    pins = files(spark, d).where("level = 'info' and hour like '%T03'").select("path")
    return policy.retention(files(spark, d), NOW, pins=pins).select("path", "verdict")


@query(s.with_logs(f"SELECT path, bytes FROM (SELECT *, sum(bytes) OVER () AS used, sum(bytes) OVER (ORDER BY {_KEEP}, min_ts, path) - bytes AS before FROM f) WHERE used - before > floor(floor(used * 0.9) * 0.7::DOUBLE)", _FILES))
def reclaim(spark: SparkSession, d: str) -> DataFrame:
    have = files(spark, d)
    used = have.agg(F.sum("bytes")).first()[0]
    return policy.reclaim(have, used, int(used * 0.9)).select("path", "bytes")


@query(
    s.with_logs(
        "SELECT level, why, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM (SELECT level, bytes, 'retention' AS why FROM v WHERE verdict = 'expired' UNION ALL SELECT level, bytes, 'reclaim' FROM (SELECT *, sum(bytes) OVER () AS used, sum(bytes) OVER (ORDER BY keep, min_ts, path) - bytes AS before FROM v WHERE verdict = 'kept') WHERE used >= 0.95 * 300000 AND used - before > 210000) GROUP BY ALL",
        _FILES,
        f"v AS (SELECT *, {_KEEP} AS keep, {_VERDICT} AS verdict FROM f)",
    )
)
def policy_impact(spark: SparkSession, d: str) -> DataFrame:
    gone = policy.impact(files(spark, d), NOW, 300_000)
    return gone.groupBy("level", "why").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query(s.with_logs(f"SELECT path FROM f WHERE {_VERDICT} = 'kept' AND (eh + 1) * 3600 + 86400 <= {NOW}", _FILES))
def policy_beyond(spark: SparkSession, d: str) -> DataFrame:
    short = tuple(severity.Bucket(b.name, b.min_severity, severity.DAY) for b in severity.DEFAULT_BUCKETS)
    have = files(spark, d)
    return policy.beyond(policy.impact(have, NOW, 0, short), policy.impact(have, NOW, 0)).select("path")


@query(s.with_logs("SELECT level, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM f WHERE level = 'debug' GROUP BY level", _FILES))
def orphan_levels(spark: SparkSession, d: str) -> DataFrame:
    return policy.orphan_levels(files(spark, d), (severity.Bucket("low", 0, 1), severity.Bucket("info", 9, 1), severity.Bucket("warn_plus", 13, 1)))


@query(s.with_logs("SELECT path FROM (SELECT path, sum(bytes) OVER (ORDER BY max_ts DESC, path DESC) AS b FROM f) WHERE b <= 50000", _FILES))
def pin_plan(spark: SparkSession, d: str) -> DataFrame:
    return policy.pins(files(spark, d), 50_000, 0).select("path")


@query(s.with_logs(f"SELECT path FROM f WHERE max_ts >= {LO} AND min_ts <= {HI} AND level IN ('info', 'warn_plus')", _FILES))
def catalog_overlap(spark: SparkSession, d: str) -> DataFrame:
    return catalog.overlapping(files(spark, d), LO, HI, severity.names_from(9)).select("path")


@query(s.with_logs("SELECT sum(rows)::BIGINT AS rows, sum(bytes)::BIGINT AS bytes FROM f", _FILES))
def store_totals(spark: SparkSession, d: str) -> DataFrame:
    return catalog.totals(files(spark, d))


_PARTS = "p AS (SELECT 'n' || (eh % 4) AS node, level || '-' || hour AS name, rows, bytes, min_ts AS min_observed, max_ts AS max_observed, CASE WHEN eh % 2 = 0 THEN 'warm' ELSE 'cold' END AS tier FROM f)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    eh = times.epoch_hour(F.col("min_ts"))
    cols = [F.concat(F.lit("n"), eh % 4).alias("node"), F.concat_ws("-", "level", "hour").alias("name"), "rows", "bytes", F.col("min_ts").alias("min_observed"), F.col("max_ts").alias("max_observed")]
    return files(spark, d).select(*cols, F.when(eh % 2 == 0, "warm").otherwise("cold").alias("tier"))


@query(s.with_logs(f"SELECT node, name FROM p WHERE tier = 'warm' AND max_observed >= {LO} AND min_observed <= {HI} ORDER BY max_observed, node, name LIMIT 40", _FILES, _PARTS))
def parts_listed(spark: SparkSession, d: str) -> DataFrame:
    return catalog.parts_list(parts(spark, d), tier="warm", from_ns=LO, to_ns=HI, limit=40).select("node", "name")


@query(s.with_logs("SELECT node, name FROM p WHERE (node, name) > ('n1', 'info') ORDER BY node, name LIMIT 25", _FILES, _PARTS))
def parts_page(spark: SparkSession, d: str) -> DataFrame:
    return catalog.page_after(parts(spark, d), ("n1", "info"), 25).select("node", "name")


@query(s.with_logs(f"SELECT node, name FROM p WHERE max_observed // 1000000 + CASE tier WHEN 'warm' THEN 604800000 ELSE 1209600000 END <= {NOW * 1000} QUALIFY row_number() OVER (PARTITION BY tier ORDER BY max_observed, node, name) <= 100", _FILES, _PARTS))
def parts_sweep(spark: SparkSession, d: str) -> DataFrame:
    return policy.sweep(parts(spark, d), NOW * 1000, 604_800, 1_209_600, 100).select("node", "name")


@query(s.with_logs("SELECT count(*) AS files, sum(bytes)::BIGINT AS bytes FROM f WHERE level = 'debug' AND hour < '2024-01-10T00'", _FILES))
def gave_up(spark: SparkSession, d: str) -> DataFrame:
    have = files(spark, d)
    return catalog.gave_up(have.where("level = 'debug'"), have.where("hour < '2024-01-10T00'"))


@query(s.with_logs("SELECT route, index_, count(*) AS n FROM (SELECT CASE WHEN service IS NULL THEN 'defaulted' WHEN service IN ('svc-1', 'svc-2') THEN 'known' ELSE 'refused' END AS route, CASE WHEN service IS NULL THEN 'main' WHEN service IN ('svc-1', 'svc-2') THEN service END AS index_ FROM logs) GROUP BY ALL"))
def index_routing(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d).withColumn("requested", F.col("service"))
    known = spark.createDataFrame([("svc-1",), ("svc-2",)], "index string")
    return catalog.routed(rows, known).groupBy("route", F.col("index").alias("index_")).agg(F.count("*").alias("n"))


@query("SELECT name, regexp_matches(name, '^[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}$') AND regexp_matches(name, '[A-Za-z]') AS valid FROM (SELECT DISTINCT unnest([url, 'page-' || page_id, '.hidden', page_id::VARCHAR]) AS name FROM pages)")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet")
    names = p.select(F.explode(F.array("url", F.concat(F.lit("page-"), "page_id"), F.lit(".hidden"), F.col("page_id").cast("string"))).alias("name")).distinct()
    return names.withColumn("valid", policy.valid_ident(F.col("name")))


# --- receivers -------------------------------------------------------------------------

_NOW = 1_700_000_000_000_000_000


@query(s.with_logs("SELECT severity, body || ' service=' || coalesce(service, 'none') || ' trace_id=' || coalesce(trace, 'x') AS body, coalesce(service, 'none') AS service, trace, count(*) AS n FROM logs GROUP BY ALL"))
def stdin_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    head = F.when(F.col("severity") == 17, "ERROR").when(F.col("severity") == 13, "WARN").when(F.col("severity") == 5, "DEBUG").otherwise("INFO")
    text = F.concat(head, F.lit("\t"), "body", F.lit(" service="), F.coalesce("service", F.lit("none")), F.lit(" trace_id="), F.coalesce(F.lower(F.hex("trace_id")), F.lit("x")))
    got = lines.parse_lines(rows.select(text.alias("value")), _NOW)
    trace = F.when(~F.col("body").endswith("=x"), F.lower(F.hex("trace_id")))
    return got.groupBy("severity", "body", "service", trace.alias("trace")).agg(F.count("*").alias("n"))


@query(s.with_logs("SELECT id, CASE event_type WHEN 'error' THEN 17 ELSE 9 END::SMALLINT AS severity, event_type || ': ' || body AS body, 'web' AS service FROM logs"))
def raw_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    line = F.concat(F.get("attributes", 2)["value"]["Str"], F.lit(": "), "body")
    sent = rows.select(F.concat(line, F.lit(" "), F.lower(F.hex("event_id")), F.lit("\n\n")).alias("value"), F.lit("sourcetype=web&host=h%2F1").alias("q"))
    got = lines.parse_raw(sent, _NOW, query="q")
    return got.select(F.substring_index("body", " ", -1).alias("id"), "severity", F.expr("substring(body, 1, length(body) - 33)").alias("body"), "service")


@query(s.with_logs("SELECT id, ts_ns // 1000000 AS ts_ms, CASE event_type WHEN 'error' THEN 17 ELSE 9 END::SMALLINT AS severity, body, service, k FROM logs"))
def collector_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    fields = F.struct(F.get("attributes", 0)["value"]["I64"].alias("k"), F.get("attributes", 2)["value"]["Str"].alias("level"), F.lower(F.hex("event_id")).alias("id"))
    sent = rows.select(F.to_json(F.struct(F.call_function("div", F.col("timestamp_ns"), F.lit(1_000_000).cast("long")).alias("time"), F.col("service").alias("sourcetype"), F.col("body").alias("event"), fields.alias("fields"))).alias("value"))
    got = receivers.decoded(sent, lambda t: receivers.collector_events(t, _NOW))
    a = F.col("attributes")
    ms = F.call_function("div", F.col("timestamp_ns") + 500_000, F.lit(1_000_000).cast("long"))
    return got.select(records.first_value(a, "id", "Str").alias("id"), ms.alias("ts_ms"), "severity", "body", "service", records.first_value(a, "k", "I64").cast("long").alias("k"))


@query(s.with_logs("SELECT id, ts_ns, severity, body, service, trace FROM logs"))
def otlp_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    text = lambda v: F.struct(v.alias("stringValue"))
    one = F.struct(
        F.col("timestamp_ns").cast("string").alias("timeUnixNano"), F.col("severity").alias("severityNumber"), text(F.col("body")).alias("body"), F.lower(F.hex("trace_id")).alias("traceId"),
        F.array(F.struct(F.lit("id").alias("key"), text(F.lower(F.hex("event_id"))).alias("value"))).alias("attributes"),
    )
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), text(F.col("service")).alias("value"))).alias("attributes"))
    sent = rows.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(one).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))).alias("value"))
    got = receivers.decoded(sent, lambda t: receivers.otlp_json(t, _NOW))
    return got.select(records.first_value(F.col("attributes"), "id", "Str").alias("id"), F.col("timestamp_ns").alias("ts_ns"), "severity", "body", F.when(F.col("service") != "", F.col("service")).alias("service"), hex_("trace_id", "trace"))


@query(s.with_logs("SELECT id, severity, 'Failure: ' || body AS body, coalesce(service, 'sentry:7') AS service FROM logs WHERE severity >= 13"))
def envelope_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d).where("severity >= 13")
    level = F.when(F.col("severity") == 17, "error").otherwise("warning")
    event = F.to_json(F.struct(level.alias("level"), F.col("service").alias("server_name"), F.struct(F.array(F.struct(F.lit("Failure").alias("type"), F.col("body").alias("value"))).alias("values")).alias("exception")))
    body = F.concat(F.lit('{"event_id":"'), F.lower(F.hex("event_id")), F.lit('"}\n{"type":"event","length":'), F.octet_length(event), F.lit("}\n"), event, F.lit("\n"))
    got = receivers.decoded(rows.select(F.encode(body, "UTF-8").alias("value")), lambda b: receivers.envelope_records(b, _NOW, "7"))
    return got.select(records.first_value(F.col("attributes"), "sentry.event_id", "Str").alias("id"), "severity", "body", "service")


@query(s.with_logs("SELECT id, ts_ns, severity, body, service, trace, origin FROM logs"))
def peer_bodies(spark: SparkSession, d: str) -> DataFrame:
    got = receivers.peer_lines(receivers.to_peer_lines(logs(spark, d)))
    return got.select(hex_("event_id", "id"), F.col("timestamp_ns").alias("ts_ns"), "severity", "body", "service", hex_("trace_id", "trace"), "origin")


@query("SELECT category, max(until) AS until FROM (SELECT event_id + event_id % 60 AS until, CASE WHEN event_id % 3 = 0 THEN 'all' ELSE event_type END AS category FROM events) GROUP BY category")
def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    head = F.concat(F.col("event_id") % 60, F.lit(":"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise(""), F.lit(":scope"))
    return receivers.rate_limits(e.select(head.alias("h"), F.col("event_id").alias("at")), "h", "at")


# --- more of the catalog ---------------------------------------------------------------


@query(s.with_logs("SELECT DISTINCT regexp_extract(path, '^tenant=default/index=main/[^/]*/') AS key, true AS is_prefix FROM f ORDER BY key LIMIT 100", _FILES))
def object_listing(spark: SparkSession, d: str) -> DataFrame:
    return catalog.object_listing(files(spark, d), "tenant=default/index=main/", "/", most=100)


@query(s.with_logs("SELECT path FROM f WHERE level <> 'info' OR rows % 2 = 1", _FILES))
def unconfirmed_files(spark: SparkSession, d: str) -> DataFrame:
    have = files(spark, d)
    sent = have.where("level = 'info'").withColumn("bytes", F.when(F.col("rows") % 2 == 0, F.col("bytes")).otherwise(F.col("bytes") + 1))
    return catalog.unconfirmed(have, sent).select("path")


@query(s.with_logs("SELECT path FROM f WHERE level = 'debug'", _FILES))
def pending_retires(spark: SparkSession, d: str) -> DataFrame:
    have = files(spark, d)
    return catalog.pending_retires(have.where("level <> 'debug'"), have).select("path")


@query(s.with_logs("SELECT count(*) AS files, sum(rows)::BIGINT AS rows, sum(bytes)::BIGINT AS bytes, sum(bytes) / 1e6::DOUBLE AS disk_fraction FROM f", _FILES))
def node_info(spark: SparkSession, d: str) -> DataFrame:
    return catalog.node_info(files(spark, d), 1_000_000).drop("tenant", "index")


@query(s.with_logs("SELECT hour, count(*) AS n FROM logs WHERE hour LIKE '%T0%' GROUP BY hour"))
def read_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(spark, d).withColumn("index", F.substring("hour", 11, 2))
    return catalog.in_scope(rows, [("default", "T0"), ("other", None)]).groupBy("hour").agg(F.count("*").alias("n"))


@query(s.with_logs("SELECT id, severity >= 13 OR (severity >= 9 AND r <= 1) AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY ts_ns // 1000000000 ORDER BY CASE WHEN severity >= 13 THEN 0 WHEN severity >= 9 THEN 1 ELSE 2 END, ts_ns, id) AS r FROM logs)"))
def load_shedding(spark: SparkSession, d: str) -> DataFrame:
    return catalog.shed(logs(spark, d), 1, "critical").select(hex_("event_id", "id"), "admitted")


@query(
    f"SELECT event_id, CASE event_type WHEN 'error' THEN true WHEN 'purchase' THEN {s.unsigned_hash(chr(39) + 'e' + chr(39) + ' || event_id')} % 10000 < 1500 WHEN 'view' THEN false WHEN 'click' THEN true ELSE false END AS kept FROM events"
)
def envelope_policy(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "event").when(F.col("event_type") == "purchase", "transaction").when(F.col("event_type") == "view", "attachment").when(F.col("event_type") == "click", "session").otherwise("odd")
    return e.select("event_id", rollup.item_kept(kind, F.concat(F.lit("e"), "event_id"), 0.15, attachments=False).alias("kept"))


@query("SELECT event_id, 'https://h' || user_id % 3 || '.example/api/' || event_type || '/envelope/' AS url, 'k' || event_id AS key FROM events")
def upstream_targets(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import upstream

    e = spark.read.parquet(f"{d}/events.parquet")
    address = upstream.dsn(F.concat(F.lit("https://pub:secret@h"), F.col("user_id") % 3, F.lit(".example/9/")))
    auth = upstream.auth_header(F.concat(F.lit("Sentry sentry_version=7, sentry_key=k"), "event_id"))
    rows = e.withColumn("d", address).withColumn("a", auth)
    to = upstream.target("relay", F.col("a.key"), F.col("event_type"), F.col("d"), F.lit(None).cast(rows.schema["d"].dataType))
    return rows.select("event_id", to.alias("t")).select("event_id", "t.url", "t.key")


@query(s.with_logs("SELECT path FROM (SELECT path, hour, level, n, sum(bytes) OVER (PARTITION BY hour, level ORDER BY path) AS b, dense_rank() OVER (ORDER BY hour, level) AS p FROM (SELECT hour || '-' || level || '-' || id AS path, hour, level, 10 AS bytes, count(*) OVER (PARTITION BY hour, level) AS n FROM logs) WHERE n >= 4) WHERE p <= 4 AND b <= 45"))
def compaction_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(spark, d).select(*scan.PATH, F.concat_ws("-", "hour", "level", F.lower(F.hex("event_id"))).alias("path"), F.lit(10).alias("bytes"), F.lit(0).alias("written_secs"))
    return policy.compactable(rows, 10_000, small=11, target=45).select("path")


@query(s.with_logs("SELECT template, rank, n FROM (SELECT template, count(*) AS n, row_number() OVER (PARTITION BY template ORDER BY count(*) DESC) AS rank FROM logs WHERE service IS NOT NULL GROUP BY template, service) WHERE rank <= 5"))
def frequent_services(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the services that a template comes from most often."""
    top = shapes.frequent(logs(spark, d).where("service is not null"), "service", 5)
    rank = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("n")))
    return top.select("template", rank.cast("long").alias("rank"), "n")


@query(f.storm_sql("SELECT status, CASE WHEN status = 'window' THEN 'context' ELSE 'bare' END AS tracker, CASE WHEN status = 'window' THEN 'context' ELSE 'aggregate' END AS collector, count(*) AS n FROM told GROUP BY ALL", *_WINDOWS))
def dispatch_shapes(spark: SparkSession, d: str) -> DataFrame:
    return forward.shaped(_captured(spark, d)).groupBy("status", "tracker", "collector").agg(F.count("*").alias("n"))


# --- reports, pages and what a store is asked for now and then ---------------------------


@query(ids_sql("SELECT template, template_id, count(*) AS n FROM l GROUP BY ALL ORDER BY n DESC, template LIMIT 2 OFFSET 2"))
def template_at_rank(spark: SparkSession, d: str) -> DataFrame:
    counts = labelled(spark, d).groupBy("template", "template_id").agg(F.count("*").alias("n"))
    return scan.page(counts, [F.desc("n"), "template"], 2, 2)


@query(s.with_logs(f"SELECT id, ts_ns, severity, body FROM logs WHERE ts_ns >= {LO} AND ts_ns < {HI} AND severity >= 13"))
def backfill_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.backfill(stored(spark, d), LO // 1_000_000, HI // 1_000_000, 13)
    return rows.select(hex_("event_id", "id"), F.col("timestamp_ns").alias("ts_ns"), "severity", "body")


@query(
    f.storm_sql(
        f"SELECT id, status = 'window' AS whole, CASE WHEN status <> 'window' THEN status END AS reason, ts_ns AS at_ns, template_id, body, CASE WHEN status = 'window' THEN lines ELSE 0 END AS context_lines, CASE WHEN path IS NOT NULL THEN {_FLOW} END AS flow, CASE WHEN status = 'window' THEN suppressed END AS collapsed, CASE WHEN status = 'window' THEN bodies ELSE '' END AS context, service FROM told",
        *_WINDOWS,
    )
)
def pushdown_lines(spark: SparkSession, d: str) -> DataFrame:
    """What a reader finds in the lines of JSON."""
    line = "ts: bigint, severity: int, template_id: bigint, body: string"
    schema = f"error struct<{line}>, context array<struct<{line}>>, context_lines bigint, context_suppressed string, flow_hash string, collapsed bigint, service string"
    got = forward.window_lines(_captured(spark, d)).select("event_id", F.from_json("value", schema).alias("e"))
    return got.select(
        hex_("event_id", "id"), F.col("e.context_suppressed").isNull().alias("whole"), F.col("e.context_suppressed").alias("reason"), F.col("e.error.ts").alias("at_ns"), F.col("e.error.template_id").alias("template_id"), F.col("e.error.body").alias("body"),
        "e.context_lines", F.col("e.flow_hash").alias("flow"), "e.collapsed", F.array_join(F.transform("e.context", lambda c: c["body"]), "/").alias("context"), "e.service",
    )


_SPAN = "z AS (SELECT min(min_ts) AS low, max(max_ts) AS high, count(*) AS n, sum(rows) AS whole FROM f)"


@query(
    s.with_logs(
        f"SELECT window_ns, count(*) FILTER (WHERE hit) / (24.0::DOUBLE * any_value(n)) AS files_read, sum(rows) FILTER (WHERE hit) / (24.0::DOUBLE * any_value(whole)) AS rows_read FROM (SELECT window_ns, rows, n, whole, max_ts >= low + (high - low) * i // 24 AND min_ts <= low + (high - low) * i // 24 + window_ns AS hit FROM f, z, range(24) t(i), (VALUES ({s.HOUR}::BIGINT), ({24 * s.HOUR}::BIGINT)) w(window_ns)) GROUP BY window_ns",
        _FILES,
        _SPAN,
    )
)
def prune_analysis(spark: SparkSession, d: str) -> DataFrame:
    return reports.prune_analysis(files(spark, d), [s.HOUR, 24 * s.HOUR])


@query(s.with_logs("SELECT count(*) AS files, sum(rows)::BIGINT AS rows, median(c) AS median, avg(c) AS mean, max(c) AS most FROM (SELECT rows, (max_ts - min_ts) / (high - low)::DOUBLE AS c FROM f, z)", _FILES, _SPAN))
def file_coverage(spark: SparkSession, d: str) -> DataFrame:
    return reports.coverage(files(spark, d))


@query(s.with_logs("SELECT count(*) AS records, sum(octet_length(encode(body)) + 1)::BIGINT AS raw_bytes, 100000::BIGINT AS stored_bytes, sum(octet_length(encode(body)) + 1) / count(*) AS raw_per_record, 100000 / count(*) AS stored_per_record, sum(octet_length(encode(body)) + 1) / 100000 AS ratio FROM logs"))
def space_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.space(logs(spark, d), 100_000)


@query(s.with_logs("SELECT name, bytes AS size, rows FROM p WHERE node = 'n2'", _FILES, _PARTS))
def inventory_read(spark: SparkSession, d: str) -> DataFrame:
    return catalog.inventory(parts(spark, d), "n2")


@query("SELECT user_id AS channel, event_id AS ack_id, event_id * 3 <= 12000 AND event_id > max(event_id) OVER (PARTITION BY user_id) - 4000 AS acked FROM events")
def acknowledgements(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    asked = e.select(F.col("user_id").alias("channel"), F.col("event_id").alias("ack_id"), (F.col("event_id") * 3).alias("last"))
    return catalog.acknowledged(asked, 12_000, 4_000).select("channel", "ack_id", "acked")


@query(s.with_logs("SELECT substr(hour, 1, 10) AS day, count(*) AS files, sum(rows)::BIGINT AS rows FROM f GROUP BY 1", _FILES))
def day_manifests(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy(F.substring("hour", 1, 10).alias("day")).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


from . import stored as _stored  # noqa: E402, F401  registers its queries
