"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). The records of the
events table, spread over twelve hours, are mined and written once through the store, in
its own layout; the shapes that a log store is asked for then run over what was written,
the rest over the raw tables. Each time is the best of three runs after one warm-up, and
counts are checked against the raw records. `read` has, for the shapes that prune, files
and megabytes of the partitions they open, of all in the store."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import mining, scan, typed
from tidelog.plans import catalogue
from tidelog.sources import records, store

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HOUR = 3_600_000_000_000
LO = catalogue.LO
HI = LO + 12 * HOUR


def timed(run, times: int = 3) -> float:
    run()
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - began)
    return round(best, 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="tidelog-bench-")
    out: dict[str, float] = {}
    try:
        columns = [typed.TypedColumn("attr_latency_ms", "latency_ms", "float64", "")]
        raw = records.event_logs(spark, SF).drop("template_id")
        rows = raw.count()
        seq = F.conv(F.hex(F.substring("event_id", 9, 8)), 16, 10).cast("long")
        at = LO + F.pmod(seq, F.lit(rows)) * ((HI - LO) // rows)
        raw = raw.withColumn("timestamp_ns", at).withColumn("observed_ns", at)
        began = time.perf_counter()
        mined = mining.mine_templates(raw, ["service"], ["observed_ns", "event_id"]).drop("params", "is_new", "template", "lineage_id")
        path = f"{work}/store"
        store.write(mined, path, columns)
        out["mine_and_write"] = round(time.perf_counter() - began, 4)
        logs = store.read(spark, path, columns)
        if logs.count() != rows:
            raise ValueError("the store has other rows than were written")
        middle = LO + 6 * HOUR
        window = (F.col("timestamp_ns") >= middle) & (F.col("timestamp_ns") < middle + HOUR)
        in_window = scan.Query(middle, middle + HOUR)
        issues = scan.Query(middle, middle + HOUR, min_severity=13)
        service = scan.Query(service="svc-5", min_severity=13)
        trace, hint = logs.where("trace_id is not null").orderBy("timestamp_ns").select("trace_id", "timestamp_ns").first()
        near = scan.Query(hint - HOUR // 2, hint + HOUR // 2)
        template = logs.where("severity >= 17").select("template_id").first()[0]
        stored: dict[str, Callable[[], DataFrame]] = {
            "spine": lambda: logs.groupBy("service", "template_id").agg(F.count("*").alias("n")),
            "count_errors": lambda: scan.matches(logs, scan.Query(min_severity=17)).agg(F.count("*").alias("n")),
            "top_templates": lambda: logs.groupBy("template_id").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(10),
            "level_group": lambda: logs.where("level = 'warn_plus'").groupBy("service").agg(F.count("*").alias("n")),
            "window_spine": lambda: scan.matches(logs, in_window).groupBy("service", "template_id").agg(F.count("*").alias("n")),
            "window_count": lambda: scan.matches(logs, in_window).agg(F.count("*").alias("n")),
            "issue_list_hour": lambda: scan.matches(logs, issues).select("timestamp_ns", "service", "template_id", "severity"),
            "template_filter": lambda: logs.where(F.col("template_id") == template).select("timestamp_ns", "service", "body"),
            "service_warn": lambda: scan.matches(logs, service).select("timestamp_ns", "severity", "body"),
            "trace_hint": lambda: scan.matches(logs, near).where(F.col("trace_id") == F.lit(trace)).select("timestamp_ns", "body"),
            "trace_lookup": lambda: logs.where(F.col("trace_id") == F.lit(trace)).select("timestamp_ns", "body"),
            "typed_filter": lambda: logs.where("attr_latency_ms > 50").agg(F.count("*").alias("n")),
            "stored_limited": lambda: store.scan(spark, path, scan.Query(min_severity=9, limit=137), columns),
            "footer_statistics": lambda: store.footers(spark, path),
        }
        for name, build in stored.items():
            out[name] = timed(lambda build=build: build().collect())  # a frame that is collected again reuses its shuffles
        want = {"count_errors": raw.where("severity >= 17").count(), "window_count": raw.where(window).count()}
        if any(stored[k]().first()[0] != n for k, n in want.items()):
            raise ValueError("a count differs from that of the raw records")
        have = store.listing(spark, path).persist()
        size = lambda df: [round(float(x or 0), 3) for x in df.agg(F.count("*"), F.sum("bytes") / 1e6).first()]
        opened = lambda q: size(have.where(scan.hour_range(q) & scan.partition_filter(q)))
        read = {"all": size(have), "issue_list_hour": opened(issues), "service_warn": opened(service), "window_count": opened(in_window), "trace_hint": opened(near), "count_errors": opened(scan.Query(min_severity=17))}
        raw_queries = ["scan_limited", "minute_rollups", "context_lines", "mined_templates", "key_statistics", "service_buckets", "event_dedupe", "token_classes"]
        for name in raw_queries:
            run = catalogue.queries()[name]
            out[name] = timed(lambda run=run: run(spark, SF).write.format("noop").mode("overwrite").save(), 2)
        print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "rows": rows, "mined_lines_per_s": round(rows / out["mined_templates"]), "read": read, "sf": SF.rstrip("/").rpartition("sf")[2]}))
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    main()
