"""Receivers, store and streams."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from tidelog.functions.hashing import shape_hash_of
from tidelog.operators import mining, rollup, scan, signals, typed
from tidelog.sources import lines, receivers, records, store
from tidelog.streaming import jobs

NOW = 1_700_000_000_000_000_000


def attrs(r):
    return {k: v for k, _, v in r["attributes"]}


def test_collector_events():
    text = '{"time": 1700000000.5, "sourcetype": "web", "event": "x ERROR down", "fields": {"n": 5, "f": 1.5, "b": true, "o": {"a": 1}}}\n{"event": {"level": "warn", "m": 1}, "time": "1700000000123", "host": "h"} {"event": "note=1 ERROR", "time": -1}'
    a, b, c = receivers.collector_events(text, NOW, {"sourcetype": "d", "index": "i"})
    assert (a["timestamp_ns"], a["severity"], a["service"]) == (1_700_000_000_500_000_000, 17, "web")
    assert attrs(a) == {"sourcetype": "web", "index": "i", "n": 5, "f": 1.5, "b": True, "o": '{"a":1}'}
    assert b["body"] == '{"level":"warn","m":1}' and b["severity"] == 13 and b["severity_text"] == "warn" and b["service"] == "d" and b["timestamp_ns"] // 10**6 == 1_700_000_000_123
    assert c["severity"] == 9 and c["timestamp_ns"] == NOW
    for bad in ("", '{"event": ""}', '{"x": 1}', "[1]", '{"event": null}', '{"event": "a"} x'):
        with pytest.raises(ValueError):
            receivers.collector_events(bad, NOW)


def test_event_times():
    assert receivers.event_time(1e11) == 10**17 and receivers.event_time(5) == 5 * 10**9 and receivers.event_time("x") is None and receivers.event_time(0) is None and receivers.event_time(True) is None


def test_levels_in_lines(spark):
    cases = [("2024 [error] x", 17), ("INFO: up", 9), ("a b c d e f g h i j k l ERROR", None), ("x=1 ERROR", None), ("= ERROR", 17), ("errors=0", None), ("error_count", None)]
    assert [receivers.level_in_line(t) for t, _ in cases] == [n for _, n in cases]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(lines.level_in_line(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [n for _, n in cases]


def test_stdin_lines(spark):
    texts = ["ERROR\tboom service=api trace_id=" + "ab" * 16, "NOPE\tx", "plain svc=\"q\" service=z trace=short req_id=7", "warning\tw"]
    rows = lines.parse_lines(spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1), NOW).collect()
    assert [(r.severity, r.service) for r in rows] == [(17, "api"), (9, None), (9, "z"), (13, None)]
    assert rows[0].trace_id == bytes.fromhex("ab" * 16) and len(rows[2].trace_id) == 16 and rows[1].body == "NOPE\tx"
    assert [(a.key, a.value.Str) for a in rows[2].attributes] == [("request_id", "7")]
    assert len({bytes(r.event_id) for r in rows}) == 4 and all(len(r.event_id) == 16 for r in rows)


def test_otlp_json():
    body = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeLogs": [{"scope": {"name": "sc"}, "logRecords": [
        {"timeUnixNano": "5", "severityNumber": 99, "body": {"kvlistValue": {"values": [{"key": "a", "value": {"intValue": "1"}}]}}, "traceId": "00" * 16, "spanId": "01" * 8, "attributes": [{"key": "l", "value": {"arrayValue": {"values": [{"boolValue": True}, {"doubleValue": 2.0}]}}}]},
        {"observed_time_unix_nano": 7, "severity_text": "warn", "event_name": "e"}, {}]}]}]}
    a, b, c = receivers.otlp_json(json.dumps(body), NOW)
    assert (a["timestamp_ns"], a["observed_ns"], a["severity"], a["body"], a["trace_id"], a["span_id"]) == (5, NOW, 24, "{a=1}", None, b"\x01" * 8)
    assert attrs(a) == {"l": "[true,2]", "otel.scope.name": "sc", "service.name": "api"} and a["service"] == "api"
    assert (b["timestamp_ns"], b["severity"], attrs(b)["event.name"]) == (7, 13, "e") and (c["severity"], c["timestamp_ns"]) == (9, NOW)


def _field(n, wire, data):
    head = bytes([n << 3 | wire])
    return head + (bytes([len(data)]) + data if wire == 2 else data)


def test_otlp_protobuf():
    value = lambda d: _field(5, 2, d)
    kv = _field(1, 2, b"k") + _field(2, 2, _field(3, 0, b"\x07"))
    rec = _field(1, 1, struct.pack("<Q", 9)) + _field(2, 0, b"\x11") + value(_field(1, 2, b"hi")) + _field(6, 2, kv) + _field(9, 2, b"\x02" * 16) + _field(10, 2, b"\0" * 8)
    scope = _field(1, 2, _field(1, 2, b"sc")) + _field(2, 2, rec)
    res = _field(1, 2, _field(1, 2, _field(1, 2, b"service.name") + _field(2, 2, _field(1, 2, b"api"))))
    (r,) = receivers.otlp_protobuf(_field(1, 2, res + _field(2, 2, scope)), NOW)
    assert (r["timestamp_ns"], r["severity"], r["body"], r["service"], r["trace_id"], r["span_id"]) == (9, 17, "hi", "api", b"\x02" * 16, None)
    assert attrs(r) == {"k": 7, "otel.scope.name": "sc", "service.name": "api"}
    with pytest.raises(ValueError):
        receivers.otlp_protobuf(b"\x0a\x7f", NOW)


def test_envelopes():
    event = json.dumps({"level": "fatal", "logentry": {"message": "m"}, "release": "1", "timestamp": 5.5, "contexts": {"trace": {"trace_id": "ab" * 16}}}).encode()
    body = b'{"event_id":"e1"}\n{"type":"event","length":%d}\n%s\n{"type":"attachment","length":4}\na\nbc\n{"type":"session"}\n{"x":1}\n{"type":"transaction"}\n{"transaction":"t"}\n' % (len(event), event)
    a, b, c, d = receivers.envelope_records(body, NOW, "7")
    assert (a["severity"], a["body"], a["timestamp_ns"], a["service"], a["trace_id"]) == (21, "m", 5_500_000_000, "sentry:7", b"\xab" * 16)
    assert b["body"] == "attachment 4 bytes" and "sentry.payload" not in attrs(b) and c["body"] == "session item" and d["body"] == "transaction t"
    project, again = receivers.envelope_of({k: v for k, v in attrs(a).items() if isinstance(v, str)}, "new")
    assert project == "7" and receivers.envelope(again)[1][0][1] == event and receivers.envelope_of({}, "x") is None
    assert receivers.envelope(receivers.wrap_store_body(event, "n"))[1][0][1] == event
    for bad in (b"", b"[]", b'{}\n{"type":"event","length":9}\nabc', b"{}\n[]\n"):
        with pytest.raises(ValueError):
            receivers.envelope(bad)
    assert receivers.event_summary({"exception": {"values": [{"type": "E"}]}}) == "E" and receivers.event_summary({"message": "x"}) == "x" and receivers.event_summary({}) == "sentry event"


def test_refused_bodies_have_no_records(spark):
    df = spark.createDataFrame([("x",), (None,), ('{"event": "ok"}',)], "value string")
    rows = receivers.decoded(df, lambda t: receivers.collector_events(t, NOW)).collect()
    assert [r.body for r in rows] == ["ok"] and len(rows[0].event_id) == 16


def test_refused_bodies_are_told(spark):
    parse = lambda t: receivers.collector_events(t, NOW)
    df = spark.createDataFrame([("{not json", 1), ('{"event": "ok"}', 2), ('{"event": "ok"}', 3), (None, 4)], "value string, n long")
    (row,) = receivers.refused(df, parse).collect()
    assert row.bytes == 9 and row.reason.startswith(("ValueError", "JSONDecodeError")) and len(row.body_hash) == 64
    assert len({bytes(r.event_id) for r in receivers.decoded(df, parse).collect()}) == 1
    assert len({bytes(r.event_id) for r in receivers.decoded(df, parse, request="n").collect()}) == 2


def test_rate_limits(spark):
    df = spark.createDataFrame([("60:error;transaction:key, 10::org", 100), ("5:error", 200), ("x:error", 1)], "h string, at long")
    assert {r.category: r.until for r in receivers.rate_limits(df, "h", "at").collect()} == {"error": 205, "transaction": 160, "all": 110}


def test_store_round_trip(spark, sf, tmp_path):
    logs = records.event_logs(spark, sf)
    path = str(tmp_path / "store")
    columns = [typed.TypedColumn("attr_k", "k", "int64", ""), typed.TypedColumn("attr_latency_ms", "latency_ms", "float64", "")]
    store.write(logs.where("severity < 13"), path, columns)
    store.write(logs.where("severity >= 13"), path)
    back = store.read(spark, path)
    assert back.count() == logs.count() and dict(back.dtypes)["attr_k"] == "bigint" and dict(back.dtypes)["hour"] == "string"
    rows = typed.decode(store.read(spark, path, columns).withColumn("attributes", records.attr_of_json(F.col("attributes"))), columns)
    keys = lambda d: sorted((bytes(r.event_id), sorted(a.key for a in r.attributes)) for r in d.select("event_id", "attributes").collect())
    assert keys(rows) == keys(logs)
    q = scan.Query(1_704_844_800_000_000_000, 1_704_931_200_000_000_000, min_severity=13)
    hit = scan.matches(back, q)
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan.replace("PartitionFilters: [(isnotnull", "PartitionFilters: [isnotnull") and "PushedFilters" in plan
    assert hit.count() == scan.matches(records.with_partitions(logs), q).count()
    listed = store.files(back)
    assert listed.agg(F.sum("rows")).first()[0] == logs.count() and listed.where("bytes > 0").count() == listed.count()
    sizes = {r.column: r.bytes for r in store.column_sizes(spark, path).collect()}
    assert sizes["body"] > 0 and "event_id" in sizes
    store.rewrite(spark, path, str(tmp_path / "small"))
    assert store.read(spark, str(tmp_path / "small")).count() == logs.count()


def hours_of(spark, hours, each=5):
    rows = spark.range(hours * each).select(F.col("id"), (F.col("id") % hours * 3_600_000_000_000 + F.col("id")).alias("at"))
    body = F.concat(F.lit("line "), F.col("id"))
    return rows.select(
        F.unhex(F.lpad(F.hex("id"), 32, "0")).alias("event_id"), F.col("at").alias("timestamp_ns"), F.col("at").alias("observed_ns"), F.lit(9).cast("short").alias("severity"), F.lit(None).cast("string").alias("severity_text"), body.alias("body"),
        F.concat(F.lit("s"), F.col("id") % 2).alias("service"), F.lit(None).cast("binary").alias("trace_id"), F.lit(None).cast("binary").alias("span_id"), F.lit(1).cast("long").alias("template_id"), F.array(records.attr("n", "I64", F.col("id"))).alias("attributes"), F.lit("n").alias("origin"),
    )


def test_limited_scans_stop_early(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write(hours_of(spark, 50), path)
    q = scan.Query(limit=12)
    assert store.newest_hours(spark, path, q, []) >= "1970-01-02T19"
    got = store.scan(spark, path, q, [])
    assert [r.body for r in got.collect()] == [r.body for r in scan.scan(store.read(spark, path, []), q).collect()]
    read = store.read(spark, path, []).where(F.col("hour") >= store.newest_hours(spark, path, q, [])).select("_metadata.file_path").distinct().count()
    assert read <= 14 < len(got.inputFiles())  # seven hours, two services each
    assert store.newest_hours(spark, path, scan.Query(service="s9"), []) == "1970-01-01T00" and store.scan(spark, path, scan.Query(service="s9"), []).count() == 0
    assert store.scan(spark, path, scan.Query(limit=0), []).count() == 1
    narrow = scan.Query(from_ns=10 * 3_600_000_000_000, until_ns=12 * 3_600_000_000_000, contains="line", limit=1000)
    assert store.scan(spark, path, narrow, []).count() == 10


def test_footers_read_no_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    logs = hours_of(spark, 20)
    before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    store.write(logs, path)
    got = store.footers(spark, path)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(timestamp_ns)" in plan
    want = scan.file_table(records.with_partitions(logs))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == before


def test_batches_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "s")
    logs = hours_of(spark, 3)
    store.write(logs, path, batch="b1")
    store.write(logs, path, batch="b1")
    store.write(logs.limit(4), path, batch="b2")
    assert store.read(spark, path).count() == logs.count() + 4
    store.write(logs.limit(2), path, batch="b1")  # another plan, the same batch
    assert store.read(spark, path).count() == 6


def test_typed_columns_are_registered(spark, tmp_path):
    path = str(tmp_path / "s")
    columns = [typed.TypedColumn("attr_n", "n", "int64", "s1")]
    store.write(hours_of(spark, 2), path, columns)
    assert store.registry(spark, path) == []
    store.register(spark, path, columns)
    store.register(spark, path, [typed.TypedColumn("attr_m", "m", "string", "s1")])
    assert [c.column for c in store.registry(spark, path)] == ["attr_m", "attr_n"]
    back = store.read(spark, path, store.registry(spark, path))
    assert back.agg(F.sum("attr_n"), F.count("attr_m")).first()[:] == (45, 0)


def test_compaction_swaps_and_recovers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    logs = hours_of(spark, 2, 40)
    for k in range(5):
        store.write(logs.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == k), path)
    rows = store.read(spark, path).count()
    ids = {bytes(r.event_id) for r in store.read(spark, path).collect()}
    files = store.listing(spark, path).count()
    remove = store._remove
    monkeypatch.setattr(store, "_remove", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped here")))
    with pytest.raises(RuntimeError):
        store.compact(spark, path, 4_000_000_000, min_files=3)
    monkeypatch.setattr(store, "_remove", remove)
    assert {bytes(r.event_id) for r in store.read(spark, path).collect()} == ids  # twice for now, but none is lost
    assert store.recover(spark, path) == 1 and store.recover(spark, path) == 0
    assert store.read(spark, path).count() == rows and store.listing(spark, path).count() < files
    assert store.compact(spark, path, 4_000_000_000, min_files=3) == 0
    assert store.compact(spark, path, 0, min_files=1) == 0  # not quiet yet


def test_maintenance(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write(hours_of(spark, 40), path)
    day = 86_400
    done = store.maintain(spark, path, 7 * day + 10 * 3600)
    assert done == {"recovered": 0, "deleted": 10, "compacted": 0}
    assert store.footers(spark, path).agg(F.min("hour")).first()[0] == "1970-01-01T10"
    assert store.maintain(spark, path, day, budget=1)["deleted"] == 30


def test_restore_migrate_and_rebuild(spark, tmp_path):
    import hashlib
    from pathlib import Path

    from tidelog.sources import recovery

    logs = hours_of(spark, 6)
    raw, parts, target = tmp_path / "raw", tmp_path / "parts", str(tmp_path / "s")
    logs.withColumn("attributes", records.attr_json(F.col("attributes"))).repartition(3).write.parquet(str(raw))
    parts.mkdir()
    names = []
    for p in sorted(Path(raw).glob("*.parquet")):
        names.append(f"{hashlib.sha256(p.read_bytes()).hexdigest()}.parquet")
        (parts / names[-1]).write_bytes(p.read_bytes())
    (parts / ("0" * 64 + ".parquet")).write_bytes((parts / names[0]).read_bytes())
    sizes = [(n, (parts / n).stat().st_size, spark.read.parquet(str(parts / n)).count()) for n in names] + [("f" * 64 + ".parquet", 1, 1)]
    inventory = spark.createDataFrame([*sizes, ("0" * 64 + ".parquet", sizes[0][1], sizes[0][2])], "name string, size long, rows long")
    verdicts = {r.name: r.verdict for r in recovery.restore(spark, str(parts), target, inventory).collect()}
    assert [verdicts[n] for n in names] == ["restored"] * 3 and verdicts["f" * 64 + ".parquet"] == "missing" and verdicts["0" * 64 + ".parquet"] == "wrong_hash"
    assert store.read(spark, target, []).count() == logs.count()
    with pytest.raises(ValueError):
        recovery.restore(spark, str(parts), target)
    assert recovery.restore(spark, str(parts), target, inventory, force=True).count() == 5 and store.read(spark, target, []).count() == logs.count()
    assert recovery.rebuilt_dictionary(spark, target).agg(F.sum("rows")).first()[0] == logs.count()
    files, found = recovery.rebuilt_catalog(spark, target)
    assert found == [] and files.count() == 6 and files.agg(F.min("rows")).first()[0] == 5
    recovery.write_manifests(spark, target)
    assert recovery.manifest(spark, target, "1970-01-01").count() == 6 and store.read(spark, target).count() == logs.count()
    counters = spark.createDataFrame([(1, 77)], "counter long, template_id long")
    old = logs.withColumn("template_id", F.when(F.col("service") == "s0", 1).otherwise(2).cast("long"))
    assert recovery.migrate(old, counters, str(tmp_path / "new")) == {"rows": 30, "unknown_ids": 15}
    assert sorted({r.template_id for r in store.read(spark, str(tmp_path / "new"), []).collect()}, key=str) == [77, None]


def test_typed_columns_are_found_again(spark, tmp_path):
    from tidelog.sources import recovery

    path = str(tmp_path / "s")
    store.write(hours_of(spark, 2), path, [typed.TypedColumn("attr_n", "n", "int64", "s1")])
    assert [(c.column, c.key, c.type) for c in recovery.rebuilt_catalog(spark, path)[1]] == [("attr_n", "n", "int64")] and len(store.registry(spark, path)) == 1


def test_backfill_ranges(spark):
    for a, b in ((5, 5), (0, 32 * 86_400_000)):
        with pytest.raises(ValueError):
            scan.backfill(spark.range(1), a, b)


def test_parts_are_verified(spark, tmp_path):
    import hashlib
    from pathlib import Path

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "b"))
    (tmp_path / "parts").mkdir()
    names = []
    for d in "ab":
        data = next(Path(tmp_path / d).glob("*.parquet")).read_bytes()
        names.append((hashlib.sha256(data).hexdigest() + ".parquet", len(data)))
        (tmp_path / "parts" / names[-1][0]).write_bytes(data)
    (tmp_path / "parts" / ("0" * 64 + ".parquet")).write_bytes(data)
    inventory = spark.createDataFrame([(*names[0], 10), (*names[1], 8), ("f" * 64 + ".parquet", 1, 1)], "name string, size long, rows long")
    got = {r.name: r.verdict for r in store.verified(spark, str(tmp_path / "parts"), inventory).collect()}
    assert got == {names[0][0]: "ok", names[1][0]: "wrong_rows", "f" * 64 + ".parquet": "missing", "0" * 64 + ".parquet": "unexpected"}


@pytest.fixture()
def stream(spark, sf, tmp_path):
    logs = records.event_logs(spark, sf).withColumn("template_id", F.crc32("body") % 5)
    path = str(tmp_path / "in")
    logs.repartition(4).write.parquet(path)
    return spark.read.parquet(path), lambda: jobs.files(spark, path, logs.schema)


def drain(query_df, tmp_path, name, mode="append"):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_df.sparkSession.table(name)


def test_stream_rollups_equal_batch(spark, stream, tmp_path):
    batch, source = stream
    got = drain(jobs.minute_rollups(source()), tmp_path, "rolls", "complete" if False else "append")
    want = {tuple(r) for r in rollup.minute_rollups(batch).select("minute_ms", "service", "template_id", "class", "count", "first_ns", "last_ns").collect()}
    have = {tuple(r) for r in got.select("minute_ms", "service", "template_id", "class", "count", "first_ns", "last_ns").collect()}
    assert have <= want and len(want) - len(have) <= 1  # the last minute is still open


def test_stream_dedupe_and_buckets(spark, stream, tmp_path):
    batch, source = stream
    assert drain(jobs.deduped(source()), tmp_path, "once").count() == batch.count()
    have = {tuple(r) for r in drain(jobs.bucket_counts(source()), tmp_path, "buckets").select("service", "bucket", "total", "errors").collect()}
    want = {tuple(r) for r in signals.service_counts(batch).select("service", "bucket", "total", "errors").collect()}
    assert have <= want and len(want) - len(have) <= 2


def test_stream_mining_equals_batch(spark, stream, tmp_path):
    batch, source = stream
    got = {bytes(r.event_id): (r.template_id, r.template) for r in drain(jobs.mined(source(), "service"), tmp_path, "mined").collect()}
    want = {bytes(r.event_id): (r.template_id, r.template) for r in mining.mine_templates(batch, ["service"], ["observed_ns", "event_id"]).collect()}
    assert got == want and all(i == shape_hash_of(t) for i, t in got.values())


def test_stream_into_the_store(spark, stream, tmp_path):
    batch, source = stream
    q = jobs.to_store(source(), str(tmp_path / "store"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert store.read(spark, str(tmp_path / "store")).count() == batch.count()


def test_stream_error_shares(spark, tmp_path):
    rows = [("s", b, 100, 2 if b != 12 else 70) for b in range(20)]
    path = str(tmp_path / "c")
    df = spark.createDataFrame(rows, "service string, bucket long, total long, errors long")
    df.coalesce(1).write.parquet(path)
    got = drain(jobs.error_shares(jobs.files(spark, path, df.schema)), tmp_path, "shares").collect()
    assert [r.bucket for r in got] == [12]


def test_stream_findings_equal_batch(spark, tmp_path):
    import random

    from tidelog.streaming.jobs import service_findings

    r = random.Random(2)
    rows = []
    for b in range(120):
        for name in ("a", "b", "c"):
            if name == "b" and 40 <= b < 70 or name == "c" and b % 7 == 3:
                continue
            warns = 90 if (name, b) in {("a", 50), ("c", 80)} else r.choice([2, 3, 4])
            rows.append((name, b, 100, 60 if (name, b) == ("a", 90) else 2, warns))
    schema = "service string, bucket long, total long, errors long, warns long"
    path = tmp_path / "c"
    for k in range(4):  # four batches, thirty buckets each
        spark.createDataFrame([x for x in rows if x[1] // 30 == k], schema).coalesce(1).write.mode("append").parquet(str(path / f"p{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(path))
    got = {(x.service, x.bucket, x.kind) for x in drain(service_findings(source), tmp_path, "found").collect()}
    want = set()
    for name in ("a", "b", "c"):
        own = [x for x in rows if x[0] == name]
        want |= {(name, x[0], x[1]) for x in signals.service_rows([(b, n) for _, b, n, _, _ in own], 119, name)[0]}
        want |= {(name, x[0], x[1]) for x in signals.rate_rows([(b, w) for _, b, _, _, w in own], 119, name)}
        want |= {(name, x[0], x[1]) for x in signals.share_rows([(b, n, e) for _, b, n, e, _ in own], name)}
    assert got == want and {k for *_, k in got} == {"silence", "rate", "error_share"}


def test_stream_context_equals_batch(spark, stream, tmp_path):
    from tidelog.operators import context

    batch, source = stream
    got = {bytes(x.event_id): (x.context_lines, x.flow) for x in drain(jobs.context_windows(source(), age_ns=3600 * 1_000_000_000), tmp_path, "windows").collect()}
    want = {bytes(x.event_id): len(x.context) for x in context.windows(batch, age_ns=3600 * 1_000_000_000).collect()}
    assert {k: n for k, (n, _) in got.items()} == want and any(want.values())
    assert all((f is None) == (n == 0) for n, f in got.values())
