"""What goes to other systems: payloads of windows and rollups, frames for peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import vendor_level
from ..sources.records import ATTRIBUTES, attr, with_attr
from .shapes import running


def hex16(id_: Column) -> Column:
    return F.lpad(F.lower(F.hex(id_)), 16, "0")


def _secs(ns: Column) -> Column:
    return ns / 1e9


def issue_events(windows: DataFrame) -> DataFrame:
    """Per window the JSON of an issue tracker's event: grouped by the template's content
    hash, context as breadcrumbs."""
    mark = F.when(F.col("template_id").isNotNull(), F.concat(F.lit("tidelog:t:"), hex16(F.col("template_id")))).otherwise(F.concat(F.lit("tidelog:flow:"), hex16(F.col("flow_hash"))))
    crumbs = F.transform(
        "context", lambda c: F.struct(_secs(c["observed_ns"]).alias("timestamp"), vendor_level(c["severity"]).alias("level"), F.lit("default").alias("type"), F.lit("tidelog").alias("category"), c["body"].alias("message"))
    )
    tags = F.map_concat(
        F.create_map(F.lit("tidelog.key_tier"), F.col("key_tier"), F.lit("tidelog.flow_hash"), hex16(F.col("flow_hash"))),
        F.when(F.col("service").isNotNull(), F.create_map(F.lit("service"), F.col("service"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    event_id = F.concat(F.lit("0" * 16), hex16(F.col("flow_hash").bitwiseXOR(F.col("observed_ns"))))
    event = F.struct(
        event_id.alias("event_id"), _secs(F.col("observed_ns")).alias("timestamp"), F.lit("other").alias("platform"), vendor_level(F.col("severity")).alias("level"), F.lit("tidelog").alias("logger"),
        F.array(mark).alias("fingerprint"), F.struct(F.col("body").alias("formatted")).alias("message"), tags.alias("tags"), F.struct(crumbs.alias("values")).alias("breadcrumbs"),
        F.struct(F.size("context").alias("context_lines"), F.col("suppressed").alias("collapsed")).alias("extra"),
    )
    return windows.select("event_id", event_id.alias("issue_event_id"), F.to_json(event).alias("event"))


def issue_envelopes(windows: DataFrame) -> DataFrame:
    e = issue_events(windows)
    head = F.concat(F.lit('{"event_id":"'), "issue_event_id", F.lit('"}\n{"type":"event","content_type":"application/json","length":'), F.octet_length("event"), F.lit("}\n"))
    return e.select("event_id", F.concat(head, "event").alias("envelope"))


def collector_events(windows: DataFrame) -> DataFrame:
    """Per window the JSON of one collector event; the context is a field, not events."""
    lines = F.transform("context", lambda c: F.struct(c["observed_ns"].alias("ts"), c["severity"].alias("severity"), c["template_id"].alias("template_id"), c["body"].alias("body")))
    event = F.struct(
        "body", "severity", "service", "template_id", "key_tier", hex16(F.col("flow_hash")).alias("flow_hash"), F.col("suppressed").alias("collapsed"), F.size("context").alias("context_lines"), lines.alias("context")
    )
    whole = F.struct(_secs(F.col("observed_ns")).alias("time"), F.lit("tidelog").alias("source"), F.lit("tidelog:error").alias("sourcetype"), event.alias("event"))
    return windows.select("event_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("payload"))


def window_lines(captured: DataFrame) -> DataFrame:
    """Per error a line of JSON: its window, or the error alone with the reason why its
    context was left out and the flow of the window it belongs to."""
    line = lambda ts, severity, template, body: F.struct(ts.alias("ts"), severity.alias("severity"), template.alias("template_id"), body.alias("body"))
    error = line(F.col("observed_ns"), F.col("severity"), F.col("template_id"), F.col("body")).alias("error")
    context = F.transform("context", lambda c: line(c["observed_ns"], c["severity"], c["template_id"], c["body"]))
    flow, keep = hex16(F.col("flow_hash")), {"ignoreNullFields": "false"}
    whole = F.struct(error, context.alias("context"), F.size("context").alias("context_lines"), F.col("key_tier"), flow.alias("flow_hash"), F.col("suppressed").alias("collapsed"), F.col("service"))
    bare = F.struct(error, F.slice(context, 1, 0).alias("context"), F.lit(0).alias("context_lines"), F.col("status").alias("context_suppressed"), flow.alias("flow_hash"), F.col("service"))
    return captured.select("event_id", F.when(F.col("status") == "window", F.to_json(whole, keep)).otherwise(F.to_json(bare, keep)).alias("value"))


def collector_aggregates(rollups: DataFrame) -> DataFrame:
    """Per vendor rollup the JSON of one event that stands for all of its records."""
    event = F.struct("template_id", "template", "service", "count", _secs(F.col("first_ns")).alias("first_seen"), _secs(F.col("last_ns")).alias("last_seen"), "example")
    whole = F.struct(_secs(F.col("last_ns")).alias("time"), F.lit("tidelog").alias("source"), F.lit("tidelog:aggregate").alias("sourcetype"), event.alias("event"))
    return rollups.select("service", "template", F.to_json(whole, {"ignoreNullFields": "false"}).alias("payload"))


def stamped(logs: DataFrame, instance: str, most: int = 8) -> DataFrame:
    """Sets the first sender, unless known, and one more hop."""
    a = F.coalesce(F.col("attributes"), F.array().cast(ATTRIBUTES))
    got = lambda k: F.try_element_at(F.filter(a, lambda x: x["key"] == k), F.lit(1))["value"]
    hops = F.coalesce(got("tidelog.hops")["I64"], got("tidelog.hops")["Str"].try_cast("long"), F.lit(0))
    origin = attr("tidelog.origin", "Str", F.coalesce(got("tidelog.origin")["Str"], F.lit(instance)))
    return logs.withColumn("attributes", with_attr(with_attr(a, origin), attr("tidelog.hops", "I64", F.least(hops + 1, F.lit(most)))))


def frames(lines: DataFrame, stream: str = "service", order: str = "observed_ns", size: int = 1 << 20) -> DataFrame:
    """Numbers the lines' frames of about `size` bytes, per stream and in order: a frame
    ends with the line that reaches a multiple of the size."""
    lines = running(lines, "__before", F.octet_length("value") + 1, stream, clock=order, ties=("value",))
    return lines.withColumn("frame", F.call_function("div", F.col("__before"), F.lit(size).cast("long"))).drop("__before")


def shaped(captured: DataFrame) -> DataFrame:
    """How each error goes out: with its context, or bare to trackers and folded into the
    service's and template's aggregate at collectors."""
    full = F.col("status") == "window"
    return captured.select("event_id", "status", F.when(full, "context").otherwise("bare").alias("tracker"), F.when(full, "context").otherwise("aggregate").alias("collector"))
