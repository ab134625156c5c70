"""Sampling and what stands for the records left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import rollup_id, selected
from ..functions.severity import ERROR, level_class
from ..functions.times import MINUTE_NS, floor_ns, int_div
from ..sources.records import attr

WINDOW_MS = 60_000


def sent_live(fidelity: int) -> Column:
    """Errors always; the rest by the sample of their ids."""
    return (F.col("severity") >= ERROR) | selected(F.col("event_id"), fidelity)


def minute_rollups(left_out: DataFrame) -> DataFrame:
    """Per (minute of `observed`, service, template or 0, class): rows, first, last, worst."""
    by = left_out.groupBy(
        int_div(floor_ns(F.col("observed_ns"), MINUTE_NS), 1_000_000).alias("minute_ms"), "service", F.coalesce("template_id", F.lit(0)).alias("template_id"), level_class(F.col("severity")).alias("class")
    )
    return by.agg(F.count("*").alias("count"), F.min("observed_ns").alias("first_ns"), F.max("observed_ns").alias("last_ns"), F.max("severity").alias("max_severity"))


def rollup_records(rollups: DataFrame, instance: str) -> DataFrame:
    """Rollups as records; their ids depend on their keys alone."""
    ns = F.col("minute_ms") * 1_000_000
    given = [attr("tidelog.rollup", "Bool", F.lit(True))]
    given += [attr(f"tidelog.rollup.{k}", "I64", v) for k, v in (("count", F.col("count")), ("window_ms", F.lit(WINDOW_MS)))]
    given += [attr("tidelog.rollup.class", "Str", F.col("class"))]
    given += [attr(f"tidelog.rollup.{k}", "I64", F.col(k)) for k in ("first_ns", "last_ns")]
    return rollups.select(
        rollup_id(instance, F.col("minute_ms"), F.col("service"), F.col("template_id"), F.col("class")).alias("event_id"),
        ns.alias("timestamp_ns"),
        ns.alias("observed_ns"),
        F.col("max_severity").cast("short").alias("severity"),
        F.lit("rollup").alias("severity_text"),
        F.concat("count", F.lit(" similar records were left out of sync ("), "class", F.lit(")")).alias("body"),
        "service",
        F.lit(None).cast("binary").alias("trace_id"),
        F.lit(None).cast("binary").alias("span_id"),
        F.when(F.col("template_id") != 0, F.col("template_id")).alias("template_id"),
        F.array(*given).alias("attributes"),
        F.lit(None).cast("string").alias("origin"),
    )


def shape_totals(sent: DataFrame, rollups: DataFrame, supplement: Column) -> DataFrame:
    """True totals per template: what rollups count, and records that aren't supplements."""
    live = sent.where(~F.coalesce(supplement, F.lit(False))).groupBy(F.coalesce("template_id", F.lit(0)).alias("template_id")).agg(F.count("*").alias("n"))
    return live.unionByName(rollups.select("template_id", F.col("count").alias("n"))).groupBy("template_id").agg(F.sum("n").alias("total"))


def vendor_rollups(logs: DataFrame) -> DataFrame:
    """Per (service, template): rows, first and last time, the first body as example."""
    by = logs.groupBy("service", "template")
    return by.agg(F.count("*").alias("count"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"), F.min_by("body", F.struct("observed_ns", "event_id")).alias("example"))


def bytes_avoided(logs: DataFrame, sent: Column) -> DataFrame:
    size = F.octet_length("body").cast("long")
    seen, out = F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(sent, size)), F.lit(0))
    return logs.agg(seen.alias("seen"), out.alias("sent"), (seen - out).alias("avoided"))


def item_kept(kind: Column, event_id: Column, rate: float, events: bool = True, attachments: bool = True, unknown: bool = False) -> Column:
    """The forwarding rule of envelope items: transactions and profiles by one sample of
    the envelope's id, sessions and client reports always."""
    from ..functions.hashing import transaction_kept

    known = ["session", "sessions", "client_report", "check_in", "replay_event", "log"]
    out = F.when(kind == "event", F.lit(events)).when(kind.isin("transaction", "profile"), transaction_kept(event_id, rate))
    return out.when(kind.isin("attachment", "replay_recording"), F.lit(attachments)).when(kind.isin(known), F.lit(True)).otherwise(F.lit(unknown))
