"""What is sent on at once, what stands for the rest, and what a finding adds.

Findings are few; their quiet periods and boosts go in order per service. Records meet
boosts by service and time cell, so no task replays a whole service."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import floor_ns
from ..shipping import ship
from ..sources.records import attr
from .context import lead_up
from .rollup import minute_rollups, rollup_records, sent_live

BOOST_NS, QUIET_NS = 300_000_000_000, 30_000_000_000


def _triggers(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["at_ns", "kind", "template_id", "detail"], kind="stable")
    until, last, said, new = 0, {}, [], []
    for at, kind, boost in zip(pdf.at_ns, pdf.kind, pdf.boost):
        fresh = bool(boost) and until <= at
        if boost:
            until = max(until, at + BOOST_NS)
        quiet = kind in last and at - last[kind] < QUIET_NS
        speak = fresh or not quiet
        if speak:
            last[kind] = at
        said.append(speak)
        new.append(fresh)
    return pdf.assign(said=said, new_boost=new)


def triggers(found: DataFrame) -> DataFrame:
    """Findings with `said` (not within the quiet period of its kind, or a new boost) and
    `new_boost`."""
    ship(found.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", said boolean, new_boost boolean"
    return found.groupBy("service").applyInPandas(_triggers, schema)


def plan(logs: DataFrame, told: DataFrame, fidelity: int, min_severity: int = 0) -> DataFrame:
    """Records of at least min_severity with `sent`: an error, in the sample, or of a
    service that a finding has boosted within the last five minutes."""
    cell = floor_ns(F.col("observed_ns"), BOOST_NS)
    rows = logs.where(F.col("severity") >= min_severity).withColumn("__cell", cell).withColumn("__live", sent_live(fidelity))
    at = floor_ns(F.col("at_ns"), BOOST_NS)
    boosts = told.where("boost").select(F.col("service").alias("b_service"), "at_ns", F.explode(F.array(at, at + BOOST_NS)).alias("b_cell"))
    on = F.col("service").eqNullSafe(F.col("b_service")) & (F.col("__cell") == F.col("b_cell")) & (F.col("at_ns") <= F.col("observed_ns")) & (F.col("observed_ns") < F.col("at_ns") + BOOST_NS)
    boosted = rows.where(~F.col("__live")).join(boosts, on, "left_semi").withColumn("sent", F.lit(True))
    rest = rows.where(~F.col("__live")).join(boosts, on, "left_anti").withColumn("sent", F.lit(False))
    return rows.where("__live").withColumn("sent", F.lit(True)).unionByName(boosted).unionByName(rest).drop("__cell", "__live")


def supplements(planned: DataFrame, told: DataFrame) -> DataFrame:
    """The lead-up of each finding that boosts and speaks, once per record."""
    return lead_up(planned.where("not sent"), told.where("boost and said").select("service", "kind", "at_ns"))


def markers(told: DataFrame, lead: DataFrame) -> DataFrame:
    """A record for each finding that speaks, which a receiver can alert on."""
    n = lead.groupBy("at_ns", "supplement").agg(F.count("*").alias("n")).select(F.col("at_ns").alias("l_at"), F.col("supplement").alias("l_kind"), "n")
    rows = told.where("said").join(n, (F.col("at_ns") == F.col("l_at")) & (F.concat(F.lit("lookback:"), "kind") == F.col("l_kind")), "left")
    given = [attr("tidelog.anomaly", "Bool", F.lit(True)), attr("tidelog.anomaly.kind", "Str", F.col("kind")), attr("tidelog.anomaly.lookback", "I64", F.coalesce("n", F.lit(0)))]
    return rows.select(
        F.col("at_ns").alias("timestamp_ns"),
        F.lit(13).cast("short").alias("severity"),
        F.lit("anomaly").alias("severity_text"),
        F.concat(F.lit("anomaly ("), "kind", F.lit("): "), F.coalesce("detail", F.lit(""))).alias("body"),
        "service",
        F.array(*given).alias("attributes"),
    )


def rollups(planned: DataFrame, instance: str) -> DataFrame:
    return rollup_records(minute_rollups(planned.where("not sent")), instance)
