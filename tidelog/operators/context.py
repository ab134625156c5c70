"""Context of errors: the lines of the same flow just before, deduplicated and budgeted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import with_shape_hash
from ..functions.severity import ERROR
from ..functions.times import HOUR_NS, floor_ns
from ..sources.records import first_value

SECOND = 1_000_000_000
AGE_NS, LINES = 30 * SECOND, 200
DEDUPE_NS, MINUTE = 60 * SECOND, 60 * SECOND
WINDOWS, WINDOWS_PER_SHAPE = 30, 3

REQUEST_KEYS = ["request_id", "req_id", "session_id", "correlation_id"]


def correlation_key(logs: DataFrame) -> DataFrame:
    """Adds key_tier and key: the trace, else a request id within the service, else host,
    process and thread, else host and service."""
    a = F.col("attributes")
    text = lambda k: first_value(a, k, "Str", "I64")
    request = F.coalesce(*(text(k) for k in REQUEST_KEYS))
    service, host = F.coalesce("service", F.lit("")), F.coalesce(text("host"), F.lit(""))
    trace, thread = F.col("trace_id").isNotNull(), text("pid").isNotNull() & text("thread").isNotNull()
    tier = F.when(trace, "trace").when(request.isNotNull(), "request").when(thread, "thread").otherwise("service")
    slash = F.lit("/")
    key = F.when(trace, F.lower(F.hex("trace_id"))).when(request.isNotNull(), F.concat(service, slash, request))
    key = key.when(thread, F.concat(host, slash, text("pid"), slash, text("thread"))).otherwise(F.concat(host, slash, service))
    return logs.withColumn("key_tier", tier).withColumn("key", key)


def context_lines(logs: DataFrame, trigger: int = ERROR, age_ns: int = AGE_NS, lines: int = LINES) -> DataFrame:
    """(error, line) pairs: lines of the error's key that arrived before it, at most
    age_ns earlier, the newest `lines`; not the error itself, nor a line of its body and
    time. Keys meet in time cells of age_ns, so a key that many rows share is dealt out.
    Bodies are compared by two hashes, and only those of the lines that stay travel on."""
    keyed = correlation_key(logs).withColumn("cell", floor_ns(F.col("observed_ns"), age_ns)).withColumn("b1", F.xxhash64("body")).withColumn("b2", F.xxhash64(F.lit(1), "body"))
    line = keyed.select(F.xxhash64("key_tier", "key").alias("k"), "key_tier", "key", "cell", F.col("observed_ns").alias("l_observed"), F.col("event_id").alias("l_id"), F.col("severity").alias("l_severity"), F.col("template_id").alias("l_template"), F.col("body").alias("l_body"), F.col("b1").alias("l_b1"), F.col("b2").alias("l_b2"))
    error = keyed.where(F.col("severity") >= trigger).select(
        F.xxhash64("key_tier", "key").alias("e_k"), F.col("key_tier").alias("e_tier"), F.col("key").alias("e_key"), F.explode(F.array("cell", F.col("cell") - age_ns)).alias("e_cell"), "event_id", "observed_ns", "b1", "b2"
    )
    on = (F.col("k") == F.col("e_k")) & (F.col("key_tier") == F.col("e_tier")) & (F.col("key") == F.col("e_key")) & (F.col("cell") == F.col("e_cell"))
    before = F.struct("l_observed", "l_id") < F.struct("observed_ns", "event_id")
    near = F.col("l_observed") >= F.col("observed_ns") - age_ns
    same = (F.col("l_b1") == F.col("b1")) & (F.col("l_b2") == F.col("b2")) & (F.col("l_observed") == F.col("observed_ns"))
    hit = line.join(error, on).where(before & near & ~same)
    newest = Window.partitionBy("event_id").orderBy(F.desc("l_observed"), F.desc("l_id"))
    return hit.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= lines).select("event_id", "rank", "l_observed", "l_id", "l_severity", "l_template", "l_body")


def windows(logs: DataFrame, trigger: int = ERROR, age_ns: int = AGE_NS, lines: int = LINES) -> DataFrame:
    """One row per error: its context in order (empty if there is none) and flow_hash, the
    identity of the template sequence that led to it."""
    one = F.struct(F.col("l_observed").alias("observed_ns"), F.col("l_id").alias("event_id"), F.col("l_severity").alias("severity"), F.col("l_template").alias("template_id"), F.col("l_body").alias("body"))
    got = context_lines(logs, trigger, age_ns, lines).groupBy("event_id").agg(F.array_sort(F.collect_list(one)).alias("context"))
    errors = correlation_key(logs).where(F.col("severity") >= trigger)
    out = errors.join(got.withColumnRenamed("event_id", "c_id"), F.col("event_id") == F.col("c_id"), "left").drop("c_id")
    out = out.withColumn("context", F.coalesce("context", F.array().cast(got.schema["context"].dataType)))
    path = F.transform("context", lambda c: F.coalesce(c["template_id"].cast("string"), F.lit("-")))
    flow = F.concat(F.array_join(path, ","), F.lit("|"), F.coalesce(F.col("template_id").cast("string"), F.lit("-")))
    return with_shape_hash(out.withColumn("__flow", F.when(F.size("context") > 0, flow)), "__flow", "flow_hash").drop("__flow")


def _dedupe(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one flow: what opens a window, and how many were folded into the one before."""
    pdf = pdf.sort_values(["observed_ns", "event_id"], kind="stable")
    last, count, status, folded = None, 0, [], []
    for now in pdf.observed_ns:
        if last is not None and now - last < DEDUPE_NS:
            count += 1
            status.append("duplicate_flow")
            folded.append(0)
        else:
            status.append("open")
            folded.append(count)
            last, count = now, 0
    return pdf.assign(status=status, suppressed=folded)


def _budget(pdf: pd.DataFrame, ceiling: int = WINDOWS, per_shape: int = WINDOWS_PER_SHAPE) -> pd.DataFrame:
    """In order over what dedupe left: a ceiling per minute, then one per shape. Minutes
    start with the first window after the minute before has ended."""
    pdf = pdf.sort_values(["observed_ns", "event_id"], kind="stable")
    start, used, shapes, status = None, 0, {}, []
    for now, service, template in zip(pdf.observed_ns, pdf.service, pdf.template_id):
        if start is None or now - start >= MINUTE:
            start, used = now, 0
        if used >= ceiling:
            status.append("rate_limited")
            continue
        key = ("" if pd.isna(service) else service, 0 if pd.isna(template) else int(template))
        begin, n = shapes.get(key, (now, 0))
        if now - begin >= MINUTE:
            begin, n = now, 0
        if n >= per_shape:
            shapes[key] = (begin, n)
            status.append("rate_limited")
            continue
        shapes[key] = (begin, n + 1)
        used += 1
        status.append("window")
    return pdf.assign(status=status)


def sessions(rows: DataFrame, gap_ns: int, *of: str) -> DataFrame:
    """Adds `session`, a number that rises within `of` where no row came for gap_ns. A row's
    predecessor is looked up in its own time cell and the one before; sums are taken by
    hours first, so no task orders all rows of a group."""
    cell = floor_ns(F.col("observed_ns"), gap_ns)
    rows = rows.withColumn("__cell", cell)
    ends = rows.groupBy(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(of)), (F.col("__cell") + gap_ns).alias("__next")).agg(F.max("observed_ns").alias("__end"))
    same = F.col("__cell") == F.col("__next")
    for i, c in enumerate(of):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*of, "__cell").orderBy("observed_ns", "event_id")
    out = rows.join(ends, same, "left").withColumn("__before", F.coalesce(F.lag("observed_ns").over(inside), "__end"))
    begins = F.coalesce(F.col("observed_ns") - F.col("__before") >= gap_ns, F.lit(True)).cast("int")
    out = out.drop("__end", "__next", *(f"__g{i}" for i in range(len(of)))).withColumn("__begins", begins).withColumn("__hour", floor_ns(F.col("observed_ns"), HOUR_NS))
    per = out.groupBy(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(of)), F.col("__hour").alias("__h")).agg(F.sum("__begins").alias("__n"))
    earlier = Window.partitionBy(*(f"__g{i}" for i in range(len(of)))).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    same = F.col("__hour") == F.col("__h")
    for i, c in enumerate(of):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    run = Window.partitionBy(*of, "__hour").orderBy("observed_ns", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.join(per, same).withColumn("session", F.col("__base") + F.sum("__begins").over(run))
    return out.drop("__cell", "__before", "__begins", "__hour", "__h", "__n", "__base", *(f"__g{i}" for i in range(len(of))))


def captured(with_windows: DataFrame, ceiling: int = WINDOWS, per_shape: int = WINDOWS_PER_SHAPE) -> DataFrame:
    """Adds to windows(): status (window, no_context, duplicate_flow, rate_limited) and
    suppressed. Each origin dedupes and has its budgets on its own. Flows are independent
    until the budgets; those see only the windows that dedupe lets through, and start anew
    after a minute without any, so such stretches are groups of their own. The error itself
    is never dropped."""
    slim = with_windows.where("flow_hash is not null").select("event_id", "observed_ns", "service", "template_id", "flow_hash", "origin")
    fields = "event_id binary, observed_ns long, service string, template_id long, flow_hash long, origin string"
    deduped = slim.groupBy("origin", "flow_hash").applyInPandas(_dedupe, f"{fields}, status string, suppressed long")
    opened = sessions(deduped.where("status = 'open'"), MINUTE, "origin")
    budget = lambda pdf: _budget(pdf.drop(columns="session"), ceiling, per_shape)
    opened = opened.groupBy("origin", "session").applyInPandas(budget, f"{fields}, status string, suppressed long")
    decided = deduped.where("status <> 'open'").unionByName(opened).select(F.col("event_id").alias("d_id"), "status", F.when(F.col("status") == "window", F.col("suppressed")).alias("suppressed"))
    out = with_windows.join(decided, F.col("event_id") == F.col("d_id"), "left").drop("d_id")
    return out.withColumn("status", F.coalesce("status", F.lit("no_context"))).withColumn("suppressed", F.coalesce("suppressed", F.lit(0)))


def lead_up(left_out: DataFrame, triggers: DataFrame, back_ns: int = 60 * SECOND) -> DataFrame:
    """Left-out rows of a trigger's service in the time before it; each goes with its first
    trigger. Rows and triggers (service, kind, at_ns) meet in time cells."""
    rows = left_out.withColumn("cell", floor_ns(F.col("observed_ns"), back_ns))
    t = triggers.select(F.col("service").alias("t_service"), "kind", "at_ns", F.explode(F.array(floor_ns(F.col("at_ns"), back_ns), floor_ns(F.col("at_ns"), back_ns) - back_ns)).alias("t_cell"))
    on = F.col("service").eqNullSafe(F.col("t_service")) & (F.col("cell") == F.col("t_cell"))
    hit = rows.join(t, on).where((F.col("observed_ns") < F.col("at_ns")) & (F.col("observed_ns") >= F.col("at_ns") - back_ns))
    return hit.groupBy("event_id").agg(F.min(F.struct("at_ns", "kind")).alias("t")).select("event_id", F.col("t.at_ns").alias("at_ns"), F.concat(F.lit("lookback:"), F.col("t.kind")).alias("supplement"))


def dedupe_events(logs: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """One row per event_id, the first that arrived; none that `accepted` already has."""
    w = Window.partitionBy("event_id").orderBy("observed_ns", "origin")
    out = logs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return out if accepted is None else out.join(accepted.select("event_id"), "event_id", "left_anti")


def is_loop(attributes: Column, instance: str, most: int = 8) -> Column:
    """A record that came back, went too far, or whose provenance doesn't parse."""
    origins = F.filter(attributes, lambda a: a["key"] == "tidelog.origin")
    hops = F.filter(attributes, lambda a: a["key"] == "tidelog.hops")
    origin = F.try_element_at(origins, F.lit(1))["value"]["Str"]
    hop = F.try_element_at(hops, F.lit(1))["value"]
    n = F.coalesce(hop["I64"], F.when(hop["Str"].rlike("^[0-9]+$"), hop["Str"].try_cast("long")))
    forged = (F.size(origins) > 1) | (F.size(hops) > 1) | ((F.size(origins) == 1) & (F.coalesce(origin, F.lit("")) == ""))
    forged = forged | ((F.size(hops) == 1) & ~F.coalesce(n.between(0, 2**32 - 1), F.lit(False)))
    return F.coalesce(forged | F.coalesce(origin == instance, F.lit(False)) | (F.coalesce(n, F.lit(0)) >= most), F.lit(False))
