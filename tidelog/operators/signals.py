"""Findings: what is unusual in rates, silences, error shares, parameters and sequences.

Records are counted per bucket of ten seconds of arrival (`observed`) by partial
aggregation; running baselines then go over a key's buckets in order. Empty buckets are
made inside the grouped map, and only as far as they can change anything. After a stall
baselines start anew. Sequences and firsts are relational.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masking import numbers_expr
from ..functions.severity import ERROR, WARN
from ..functions.times import int_div
from ..shipping import ship

#: When detectors speak.
BUCKET_NS = 10_000_000_000
WARM, DRIFT_WARM = 6, 12
RATE_LEAST, TEMPLATE_LEAST = 20.0, 30.0
SILENT_TEMPLATE, SILENT_SERVICE, SILENT_BUCKETS = 3.0, 5.0, 6
SHARE_TOTAL, SHARE_ERRORS = 20, 5
DRIFT_VALUES, DRIFT_SLOTS = 10, 3
FORGET = 360
LEARN_NS = 60_000_000_000
#: After so many empty buckets a decayed baseline is zero to a double's precision.
DECAYED = 1500


@dataclass
class Baseline:
    """Exponentially weighted mean and variance of a bucket's measure."""

    mean: float = 0.0
    var: float = 0.0
    n: int = 0

    @property
    def sd(self) -> float:
        return math.sqrt(self.var)

    def update(self, x: float, slow: bool) -> None:
        rate = 0.02 if slow and self.n >= WARM else 0.2
        if self.n == 0:
            self.mean, self.var = x, 0.0
        else:
            d = x - self.mean
            self.mean += rate * d
            self.var = (1 - rate) * (self.var + rate * d * d)
        self.n += 1


@dataclass
class Tracked(Baseline):
    quiet: int = 0
    flagged: bool = False

    def pass_over(self, buckets: int, first: int, least: float, blocked) -> tuple[int | None, bool]:
        """`buckets` empty ones from number `first`: when silence is found, and whether the
        key is forgotten. blocked(bucket) holds silence back."""
        said = None
        for k in range(buckets):
            settled = self.mean >= least and (self.flagged or said is not None)
            if settled or self.quiet >= FORGET and self.mean < least:
                self.quiet += buckets - k
                break
            self.quiet += 1
            if self.mean < least:
                self.update(0.0, False)
            if self.mean >= least and self.quiet >= SILENT_BUCKETS and not self.flagged and not blocked(first + k):
                self.flagged, said = True, first + k
            if self.quiet >= FORGET and self.mean < least:
                return said, True
        return said, self.quiet >= FORGET and self.mean < least


Row = tuple[int, str, str, bool]  # bucket, kind, detail, boost


def service_rows(present: list[tuple[int, int]], end: int, name: str) -> tuple[list[Row], list[tuple[int, int]]]:
    """Silences of a service from its (bucket, count), up to bucket `end`; and the runs of
    buckets in which it is silent."""
    out, runs, t, last = [], [], Tracked(), None
    for bucket, count in [*present, (end + 1, 0)]:
        if last is not None and bucket > last + 1:
            said, gone = t.pass_over(bucket - last - 1, last + 1, SILENT_SERVICE, lambda b: False)
            if said is not None:
                out.append((said, "silence", name, False))
                runs.append((said, bucket - 1))
            if gone:
                t = Tracked()
        if bucket > end:
            break
        t.quiet, t.flagged = 0, False
        t.update(float(count), False)
        last = bucket
    return out, runs


def template_rows(present: list[tuple[int, int, int]], end: int, name: str, silent: list[tuple[int, int]]) -> list[Row]:
    """Floods and silences of a template of a service from its (bucket, count, worst)."""
    out, t, last = [], Tracked(), None
    blocked = lambda b: any(lo <= b <= hi for lo, hi in silent)
    for bucket, count, worst in [*present, (end + 1, 0, 0)]:
        if last is not None and bucket > last + 1:
            said, gone = t.pass_over(bucket - last - 1, last + 1, SILENT_TEMPLATE, blocked)
            if said is not None:
                out.append((said, "silence", name, False))
            if gone:
                t = Tracked()
        if bucket > end:
            break
        x = float(count)
        t.quiet, t.flagged = 0, False
        spiked = t.n >= WARM and x >= TEMPLATE_LEAST and x > t.mean + 4 * t.sd + 10 and x >= 4 * t.mean
        if spiked:
            out.append((bucket, "template_rate", name, worst >= WARN))
        t.update(x, spiked)
        last = bucket
    return out


def rate_rows(present: list[tuple[int, int]], end: int, name: str) -> list[Row]:
    """Floods of warnings or worse; empty buckets count as zeros from the first one on."""
    out, b, last = [], Baseline(), None
    for bucket, count in [*present, (end + 1, 0)]:
        if last is not None:
            empty = bucket - last - 1
            for _ in range(min(empty, DECAYED)):
                b.update(0.0, False)
            b.n += max(0, empty - DECAYED)
        if bucket > end:
            break
        x = float(count)
        if b.n >= WARM and x >= RATE_LEAST and x > b.mean + 4 * b.sd + 10 and x >= 3 * b.mean:
            out.append((bucket, "rate", name, True))
        b.update(x, x > 3 * b.mean)
        last = bucket
    return out


def share_rows(present: list[tuple[int, int, int]], name: str) -> list[Row]:
    """Errors as a share of a service's records, in buckets with enough of them."""
    out, b = [], Baseline()
    for bucket, total, errors in present:
        if total < SHARE_TOTAL:
            continue
        x = errors / total
        spiked = b.n >= WARM and errors >= SHARE_ERRORS and x > b.mean + 4 * b.sd + 0.05 and x >= 3 * b.mean
        if spiked:
            out.append((bucket, "error_share", name, True))
        b.update(x, spiked)
    return out


def drift_rows(present: list[tuple[int, float, int]], name: str) -> list[Row]:
    """A number of a template against its own past."""
    out, b = [], Baseline()
    for bucket, total, count in present:
        if count < DRIFT_VALUES:
            continue
        x = total / count
        shift = abs(x - b.mean)
        drifted = b.n >= DRIFT_WARM and shift > 5 * b.sd and shift >= 0.5 * abs(b.mean) and shift >= 1.0
        if drifted:
            out.append((bucket, "param_drift", name, True))
        b.update(x, drifted)
    return out


def _bucket():
    return int_div(F.col("observed_ns"), BUCKET_NS).alias("bucket")


def service_counts(logs: DataFrame) -> DataFrame:
    """(service, bucket): records, errors, warnings or worse."""
    s = F.col("severity")
    return logs.groupBy("service", _bucket()).agg(F.count("*").alias("total"), F.count_if(s >= ERROR).alias("errors"), F.count_if(s >= WARN).alias("warns"))


def template_counts(logs: DataFrame) -> DataFrame:
    return logs.where("template_id is not null").groupBy("service", "template_id", _bucket()).agg(F.count("*").alias("n"), F.max("severity").alias("worst"))


def slot_sums(logs: DataFrame) -> DataFrame:
    """(service, template_id, slot, bucket): sum and count of the line's first numbers."""
    slots = F.posexplode(F.slice(numbers_expr(F.col("body")), 1, DRIFT_SLOTS)).alias("slot", "value")
    rows = logs.where("template_id is not null").select("service", "template_id", _bucket(), slots)
    return rows.groupBy("service", "template_id", "slot", "bucket").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


FINDING = "service string, template_id long, bucket long, kind string, detail string, boost boolean"
FIELDS = ["service", "template_id", "bucket", "kind", "detail", "boost"]


def _name(service) -> str:
    return "(no service)" if service is None or pd.isna(service) else service


def _frame(rows: Iterable[tuple], *more: str) -> pd.DataFrame:
    out = pd.DataFrame(list(rows), columns=[*FIELDS, *more])
    return out.astype({"template_id": "Int64", "bucket": "int64", "boost": bool, **dict.fromkeys(more, "int64")})


def epochs(logs: DataFrame, end_ns: int | None = None) -> DataFrame:
    """The stretches (begin, end in buckets) between stalls. Where nothing at all arrives
    for longer than an hour, detectors start anew: the bucket that was open then is never
    closed, so it isn't in its epoch. A row for each ten seconds with records is ordered in
    one task; what comes out has at most a row an hour."""
    per = logs.groupBy(_bucket()).agg(F.min("observed_ns").alias("first"))
    w = Window.orderBy("bucket")
    stalled = F.coalesce(F.col("first") - F.lag("bucket").over(w) * BUCKET_NS > FORGET * BUCKET_NS, F.lit(True))
    per = per.withColumn("begins", stalled.cast("int")).withColumn("epoch", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = per.groupBy("epoch").agg(F.min("bucket").alias("begin"), F.max("bucket").alias("end"))
    last = F.col("epoch") == F.max("epoch").over(Window.partitionBy())
    closing = F.col("end") if end_ns is None else F.lit(end_ns // BUCKET_NS)
    return out.select("begin", F.when(last, closing).otherwise(F.col("end") - 1).alias("end"))


def bucket_findings(logs: DataFrame, end_ns: int | None = None) -> DataFrame:
    """Findings that a closing bucket makes: rate, silence, template_rate, error_share,
    param_drift. All buckets up to that of end_ns (the last record, if none) are closed.
    A service's own buckets are one group; each of its templates and slots is another."""
    ship(logs.sparkSession)
    spans = F.broadcast(epochs(logs, end_ns))  # a row an hour at most
    within = (F.col("bucket") >= F.col("begin")) & (F.col("bucket") <= F.col("end"))
    totals = service_counts(logs).join(spans, within)

    def service(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket"], kind="stable")
        who, end = pdf.service.iloc[0], int(pdf.end.iloc[0])
        name = _name(who)
        said, silent = service_rows(list(zip(pdf.bucket, pdf.total)), end, name)
        warned = pdf[pdf.warns > 0]
        out = [*said, *rate_rows(list(zip(warned.bucket, warned.warns)), end, name), *share_rows(list(zip(pdf.bucket, pdf.total, pdf.errors)), name)]
        who = None if pd.isna(who) else who
        runs = [(who, None, lo, "run", "", False, hi) for lo, hi in silent]
        return _frame([(who, None, *r, 0) for r in out] + runs, "until")

    own = totals.groupBy("service", "begin", "end").applyInPandas(service, f"{FINDING}, until long")
    runs = own.where("kind = 'run'").join(spans, within).groupBy(F.col("service").alias("r_service"), F.col("begin").alias("r_begin")).agg(F.array_sort(F.collect_list(F.struct(F.col("bucket").alias("lo"), F.col("until").alias("hi")))).alias("silent"))

    templates = template_counts(logs).select("service", "template_id", F.lit(-1).alias("slot"), "bucket", F.col("n").alias("count"), F.col("worst").cast("long").alias("worst"), F.lit(0.0).alias("value"))
    slots = slot_sums(logs).select("service", "template_id", "slot", "bucket", F.col("n").alias("count"), F.lit(0).cast("long").alias("worst"), F.col("total").alias("value"))
    rows = templates.unionByName(slots).join(spans, within)
    rows = rows.join(runs, F.col("service").eqNullSafe(F.col("r_service")) & (F.col("begin") == F.col("r_begin")), "left").drop("r_service", "r_begin")

    def template(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket"], kind="stable")
        who, id_, slot, silent = pdf.service.iloc[0], int(pdf.template_id.iloc[0]), int(pdf.slot.iloc[0]), pdf.silent.iloc[0]
        if slot >= 0:
            out = drift_rows(list(zip(pdf.bucket, pdf.value, pdf["count"])), f"{_name(who)} value {slot + 1}")
        else:
            runs_ = [] if silent is None else [(r["lo"], r["hi"]) for r in silent]
            out = template_rows(list(zip(pdf.bucket, pdf["count"], pdf.worst)), int(pdf.end.iloc[0]), _name(who), runs_)
        return _frame((None if pd.isna(who) else who, id_, *r) for r in out)

    each = rows.groupBy("service", "begin", "template_id", "slot").applyInPandas(template, FINDING)
    return own.where("kind <> 'run'").drop("until").unionByName(each)


def first_findings(logs: DataFrame, start_ns: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Findings at a record: novel (a template never seen), new_pair (new in this service),
    flow (a step of a trace never seen). The first minute learns; a template's very first
    record is novel and nothing else. `known` are (service, template_id) pairs seen before."""
    rows = logs.where("template_id is not null")
    if start_ns is None:
        start_ns = logs.agg(F.min("observed_ns")).first()[0] or 0
    at = F.struct("observed_ns", "event_id")
    learned = start_ns + LEARN_NS
    ever = rows.groupBy("template_id").agg(F.min(at).alias("first")).select(F.col("template_id").alias("t"), "first")
    pairs = rows.groupBy("service", "template_id").agg(F.min(at).alias("at"))
    w = Window.partitionBy("trace_id").orderBy("observed_ns", "event_id")
    steps = rows.where("trace_id is not null").withColumn("previous", F.lag("template_id").over(w)).where("previous <> template_id")
    steps = steps.groupBy("service", "previous", "template_id").agg(F.min(at).alias("at"))
    if known is not None:
        k = known.select(F.col("service").alias("ks"), F.col("template_id").alias("kt"))
        ever = ever.join(k.select("kt").distinct(), F.col("t") == F.col("kt"), "left_anti")
        pairs = pairs.join(k, F.col("service").eqNullSafe(F.col("ks")) & (F.col("template_id") == F.col("kt")), "left_anti")
    after = 0 if known is not None else learned
    novel = rows.join(ever, (F.col("template_id") == F.col("t")) & (at == F.col("first")))
    novel = novel.where(F.col("observed_ns") >= after).select("service", "template_id", "observed_ns", F.lit("novel").alias("kind"), F.lit("").alias("detail"))
    told = lambda d, kind, detail, since: d.join(ever, F.col("template_id") == F.col("t"), "left").where(F.col("first").isNull() | (F.col("at") != F.col("first"))).where(F.col("at.observed_ns") >= since).select("service", "template_id", F.col("at.observed_ns").alias("observed_ns"), F.lit(kind).alias("kind"), detail.alias("detail"))
    return novel.unionByName(told(pairs, "new_pair", F.lit(""), after)).unionByName(told(steps, "flow", F.col("previous").cast("string"), learned)).withColumn("boost", F.lit(True))


def findings(logs: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """All findings: service, template_id, at_ns, kind, detail, boost. A bucket's findings
    are made when it closes."""
    shut = bucket_findings(logs, end_ns).select("service", "template_id", ((F.col("bucket") + 1) * BUCKET_NS).alias("at_ns"), "kind", "detail", "boost")
    return first_findings(logs, start_ns).select("service", "template_id", F.col("observed_ns").alias("at_ns"), "kind", "detail", "boost").unionByName(shut)
