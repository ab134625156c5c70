"""Structured Streaming forms of the operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.masking import mask_column
from ..functions.severity import ERROR, level_class
from ..operators.context import AGE_NS, LINES, correlation_key
from ..operators.mining import Miner, MinerConfig, Template
from ..operators.signals import BUCKET_NS, DECAYED, RATE_LEAST, SHARE_ERRORS, SHARE_TOTAL, SILENT_BUCKETS, SILENT_SERVICE, WARM, Baseline, Tracked
from ..shipping import ship


def arrival(logs: DataFrame) -> DataFrame:
    """Adds `observed_at`, the arrival clock as a timestamp, for watermarks."""
    return logs.withColumn("observed_at", F.timestamp_micros(F.call_function("div", F.col("observed_ns"), F.lit(1000).cast("long"))))


def minute_rollups(logs: DataFrame, grace: str = "5 seconds") -> DataFrame:
    """Rollups of one minute, sent when the minute and its grace are over."""
    w = F.window("observed_at", "1 minute")
    by = arrival(logs).withWatermark("observed_at", grace).groupBy(w, "service", F.coalesce("template_id", F.lit(0)).alias("template_id"), level_class(F.col("severity")).alias("class"))
    out = by.agg(F.count("*").alias("count"), F.min("observed_ns").alias("first_ns"), F.max("observed_ns").alias("last_ns"), F.max("severity").alias("max_severity"))
    return out.withColumn("minute_ms", F.unix_millis("window.start")).drop("window")


def bucket_counts(logs: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Per service and ten seconds: records, errors, warnings or worse."""
    s = F.col("severity")
    by = arrival(logs).withWatermark("observed_at", delay).groupBy(F.window("observed_at", "10 seconds"), "service")
    out = by.agg(F.count("*").alias("total"), F.count_if(s >= 17).alias("errors"), F.count_if(s >= 13).alias("warns"))
    return out.withColumn("bucket", F.call_function("div", F.unix_millis("window.start"), F.lit(10_000).cast("long"))).drop("window")


def deduped(logs: DataFrame, window: str = "10 minutes") -> DataFrame:
    """The first record of each event_id within the window."""
    return arrival(logs).withWatermark("observed_at", window).dropDuplicatesWithinWatermark(["event_id"]).drop("observed_at")


def mined(logs: DataFrame, scope: str, config: MinerConfig = MinerConfig()) -> DataFrame:
    """event_id, template_id, template, is_new, by a miner that lives in the state of each
    (scope, number of tokens)."""
    ship(logs.sparkSession)
    masked = mask_column(logs, "body", "tokens", "raw").where(F.size("tokens") > 0).withColumn("n", F.size("tokens"))
    masked = masked.select(F.coalesce(F.col(scope), F.lit("")).alias("scope"), "n", "event_id", "observed_ns", F.array_join("tokens", "\x1f").alias("key"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = []
        if state.exists:
            (rows,) = state.get
            known = [Template(*r[:1], r[1].split("\x1f"), *r[2:]) for r in rows]
        miner = Miner(config, known)
        pdf = pd.concat(list(batches)).sort_values(["observed_ns", "event_id"], kind="stable")
        out = []
        for id_, at, line in zip(pdf.event_id, pdf.observed_ns, pdf.key):
            number, new = miner.add(line.split("\x1f"), int(at))
            t = miner.templates.get(number)
            out.append((id_, miner.ids[number] if t else None, t.text if t else None, new))
        state.update(([(t.number, "\x1f".join(t.tokens), t.lineage_id, t.count, t.first_ns, t.last_ns) for t in miner.templates.values()],))
        yield pd.DataFrame(out, columns=["event_id", "template_id", "template", "is_new"]).astype({"template_id": "Int64"})

    return masked.groupBy("scope", "n").applyInPandasWithState(
        step,
        "event_id binary, template_id long, template string, is_new boolean",
        "templates array<struct<number: long, tokens: string, lineage_id: long, count: long, first_ns: long, last_ns: long>>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def error_shares(counts: DataFrame) -> DataFrame:
    """Services whose share of errors in a bucket is unusual; counts (service, bucket,
    total, errors) come in bucket order per service."""
    ship(counts.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Baseline(*state.get) if state.exists else Baseline()
        pdf, out = pd.concat(list(batches)).sort_values("bucket"), []
        for bucket, total, errors in zip(pdf.bucket, pdf.total, pdf.errors):
            if total < 20:
                continue
            x = errors / total
            spiked = b.n >= 6 and errors >= 5 and x > b.mean + 4 * b.sd + 0.05 and x >= 3 * b.mean
            if spiked:
                out.append((key[0], int(bucket), x, b.mean))
            b.update(x, spiked)
        state.update((b.mean, b.var, b.n))
        yield pd.DataFrame(out, columns=["service", "bucket", "share", "usual"])

    rows = counts.select(F.coalesce("service", F.lit("")).alias("service"), "bucket", "total", "errors")
    return rows.groupBy("service").applyInPandasWithState(step, "service string, bucket long, share double, usual double", "mean double, var double, n long", "append", GroupStateTimeout.NoTimeout)


@dataclass
class _Service:
    """A service's detectors between batches, over closed buckets in order."""

    last: int
    alive: Tracked
    floods: Baseline | None
    shares: Baseline

    def skip(self, upto: int, name: str) -> list[tuple]:
        """Empty buckets up to `upto`, and whether silence is found in them."""
        n, first = upto - self.last, self.last + 1
        if n <= 0:
            return []
        said, gone = self.alive.pass_over(n, first, SILENT_SERVICE, lambda b: False)
        if self.floods is not None:
            for _ in range(min(n, DECAYED)):
                self.floods.update(0.0, False)
            self.floods.n += max(0, n - DECAYED)
        if gone:
            self.alive = Tracked()
        self.last = upto
        return [] if said is None else [(name, said, "silence", False)]

    def close(self, bucket: int, total: int, errors: int, warns: int, name: str) -> list[tuple]:
        out = self.skip(bucket - 1, name)
        self.alive.quiet, self.alive.flagged = 0, False
        self.alive.update(float(total), False)
        if warns or self.floods is not None:
            b, x = self.floods or Baseline(), float(warns)
            if b.n >= WARM and x >= RATE_LEAST and x > b.mean + 4 * b.sd + 10 and x >= 3 * b.mean:
                out.append((name, bucket, "rate", True))
            b.update(x, x > 3 * b.mean)
            self.floods = b
        if total >= SHARE_TOTAL:
            b, x = self.shares, errors / total
            spiked = b.n >= WARM and errors >= SHARE_ERRORS and x > b.mean + 4 * b.sd + 0.05 and x >= 3 * b.mean
            if spiked:
                out.append((name, bucket, "error_share", True))
            b.update(x, spiked)
        self.last = bucket
        return out

    def packed(self) -> tuple:
        f = self.floods or Baseline()
        return (self.last, self.alive.mean, self.alive.var, self.alive.n, self.alive.quiet, self.alive.flagged, f.mean, f.var, f.n if self.floods else -1, self.shares.mean, self.shares.var, self.shares.n)

    @staticmethod
    def of(v: tuple) -> _Service:
        floods = Baseline(*v[6:9]) if v[8] >= 0 else None
        return _Service(v[0], Tracked(*v[1:6]), floods, Baseline(*v[9:12]))


def service_findings(counts: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """rate, error_share and silence of services from a stream of closed buckets (service,
    bucket, total, errors, warns). Silence is told when the watermark, which any service's
    buckets move on, is past the buckets that prove it."""
    ship(counts.sparkSession)
    step_ms = BUCKET_NS // 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, out = key[0], []
        service = _Service.of(state.get) if state.exists else None
        if state.hasTimedOut and service:
            out += service.skip(state.getCurrentWatermarkMs() // step_ms - 1, name)
        for pdf in batches:
            for row in pdf.sort_values("bucket").itertuples(index=False):
                if service is None:
                    service = _Service(row.bucket - 1, Tracked(), None, Baseline())
                if row.bucket > service.last:
                    out += service.close(int(row.bucket), int(row.total), int(row.errors), int(row.warns), name)
        if service:
            state.update(service.packed())
            if not service.alive.flagged:
                state.setTimeoutTimestamp(max((service.last + SILENT_BUCKETS + 1) * step_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["service", "bucket", "kind", "boost"]).astype({"bucket": "int64", "boost": bool})

    rows = counts.select(F.coalesce("service", F.lit("")).alias("service"), "bucket", "total", "errors", "warns", F.timestamp_millis((F.col("bucket") + 1) * step_ms).alias("at"))
    kept = "last long, mean double, var double, n long, quiet long, flagged boolean, f_mean double, f_var double, f_n long, s_mean double, s_var double, s_n long"
    return rows.withWatermark("at", delay).groupBy("service").applyInPandasWithState(step, "service string, bucket long, kind string, boost boolean", kept, "append", GroupStateTimeout.EventTimeTimeout)


def context_windows(logs: DataFrame, trigger: int = ERROR, age_ns: int = AGE_NS, lines: int = LINES) -> DataFrame:
    """Each error with the lines of its correlation key that came before it: event_id,
    observed_ns, key_tier, context_lines and flow, the path of templates. A key's state is
    its last lines, no older than age_ns; it goes when nothing comes for as long."""
    ship(logs.sparkSession)
    rows = arrival(correlation_key(logs)).withWatermark("observed_at", "10 seconds").select("key_tier", "key", "observed_at", "observed_ns", "event_id", "severity", "template_id", "body")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["event_id", "observed_ns", "key_tier", "context_lines", "flow"])
            return
        held = [tuple(x) for x in state.get[0]] if state.exists else []  # (time, template, hash of body)
        out = []
        for row in pd.concat(list(batches)).sort_values(["observed_ns", "event_id"], kind="stable").itertuples(index=False):
            template = "-" if pd.isna(row.template_id) else str(int(row.template_id))
            body = hashlib.blake2b(row.body.encode(), digest_size=16).hexdigest()
            if row.severity >= trigger:
                own = [x for x in held if x[0] >= row.observed_ns - age_ns and not (x[0] == row.observed_ns and x[2] == body)][-lines:]
                out.append((row.event_id, int(row.observed_ns), key[0], len(own), ",".join(x[1] for x in own) + "|" + template if own else None))
            held.append((int(row.observed_ns), template, body))
            held = [x for x in held[-lines - 1 :] if x[0] >= row.observed_ns - age_ns]
        state.update((held,))
        state.setTimeoutTimestamp(max(held[-1][0] // 1_000_000 + age_ns // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "observed_ns", "key_tier", "context_lines", "flow"])

    return rows.groupBy("key_tier", "key").applyInPandasWithState(
        step, "event_id binary, observed_ns long, key_tier string, context_lines long, flow string", "held array<struct<at: long, template: string, body: string>>", "append", GroupStateTimeout.EventTimeTimeout
    )


def to_store(logs: DataFrame, path: str, checkpoint: str, **trigger):
    """A query that writes a stream of records to the store, batch by batch; late records
    land in their own hour like any others. A batch that is tried again replaces what its
    first try has written."""
    from ..sources import store

    def put(batch: DataFrame, number: int) -> None:
        store.write(batch, path, batch=f"b{number:012d}")

    return logs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()


def files(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files under a path."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
