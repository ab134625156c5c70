"""Counts over template, service, severity and time: the questions asked of a log store.

Templates that aren't in the records yet are taken from masked text; the content hash is
computed on the grouped rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import shape_hash
from ..functions.masking import with_masked_text
from ..functions.times import HOUR_NS, MINUTE_NS, floor_ns, int_div


def with_text(logs: DataFrame) -> DataFrame:
    """Adds `template`, the masked text of the body."""
    return with_masked_text(logs)


def spine(logs: DataFrame, *more: Column) -> DataFrame:
    """Rows per service and template."""
    by = with_text(logs).groupBy("service", "template", *more).agg(F.count("*").alias("n"))
    return by.withColumn("template_id", shape_hash(F.col("template")))


def errors(logs: DataFrame, least: int = 17) -> DataFrame:
    return logs.where(F.col("severity") >= least).agg(F.count("*").alias("n"))


def top_templates(logs: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent templates, ties by text."""
    top = with_text(logs).groupBy("template").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template").limit(k)
    return top.withColumn("template_id", shape_hash(F.col("template")))


def by_service(logs: DataFrame, least: int) -> DataFrame:
    return logs.where(F.col("severity") >= least).groupBy("service").agg(F.count("*").alias("n"))


def in_window(logs: DataFrame, from_ns: int, until_ns: int) -> DataFrame:
    return logs.where((F.col("timestamp_ns") >= from_ns) & (F.col("timestamp_ns") < until_ns))


def by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("n"))


def duplicates(logs: DataFrame) -> DataFrame:
    """Rows, distinct ids and the difference."""
    d = logs.agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("ids"))
    return d.withColumn("duplicates", F.col("rows") - F.col("ids"))


def issue_list(logs: DataFrame, from_ns: int, until_ns: int, least: int = 13) -> DataFrame:
    """Templates of warnings or worse in a window: how often, first and last."""
    hit = with_text(in_window(logs, from_ns, until_ns).where(F.col("severity") >= least).select("service", "body", "severity", "timestamp_ns"))
    return hit.groupBy("service", "template").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"), F.max("severity").alias("severity"))


def busy_traces(logs: DataFrame, least: int) -> DataFrame:
    """Traces with more than `least` rows."""
    return logs.where("trace_id is not null").groupBy("trace_id").agg(F.count("*").alias("n")).where(F.col("n") > least)


def gaps(logs: DataFrame) -> DataFrame:
    """Per row, the time since the template's row before it."""
    w = Window.partitionBy("template").orderBy("timestamp_ns", "event_id")
    return with_text(logs).withColumn("gap_ns", F.col("timestamp_ns") - F.lag("timestamp_ns").over(w)).where("gap_ns is not null")


def percentiles(df: DataFrame, value: str, at: dict[str, float], *group: str) -> DataFrame:
    """Percentiles by index, the lower neighbour and never between two values: the value
    of rank floor((n - 1) * p) from 0. Ranks come from counts of equal values, not from a
    collected list."""
    per = df.groupBy(*group, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*group).orderBy(value)
    n = F.sum("__c").over(Window.partitionBy(*group))
    per = per.withColumn("__to", F.sum("__c").over(w)).withColumn("__n", n).withColumn("__from", F.col("__to") - F.col("__c"))
    rank = {k: F.floor((F.col("__n") - 1) * F.lit(p)) for k, p in at.items()}
    return per.groupBy(*group).agg(*(F.max(F.when((F.col("__from") <= r) & (r < F.col("__to")), F.col(value))).alias(k) for k, r in rank.items()))


def share_within(gap_rows: DataFrame, windows_ns: list[int]) -> DataFrame:
    """The share of gaps up to each window."""
    n = F.count("*")
    return gap_rows.agg(*(F.round(F.count_if(F.col("gap_ns") <= w) * 100.0 / n, 4).alias(f"within_{w // 1_000_000_000}s") for w in windows_ns))


def new_per_minute(logs: DataFrame) -> DataFrame:
    """How many templates were first seen in each minute."""
    first = with_text(logs).groupBy("template").agg(F.min("timestamp_ns").alias("first_ns"))
    return first.groupBy(floor_ns(F.col("first_ns"), MINUTE_NS).alias("minute_ns")).agg(F.count("*").alias("n"))


def parsing_accuracy(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """The share of lines whose predicted group is exactly a group of the truth."""
    both = df.groupBy(F.col(predicted).alias("p"), F.col(truth).alias("t")).agg(F.count("*").alias("n"))
    p = both.groupBy("p").agg(F.sum("n").alias("np")).withColumnRenamed("p", "p2")
    t = both.groupBy("t").agg(F.sum("n").alias("nt")).withColumnRenamed("t", "t2")
    exact = (F.col("n") == F.col("np")) & (F.col("n") == F.col("nt"))
    joined = both.join(p, F.col("p").eqNullSafe(F.col("p2"))).join(t, F.col("t").eqNullSafe(F.col("t2")))
    return joined.agg((F.coalesce(F.sum(F.when(exact, F.col("n"))), F.lit(0)) / F.sum("n")).alias("accuracy"), F.count_if(exact).alias("groups"))


def running(rows: DataFrame, name: str, weight: Column, *of: str, clock: str = "observed_ns", ties: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Adds the sum of `weight` over the rows of the same `of` that come earlier by (clock,
    ties). Sums are taken by hours first and rows are ordered within an hour, so no task
    orders a whole group, or the whole table where `of` is empty."""
    rows = rows.withColumn("__w", weight).withColumn("__hour", floor_ns(F.col(clock), HOUR_NS))
    group = [F.col(c).alias(f"__g{i}") for i, c in enumerate(of)]
    per = rows.groupBy(*group, F.col("__hour").alias("__h")).agg(F.sum("__w").alias("__s"))
    earlier = Window.partitionBy(*(f"__g{i}" for i in range(len(of)))).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__base", F.coalesce(F.sum("__s").over(earlier), F.lit(0))).drop("__s")
    same = F.col("__hour") == F.col("__h")
    for i, c in enumerate(of):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*of, "__hour").orderBy(clock, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(per, same).withColumn(name, (F.col("__base") + F.coalesce(F.sum("__w").over(inside), F.lit(0))).cast("long"))
    return out.drop("__w", "__hour", "__h", "__base", *(f"__g{i}" for i in range(len(of))))


def segments(logs: DataFrame, n: int) -> DataFrame:
    """Rows in runs of n by (observed, id)."""
    rows = running(logs.select("event_id", "observed_ns"), "__before", F.lit(1))
    return rows.select("event_id", int_div(F.col("__before"), n).alias("segment"))


def flows(logs: DataFrame) -> DataFrame:
    """Per (service, previous template, template) of one trace, first time and rows; steps
    to the same template don't count."""
    w = Window.partitionBy("trace_id").orderBy("observed_ns", "event_id")
    step = with_text(logs.where("trace_id is not null")).withColumn("previous", F.lag("template").over(w))
    step = step.where("previous is not null and previous <> template")
    return step.groupBy("service", "previous", "template").agg(F.min("observed_ns").alias("first_ns"), F.count("*").alias("n"))


def first_seen(logs: DataFrame) -> DataFrame:
    """Per (service, template): first time, and whether it is the template's first ever."""
    per = with_text(logs).groupBy("service", "template").agg(F.min(F.struct("observed_ns", "event_id")).alias("at"))
    ever = Window.partitionBy("template")
    return per.withColumn("first_ever", F.col("at") == F.min("at").over(ever)).select("service", "template", F.col("at.observed_ns").alias("first_ns"), "first_ever")


def spine_payload(logs: DataFrame) -> DataFrame:
    """Per (template, service, minute): rows, first and last, distinct traces, smallest body."""
    minute = floor_ns(F.col("timestamp_ns"), MINUTE_NS).alias("minute_ns")
    per = with_text(logs).groupBy("template", "service", minute)
    return per.agg(
        F.count("*").alias("n"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"), F.countDistinct("trace_id").alias("traces"), F.min("body").alias("exemplar")
    )


def sketch_counts(logs: DataFrame) -> DataFrame:
    """Approximate distinct bodies per template, by HyperLogLog; and how many rows."""
    return with_text(logs).groupBy("template").agg(F.approx_count_distinct("body", 0.02).alias("bodies"), F.count("*").alias("n"))


def frequent(logs: DataFrame, column: str = "body", k: int = 5) -> DataFrame:
    """Per template the values of a column that come most often, by a bounded sketch; its
    counts are estimates where a template has more values than the sketch tracks."""
    top = with_text(logs).groupBy("template").agg(F.expr(f"approx_top_k({column}, {k})").alias("top"))
    return top.select("template", F.explode("top").alias("t")).select("template", F.col("t.item").alias(column), F.col("t.count").alias("n"))
