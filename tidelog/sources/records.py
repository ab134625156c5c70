"""The record: one schema for every log line, whatever it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.severity import bucket_for
from ..functions.times import epoch_hour, format_hour, ns_of_naive

VALUE = T.StructType([T.StructField("Str", T.StringType()), T.StructField("I64", T.LongType()), T.StructField("F64", T.DoubleType()), T.StructField("Bool", T.BooleanType())])
ATTRIBUTES = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", VALUE)]))

#: Times are nanoseconds in longs: Spark's timestamps would lose three digits.
RECORD = T.StructType(
    [
        T.StructField("event_id", T.BinaryType(), False),
        T.StructField("timestamp_ns", T.LongType(), False),
        T.StructField("observed_ns", T.LongType(), False),
        T.StructField("severity", T.ShortType(), False),
        T.StructField("severity_text", T.StringType()),
        T.StructField("body", T.StringType(), False),
        T.StructField("service", T.StringType()),
        T.StructField("trace_id", T.BinaryType()),
        T.StructField("span_id", T.BinaryType()),
        T.StructField("template_id", T.LongType()),
        T.StructField("attributes", ATTRIBUTES),
        T.StructField("origin", T.StringType()),
    ]
)

KINDS = {"Str": "string", "I64": "bigint", "F64": "double", "Bool": "boolean"}


def attr(key: str, kind: str, value: Column) -> Column:
    """One attribute as a struct."""
    fields = [(value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in KINDS.items()]
    return F.struct(F.lit(key).alias("key"), F.struct(*fields).alias("value"))


def attr_json(attributes: Column) -> Column:
    """The stored form: a list of {key, value: {type: value}}; null when there is none."""
    return F.when(F.size(attributes) > 0, F.to_json(attributes))


def attr_of_json(text: Column) -> Column:
    return F.from_json(text, ATTRIBUTES)


def first_value(attributes: Column, key: str, *kinds: str) -> Column:
    """The first attribute of a key as text, if it is of one of the kinds."""
    got = F.filter(attributes, lambda a: (a["key"] == key) & F.coalesce(*(a["value"][k].cast("string") for k in kinds)).isNotNull())
    return F.coalesce(*(F.try_element_at(got, F.lit(1))["value"][k].cast("string") for k in kinds))


def with_attr(attributes: Column, one: Column) -> Column:
    """Attributes with `one` in place of any of its key."""
    return F.concat(F.filter(F.coalesce(attributes, F.array().cast(ATTRIBUTES)), lambda a: a["key"] != one["key"]), F.array(one))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as records: a typed source for every query of the catalogue."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ns = ns_of_naive(F.col("ts"))
    kind, user = F.col("event_type"), F.col("user_id")
    severity = F.when(kind == "error", 17).when(kind == "purchase", 13).when(kind == "view", 5).otherwise(9)
    trace = F.when(F.col("event_id") % 5 != 0, F.unhex(F.lpad(F.hex(user * 1_000_000 + epoch_hour(ns)), 32, "0")))
    body = F.concat(kind, F.lit(" user="), user, F.lit(" took "), F.col("value"), F.lit("ms"))
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.select(
        F.unhex(F.lpad(F.hex("event_id"), 32, "0")).alias("event_id"),
        ns.alias("timestamp_ns"),
        ns.alias("observed_ns"),
        severity.cast("short").alias("severity"),
        F.when(kind == "error", "ERROR").alias("severity_text"),
        body.alias("body"),
        F.when(user % 17 != 0, F.concat(F.lit("svc-"), user % 8)).alias("service"),
        trace.alias("trace_id"),
        F.lit(None).cast("binary").alias("span_id"),
        F.lit(None).cast("long").alias("template_id"),
        F.array(attr("k", "I64", k), attr("latency_ms", "F64", F.col("value")), attr("event", "Str", kind)).alias("attributes"),
        F.concat(F.lit("node-"), F.col("event_id") % 3).alias("origin"),
    )


def with_partitions(logs: DataFrame, tenant: str = "default", index: str = "main", node: str = "n0") -> DataFrame:
    """Adds the columns of the store's path: tenant, index, hour, level, node."""
    given = [F.lit(tenant).alias("tenant"), F.lit(index).alias("index"), format_hour(F.col("timestamp_ns")).alias("hour"), bucket_for(F.col("severity")).alias("level"), F.lit(node).alias("node")]
    return logs.select("*", *[c for c, n in zip(given, ("tenant", "index", "hour", "level", "node"), strict=True) if n not in logs.columns])
