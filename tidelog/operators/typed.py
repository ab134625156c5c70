"""Typed attribute columns: keys that a service uses steadily get a column of their own,
which Parquet can filter by; everything else stays in the JSON list."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import canonical_ns
from ..sources.records import ATTRIBUTES
from .shapes import running

PREFIX = "attr_"
EXACT_INT = 2**53
#: Column types and Spark's for each; timestamps are nanoseconds.
TYPES = {"int64": "bigint", "float64": "double", "bool": "boolean", "string": "string", "timestamp": "bigint"}


@dataclass(frozen=True)
class TypedConfig:
    max_per_service: int = 16
    max_columns: int = 128
    min_rows: int = 200
    min_presence: float = 0.5
    min_type_share: float = 0.95
    max_string_bytes: int = 256
    sample_rows: int = 32_768


@dataclass(frozen=True)
class TypedColumn:
    column: str
    key: str
    type: str
    service: str


def column_name(key: str) -> str | None:
    """The column of a key; each byte outside a-z, 0-9 and _ becomes one _."""
    data = key.encode()
    if not data or len(data) > 64 or not re.search(rb"[A-Za-z0-9]", data):
        return None
    return PREFIX + re.sub(rb"[^a-z0-9_]", b"_", data.lower()).decode()


def first_of_each(attributes: Column) -> Column:
    """The list without later attributes of a key that came before. Only lists with a
    repeated key are gone through."""
    n = F.size(attributes)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    keys = F.transform(attributes, lambda a: a["key"])
    own = F.filter(at, lambda i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return F.when(F.size(F.array_distinct(keys)) == n, attributes).otherwise(F.transform(own, lambda i: F.get(attributes, i)))


def key_statistics(logs: DataFrame, stride: int = 1, order: list[str] | None = None) -> DataFrame:
    """(service, key) to how often it is present and with values of which type, with the
    service's rows and sampled rows. With a stride, rows 0, stride, 2 stride ... in order
    (a clock in nanoseconds, then ties) are sampled; a missing service counts as the empty one."""
    rows = logs.select(F.coalesce("service", F.lit("")).alias("service"), F.coalesce("attributes", F.array().cast(ATTRIBUTES)).alias("attributes"), *(order or []))
    if stride > 1:
        clock, *ties = order or []
        rows = running(rows, "__n", F.lit(1), clock=clock, ties=tuple(ties))
        rows = rows.withColumn("sampled", F.pmod("__n", F.lit(stride)) == 0)
    else:
        rows = rows.withColumn("sampled", F.lit(True))
    per = rows.groupBy("service").agg(F.count("*").alias("rows"), F.count_if("sampled").alias("sampled"))
    v = F.col("a.value")
    text = v["Str"]
    each = rows.where("sampled").select("service", F.explode(first_of_each(F.col("attributes"))).alias("a"))
    stats = each.groupBy("service", F.col("a.key").alias("key")).agg(
        F.count("*").alias("present"),
        F.count(v["I64"]).alias("ints"),
        F.count(v["F64"]).alias("floats"),
        F.count(v["Bool"]).alias("bools"),
        F.count(F.when((F.length(text) >= 20) & text.endswith("Z"), canonical_ns(text))).alias("timestamps"),
        F.count(text).alias("strings"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("string_bytes"),
    )
    return stats.join(per, "service")


def stable_type(config: TypedConfig = TypedConfig()) -> Column:
    """The type of a key's values, null if they have no steady one."""
    enough = lambda c: c >= config.min_type_share * F.col("present")
    small = F.col("string_bytes") <= config.max_string_bytes * F.col("strings")
    out = F.when((F.col("floats") > 0) & enough(F.col("ints") + F.col("floats")), "float64").when(enough(F.col("ints")), "int64")
    return out.when(enough(F.col("bools")), "bool").when(enough(F.col("timestamps")), "timestamp").when(enough(F.col("strings")) & small, "string")


def candidates(stats: DataFrame, config: TypedConfig = TypedConfig()) -> DataFrame:
    kept = stats.where((F.col("rows") >= config.min_rows) & (F.col("present") >= config.min_presence * F.col("sampled")))
    return kept.withColumn("type", stable_type(config)).where("type is not null").select("service", "key", "type", "present")


def plan(logs: DataFrame, known: list[TypedColumn] = [], config: TypedConfig = TypedConfig(), order: list[str] | None = None) -> list[TypedColumn]:  # noqa: B006
    """New columns: services in name order, a service's keys by presence and name, within
    its budget and the whole one. Only the candidates come to the driver, at most one row
    per steady (service, key)."""
    if not config.max_per_service or len(known) >= config.max_columns:
        return []
    stride = max(1, logs.count() // config.sample_rows) if order else 1
    have = {c.key for c in known}
    rows = candidates(key_statistics(logs, stride, order), config).collect()
    rows = sorted((r for r in rows if r["key"] not in have), key=lambda r: (r["service"].encode(), -r["present"], r["key"].encode()))
    taken, out = {c.column for c in known}, []
    used: dict[str, int] = {}
    for c in known:
        used[c.service] = used.get(c.service, 0) + 1
    for r in rows:
        name = column_name(r["key"])
        if len(known) + len(out) >= config.max_columns or used.get(r["service"], 0) >= config.max_per_service or name is None or name in taken:
            continue
        taken.add(name)
        out.append(TypedColumn(name, r["key"], r["type"], r["service"]))
        used[r["service"]] = used.get(r["service"], 0) + 1
    return out


def conform(value: Column, type_: str) -> Column:
    """A value as the column's type, null if it isn't of it."""
    if type_ == "int64":
        return value["I64"]
    if type_ == "float64":
        whole = F.when(value["I64"].between(-EXACT_INT, EXACT_INT), value["I64"].cast("double"))
        return F.coalesce(value["F64"], whole)
    if type_ == "bool":
        return value["Bool"]
    return value["Str"] if type_ == "string" else canonical_ns(value["Str"])


def encode(logs: DataFrame, columns: list[TypedColumn]) -> DataFrame:
    """Moves conforming first values to their columns; the rest stays in `attributes`."""
    a = F.coalesce(F.col("attributes"), F.array().cast(ATTRIBUTES))
    keys = F.transform(a, lambda x: x["key"])
    out, moved = logs, []
    for c in sorted(columns, key=lambda c: c.column):
        at = F.array_position(keys, F.lit(c.key)).cast("int")
        value = F.when(at > 0, conform(F.get(a, at - 1)["value"], c.type))
        out = out.withColumn(c.column, value.cast(TYPES[c.type]))
        moved.append(F.when(F.col(c.column).isNotNull(), at))
    if moved:
        n = F.size(a)
        every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        gone = F.array(*moved)
        rest = F.filter(every, lambda i: ~F.coalesce(F.array_contains(gone, i), F.lit(False)))
        out = out.withColumn("attributes", F.transform(rest, lambda i: F.get(a, i - 1)))
    for c in columns:
        out = out.withMetadata(c.column, {"attr_key": c.key, "attr_type": c.type})
    return out


def decode(logs: DataFrame, columns: list[TypedColumn]) -> DataFrame:
    """Typed columns back as attributes, before those of the JSON list."""
    from ..functions.times import format_canonical
    from ..sources.records import attr

    kinds = {"int64": "I64", "float64": "F64", "bool": "Bool", "string": "Str", "timestamp": "Str"}
    have = [c for c in sorted(columns, key=lambda c: c.column) if c.column in logs.columns]
    value = lambda c: format_canonical(F.col(c.column)) if c.type == "timestamp" else F.col(c.column)
    parts = [F.when(F.col(c.column).isNotNull(), F.array(attr(c.key, kinds[c.type], value(c)))).otherwise(F.array().cast(ATTRIBUTES)) for c in have]
    rest = F.coalesce("attributes", F.array().cast(ATTRIBUTES))
    return logs.withColumn("attributes", F.concat(*parts, rest)).drop(*(c.column for c in have))
