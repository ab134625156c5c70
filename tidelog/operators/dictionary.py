"""Template dictionary: sightings, shapes, and what they join to."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = ["tenant", "index"]


def sightings(logs: DataFrame) -> DataFrame:
    """(tenant, index, template_id, service) to rows and the bounds of `observed`. Records
    without a template are left out, those without a service are a group."""
    by = logs.where("template_id is not null").groupBy(*SCOPE, "template_id", "service")
    return by.agg(F.count("*").alias("rows"), F.min("observed_ns").alias("first_ns"), F.max("observed_ns").alias("last_ns"))


def merged_sightings(*parts: DataFrame) -> DataFrame:
    """Sightings of several writers or batches as one."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*SCOPE, "template_id", "service").agg(F.sum("rows").alias("rows"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))


def shapes(mined: DataFrame, order: list[str]) -> DataFrame:
    """template_id to its first text and lineage; `collisions` counts further texts."""
    at = F.struct(*order)
    return mined.where("template_id is not null").groupBy("template_id").agg(
        F.min_by("template", at).alias("text"), F.min_by("lineage_id", at).alias("lineage_id"), (F.countDistinct("template") - 1).alias("collisions")
    )


def dictionary(seen: DataFrame, shape: DataFrame) -> DataFrame:
    return seen.join(shape.select("template_id", "text", "lineage_id"), "template_id").select(*SCOPE, "template_id", "service", "text", F.col("rows").alias("count"), "first_ns", "last_ns", "lineage_id")


def scopes(entries: DataFrame) -> DataFrame:
    return entries.select(*SCOPE).distinct()


def shape_history(seen: DataFrame, shape: DataFrame) -> DataFrame:
    """Per scope and template, over services, with its lineage."""
    by = dictionary(seen, shape).groupBy(*SCOPE, "lineage_id", "template_id", "text")
    return by.agg(F.sum("count").alias("count"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))


def named(logs: DataFrame, entries: DataFrame) -> DataFrame:
    """Logs with the dictionary's text: equal template, scope, and service or none."""
    e = entries.select(*(F.col(c).alias(f"e_{c}") for c in [*SCOPE, "template_id", "service"]), "text")
    on = F.col("service").eqNullSafe(F.col("e_service"))
    for c in [*SCOPE, "template_id"]:
        on = on & (F.col(c) == F.col(f"e_{c}"))
    return logs.join(e, on).drop(*(f"e_{c}" for c in [*SCOPE, "template_id", "service"]))


def by_lineage(logs: DataFrame, history: DataFrame) -> DataFrame:
    h = history.select("template_id", "lineage_id").distinct()
    return logs.join(h, "template_id").groupBy("lineage_id").agg(F.count("*").alias("n"))


def rekeyed(logs: DataFrame, counters: DataFrame) -> DataFrame:
    """Counter ids to content hashes; an unknown counter has no template."""
    c = counters.select(F.col("counter"), F.col("template_id").alias("hash"))
    return logs.join(c, logs["template_id"] == c["counter"], "left").drop("counter", "template_id").withColumnRenamed("hash", "template_id")


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row over two releases' (template_id, lineage_id, n): shapes that are new,
    shapes whose lineage is known under another id, and the rows on either."""
    old = before.select("template_id").distinct().withColumn("known", F.lit(True))
    lines = before.select("lineage_id").distinct().withColumn("line", F.lit(True))
    a = after.join(old, "template_id", "left").join(lines, "lineage_id", "left")
    new = F.col("known").isNull() & F.col("line").isNull()
    wide = F.col("known").isNull() & F.col("line").isNotNull()
    zero = F.lit(0)
    return a.agg(
        F.count_if(new).alias("new"),
        F.count_if(wide).alias("widened"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), zero).alias("events_on_changed"),
        F.coalesce(F.sum("n"), zero).alias("events"),
    )


def export(entries: DataFrame, path: str) -> None:
    """Writes a dictionary or history, a folder for each scope, in place of the last one."""
    entries.repartition(*SCOPE).write.mode("overwrite").partitionBy(*SCOPE).parquet(path)


def lineage_links(old: DataFrame, new: DataFrame, least: float = 0.6) -> DataFrame:
    """For each new template the retired one of most similar text, if similar enough. Both
    are lists of one release's changes; pairs meet through a word they share."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    words = lambda c: F.explode(F.array_distinct(F.split(c, " ")))
    a = old.select(F.col("template").alias("was"), words(F.col("template")).alias("w"))
    b = new.select(F.col("template").alias("now"), words(F.col("template")).alias("w"))
    scored = a.join(b, "w").select("was", "now").distinct().withColumn("ratio", ratio("was", "now")).where(F.col("ratio") >= least)
    return scored.groupBy("now").agg(F.max(F.struct("ratio", "was")).alias("best")).select("now", F.col("best.was").alias("was"), F.col("best.ratio").alias("ratio"))
