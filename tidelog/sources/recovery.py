"""Getting a store back: from content-addressed parts, from an older layout, from its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary
from ..operators.typed import PREFIX, TYPES, TypedColumn
from . import store
from .records import attr_of_json


def restore(spark: SparkSession, source: str, target: str, inventory: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Parts under `source` that verify (name, hash, and size and rows where the inventory
    (name, size, rows) knows them) are placed in the store at `target`, which must be empty
    unless forced, under the event hour and level of their records. A row per part: name and
    verdict, restored for those that were placed. A second run replaces what the first wrote."""
    if not force and store._globbed(spark, f"{target}/tenant=*"):
        raise ValueError(f"{target} holds a store already")
    have = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source)
    known = inventory if inventory is not None else have.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.lit(None).cast("long").alias("rows"))
    judged = store.verified(spark, source, known)
    good = F.col("verdict").isin("ok", "unexpected")
    rows = spark.read.schema(store.STORED).option("pathGlobFilter", "*.parquet").parquet(source)
    rows = rows.withColumn("__part", F.element_at(F.split("_metadata.file_path", "/"), -1)).join(judged.where(good).select("name"), F.col("__part") == F.col("name"), "left_semi").drop("__part")
    store.write(rows.withColumn("attributes", attr_of_json(F.col("attributes"))), target, batch="restored")
    return judged.select("name", F.when(good, "restored").otherwise(F.col("verdict")).alias("verdict"))


def rebuilt_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Sightings of each template by service, as the stored records have them; a body is the
    best name a shape has when its text is lost."""
    logs = store.read(spark, path, []).where("template_id is not null")
    seen = dictionary.sightings(logs)
    names = logs.groupBy("template_id").agg(F.min_by("body", F.struct("observed_ns", "event_id")).alias("text"))
    return seen.join(names, "template_id")


def rebuilt_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, list[TypedColumn]]:
    """Files with their partition and size, with rows and clock bounds of the partition
    from footers, and the typed columns that files hold; those are registered again."""
    files = store.listing(spark, path)
    bounds = store.footers(spark, path).collect()  # a row a partition
    per = spark.createDataFrame([tuple(r) for r in bounds], store.footers(spark, path).schema) if bounds else None
    found = []
    for f in store.read(spark, path).schema:
        if f.name.startswith(PREFIX):
            kind = f.metadata.get("attr_type") or next(k for k, t in TYPES.items() if t == f.dataType.simpleString())
            found.append(TypedColumn(f.name, f.metadata.get("attr_key", f.name.removeprefix(PREFIX)), kind, ""))
    if found:
        store.register(spark, path, found)
    return (files.join(per, store.PATH, "left") if per is not None else files), found


def migrate(old: DataFrame, counters: DataFrame, target: str) -> dict[str, int]:
    """Records of an older layout, whose template ids are counters, go to the store at
    `target` under content hashes (counters: counter, template_id; a counter that is not
    known becomes null) and their own event hour. What moved, and what lost its id."""
    ids = old.where("template_id is not null")
    report = {"rows": old.count(), "unknown_ids": ids.join(counters, ids["template_id"] == counters["counter"], "left_anti").count()}
    store.write(dictionary.rekeyed(old, counters), target, batch="migrated")
    return report


def write_manifests(spark: SparkSession, path: str) -> None:
    """The files of each day, beside the store, for readers that can't list it."""
    days = store.listing(spark, path).withColumn("day", F.substring("hour", 1, 10))
    days.repartition("day").sortWithinPartitions("day", "path").write.mode("overwrite").partitionBy("day").parquet(f"{path}/_manifests")


def manifest(spark: SparkSession, path: str, day: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_manifests/day={day}")
