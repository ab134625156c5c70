"""The store: Parquet files under tenant, index, hour, level and node.

Writes that carry a batch name can be repeated: files are staged and moved in under names
that begin with it, and what an earlier try left is removed first. Compaction stages its
files, writes down what it is about to swap, moves the new files in and then removes the
old ones; `recover` finishes a swap that was cut short, so a crash leaves rows twice for a
while but never loses any. Staged files are in a folder that readers don't look into."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import policy
from ..operators import scan as scans
from ..operators.scan import IN_FILE, PATH, Query
from ..operators.typed import TYPES, TypedColumn, encode
from .records import RECORD, attr_json, with_partitions

STORED = T.StructType([T.StructField("attributes", T.StringType()) if f.name == "attributes" else f for f in RECORD])
PARTITIONS = T.StructType([T.StructField(c, T.StringType()) for c in PATH])
STAGING = "_staging"
CLOCKS = ["timestamp_ns", "observed_ns"]


# --- files -----------------------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the class of its paths."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def _globbed(spark: SparkSession, pattern: str) -> list[str]:
    fs, path = _hadoop(spark, pattern)
    return [x.getPath().toString() for x in fs.globStatus(path(pattern)) or []]


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        fs, path = _hadoop(spark, p)
        fs.delete(path(p), True)


def _write_text(spark: SparkSession, target: str, text: str) -> None:
    fs, path = _hadoop(spark, target)
    out = fs.create(path(target), True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, source: str) -> str:
    fs, path = _hadoop(spark, source)
    stream = fs.open(path(source))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _moves(spark: SparkSession, staged: str, root: str, prefix: str) -> list[tuple[str, str]]:
    """From and to of each staged file: its partition's folder, a name of its own."""
    found = sorted(_globbed(spark, f"{staged}/{'/'.join('*' * len(PATH))}/*.parquet"))
    return [(f, "/".join([root, *f.split("/")[-1 - len(PATH) : -1], f"{prefix}{i:05d}.parquet"])) for i, f in enumerate(found)]


def _move(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Again as often as one likes: what is gone from `staged` has been moved."""
    for source, target in moves:
        fs, path = _hadoop(spark, target)
        if fs.exists(path(source)):
            fs.mkdirs(path(target).getParent())
            if not fs.rename(path(source), path(target)):
                raise OSError(f"{target} can't be put in place")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of each file, with its partition; no file is opened."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    got = got.select("path", F.col("length").alias("bytes"), F.unix_seconds("modificationTime").alias("written_secs"))
    return got.withColumn("k", policy.key_of_path(F.col("path"))).select("path", "bytes", "written_secs", "k.*")


# --- writing ---------------------------------------------------------------------------


def _sorted(rows: DataFrame, *spread: Column) -> DataFrame:
    return rows.repartition(*PATH, *spread).sortWithinPartitions(*PATH, *(F.col(c).asc_nulls_first() for c in IN_FILE))


def _save(rows: DataFrame, path: str, mode: str, **more: object) -> None:
    writer = rows.write.mode(mode).partitionBy(*PATH)
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.bloom.filter.enabled#trace_id": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": 16 << 20}
    for k, v in (options | {f"parquet.enable.dictionary#{c}": "false" for c in CLOCKS} | more).items():
        writer = writer.option(k, str(v))
    writer.parquet(path)


def write(logs: DataFrame, path: str, columns: list[TypedColumn] = [], mode: str = "append", tenant: str = "default", index: str = "main", node: str = "n0", batch: str | None = None) -> None:  # noqa: B006
    """Writes records, sorted in each file, to their event hours. Rows are dealt out by
    partition and then by service, so an hour that holds a third of all rows is written
    by several tasks. Clocks are delta-encoded, traces get a bloom filter as large as a file's
    traces need. A write that
    names its `batch` replaces what an earlier one of that name has written."""
    out = encode(with_partitions(logs, tenant, index, node), columns) if columns else with_partitions(logs, tenant, index, node)
    out = out.withColumn("attributes", attr_json(F.col("attributes")))
    out = out.select(*STORED.names, *(c for c in out.columns if c not in STORED.names))  # clocks in one place in every file
    out = _sorted(out, F.pmod(F.xxhash64("service"), F.lit(8)))
    if batch is None:
        return _save(out, path, mode)
    spark = logs.sparkSession
    staged = f"{path}/{STAGING}/{batch}"
    _save(out, staged, "overwrite")
    _remove(spark, _globbed(spark, f"{path}/{'/'.join('*' * len(PATH))}/{batch}-*.parquet"))
    _move(spark, _moves(spark, staged, path, f"{batch}-"))
    _remove(spark, [staged])


# --- reading ---------------------------------------------------------------------------


def read(spark: SparkSession, path: str, columns: list[TypedColumn] | None = None) -> DataFrame:
    """All files, columns united by name; the path's columns are text. Side files with
    other extensions are left out. With `columns` (or `registry(...)`) no file is opened for
    its schema; without, every footer is."""
    if columns is None:
        found = spark.read.option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path).schema
        extra = [f for f in found if f.name not in STORED.names]
    else:
        extra = [T.StructField(c.column, T._parse_datatype_string(TYPES[c.type])) for c in sorted(columns, key=lambda c: c.column)]
    return spark.read.schema(T.StructType([*STORED, *extra, *PARTITIONS])).option("pathGlobFilter", "*.parquet").parquet(path)


def register(spark: SparkSession, path: str, columns: list[TypedColumn]) -> None:
    """Keeps the typed columns beside the store; columns once there stay."""
    known = {c.column: c for c in [*columns, *registry(spark, path)]}
    _write_text(spark, f"{path}/_typed_columns.json", json.dumps([vars(known[c]) for c in sorted(known)]))


def registry(spark: SparkSession, path: str) -> list[TypedColumn]:
    if not _globbed(spark, f"{path}/_typed_columns.json"):
        return []
    return [TypedColumn(**c) for c in json.loads(_read_text(spark, f"{path}/_typed_columns.json"))]


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each partition: rows and the bounds of both clocks, from the footers of its
    files; no row is read. Spark pushes these aggregates into its newer Parquet source,
    which a session of its own asks for."""
    own = spark.newSession()
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    rows = own.read.schema(T.StructType([*STORED, *PARTITIONS])).option("pathGlobFilter", "*.parquet").parquet(path)
    bounds = [f(c).alias(f"{n}_{a}") for c, a in zip(CLOCKS, ("ts", "observed")) for f, n in ((F.min, "min"), (F.max, "max"))]
    return rows.groupBy(*PATH).agg(F.count("*").alias("rows"), *bounds)


def newest_hours(spark: SparkSession, path: str, q: Query, columns: list[TypedColumn] | None = None) -> str | None:
    """The oldest hour that a limited scan needs. Hours are counted newest first, in runs
    that double, until the limit is met; footers say which hours have rows at all."""
    have = footers(spark, path).where(scans.hour_range(q) & scans.partition_filter(q)).groupBy("hour").agg(F.sum("rows").alias("n")).orderBy(F.desc("hour")).collect()  # a row an hour
    logs, found, at, run = read(spark, path, columns), 0, 0, 1
    while at < len(have):
        hours = [r["hour"] for r in have[at : at + run]]
        part = scans.matches(logs.where(F.col("hour").between(hours[-1], hours[0])), q)
        found += part.limit(max(1, q.limit) - found).count()
        if found >= max(1, q.limit):
            return hours[-1]
        at, run = at + run, run * 2
    return have[-1]["hour"] if have else None


def scan(spark: SparkSession, path: str, q: Query, columns: list[TypedColumn] | None = None) -> DataFrame:
    """A limited scan that opens no hour older than it needs."""
    logs, since = read(spark, path, columns), newest_hours(spark, path, q, columns)
    return scans.scan(logs.where(F.col("hour") >= since) if since else logs.limit(0), q)


def files(logs: DataFrame) -> DataFrame:
    """A row for each file that was read: path, size, rows, bounds of both clocks."""
    m = F.col("_metadata")
    return logs.groupBy(*PATH, m["file_path"].alias("path"), m["file_size"].alias("bytes"), F.unix_seconds(m["file_modification_time"]).alias("written_secs")).agg(
        F.count("*").alias("rows"), F.min("timestamp_ns").alias("min_ts"), F.max("timestamp_ns").alias("max_ts"), F.min("observed_ns").alias("min_observed"), F.max("observed_ns").alias("max_observed")
    )


# --- upkeep ----------------------------------------------------------------------------


def rewrite(spark: SparkSession, path: str, target: str, hours: list[str] | None = None, rows_per_file: int = 4_000_000, columns: list[TypedColumn] | None = None) -> None:
    """The partitions (all, or those hours) as few sorted files at another place."""
    logs = read(spark, path, columns)
    logs = logs.where(F.col("hour").isin(hours)) if hours else logs
    _save(_sorted(logs), target, "overwrite", maxRecordsPerFile=rows_per_file)


def compact(spark: SparkSession, path: str, now_secs: int, columns: list[TypedColumn] | None = None, **limits: int) -> int:
    """Rewrites the small files of quiet partitions (see policy.compactable) as one file
    each; how many files it replaced. What is chosen is bounded by the plan's limits."""
    recover(spark, path)
    old = [r["path"] for r in policy.compactable(listing(spark, path), now_secs, **limits).select("path").collect()]
    if not old:
        return 0
    name = f"c{uuid.uuid4().hex[:12]}"
    staged = f"{path}/{STAGING}/{name}"
    schema = read(spark, path, columns).schema
    _save(_sorted(spark.read.schema(schema).option("basePath", path).parquet(*old)), staged, "overwrite")
    swap = {"moves": _moves(spark, staged, path, f"{name}-"), "old": old, "staged": staged}
    _write_text(spark, f"{path}/{STAGING}/{name}.swap.json", json.dumps(swap))
    recover(spark, path)
    return len(old)


def recover(spark: SparkSession, path: str) -> int:
    """Finishes the swaps that are written down; how many there were."""
    found = _globbed(spark, f"{path}/{STAGING}/*.swap.json")
    for note in found:
        swap = json.loads(_read_text(spark, note))
        _move(spark, swap["moves"])
        _remove(spark, [*swap["old"], swap["staged"], note])
    return len(found)


def maintain(spark: SparkSession, path: str, now_secs: int, budget: int = 0, columns: list[TypedColumn] | None = None, buckets=policy.DEFAULT_BUCKETS, **limits: int) -> dict[str, int]:
    """One pass: unfinished swaps, then what retention and, under pressure, the disk budget
    let go, then compaction. The paths that go come to the driver, which deletes them."""
    done = {"recovered": recover(spark, path)}
    have = listing(spark, path).join(footers_of(spark, path), PATH, "left")
    gone = [r["path"] for r in policy.impact(have, now_secs, budget, buckets).select("path").collect()]
    _remove(spark, gone)
    return done | {"deleted": len(gone), "compacted": compact(spark, path, now_secs, columns, **limits)}


def footers_of(spark: SparkSession, path: str) -> DataFrame:
    """Partitions with their oldest record, in the given session."""
    rows = footers(spark, path).select(*PATH, "min_ts").collect()  # a row a partition
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join([*(f"{c} string" for c in PATH), "min_ts long"]))


def verified(spark: SparkSession, path: str, inventory: DataFrame) -> DataFrame:
    """Content-addressed parts against an inventory (name, size, rows): verdict per name.
    Hashes are taken by Spark's binary source."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    have = listing.select(F.element_at(F.split("path", "/"), -1).alias("have"), F.col("length").alias("found_size"), F.sha2("content", 256).alias("hash"))
    rows = spark.read.parquet(path).groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("counted")).agg(F.count("*").alias("found_rows"))
    have = have.join(rows, F.col("have") == F.col("counted"), "left").drop("counted")
    both = inventory.join(have, F.col("name") == F.col("have"), "full_outer")
    wrong = F.concat(F.col("hash"), F.lit(".parquet")) != F.col("have")
    verdict = F.when(F.col("have").isNull(), "missing").when(F.col("name").isNull(), "unexpected").when(wrong, "wrong_hash").when(F.col("size") != F.col("found_size"), "wrong_size")
    return both.select(F.coalesce("name", "have").alias("name"), verdict.when(F.col("rows") != F.coalesce("found_rows", F.lit(0)), "wrong_rows").otherwise("ok").alias("verdict"))


def late(logs: DataFrame, now_ns: int, threshold_secs: int = 7200) -> DataFrame:
    """Adds `late`: the record is older than the threshold and waits in the slow spool."""
    return logs.withColumn("late", F.col("timestamp_ns") < now_ns - threshold_secs * 1_000_000_000)


def column_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Compressed bytes per column, largest first, summed over the files' footers. Footers
    are read from the bytes that Spark's binary source gives."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pyarrow.parquet as pq

        for pdf in batches:
            rows = []
            for content in pdf.content:
                m = pq.ParquetFile(io.BytesIO(content)).metadata
                for g in range(m.num_row_groups):
                    group = m.row_group(g)
                    rows += [(group.column(c).path_in_schema, group.column(c).total_compressed_size) for c in range(group.num_columns)]
            yield pd.DataFrame(rows, columns=["column", "bytes"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("content")
    return content.mapInPandas(run, "column string, bytes long").groupBy("column").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "column")
