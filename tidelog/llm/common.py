"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import discard, forget_at_exit, kept, scratch_path
from ..shipping import ship

__all__ = ["WORD", "arrow_map", "by_weight", "discard", "forget_at_exit", "held_by", "kept", "let_go", "running_totals", "scratch_path", "table", "words_in"]

#: A word, everywhere in this package: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """The number of words of a text; null for null."""
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "a"), r"[\x20\x09-\x0D]+", "")).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What operators hold in this worker from task to task: by owner, how to drop it.
_held: dict[str, Callable[[], None]] = {}


def held_by(owner: str, drop: Callable[[], None]) -> None:
    _held[owner] = drop


def let_go(owner: str = "") -> None:
    """Drop what operators other than `owner` hold in this worker. Spark uses workers again
    for whatever runs next, which has no use for it but is counted with it."""
    others = [o for o in _held if o != owner]
    for other in others:
        _held.pop(other)()
    if others:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)


def arrow_map(df: DataFrame, run: Callable, schema: str, rows: int = 1000, owner: str = "") -> DataFrame:
    """mapInArrow with this package on the workers' path. Spark bounds its batches by bytes;
    `run` gets them in slices of at most `rows` rows, so that few texts become Python
    objects at a time. What a worker holds of other owners is dropped first."""
    ship(df.sparkSession)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, max(1, b.num_rows), rows):
                yield b.slice(at, rows)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(owner)
        yield from run(slices(batches))
        pa.default_memory_pool().release_unused()  # workers are used again: give it back

    return df.mapInArrow(lean, schema)


def by_weight(sizes: Sequence[int], limit: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to at most limit, or hold one item."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield slice(start, len(sizes))


def running_totals(df: DataFrame, group: str, order: str, weight: str, before: str, buckets: int = 1024, about: DataFrame | None = None) -> DataFrame:
    """Adds `before`: the sum of `weight` over the rows of the same group that come
    earlier by (hash of `order`, `order`, weight), and the columns of `about`, a row for
    each group in its column `of`. A group may hold most rows: sums are taken in hash
    buckets first and rows meet them by group and bucket, so no task sees a whole group."""
    df = df.withColumn("__h", F.xxhash64(F.col(order))).withColumn("__b", F.pmod(F.col("__h"), F.lit(buckets)).cast("int"))
    sums = df.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__gb")).agg(F.sum(weight).alias("__w"))
    earlier = Window.partitionBy("__g").orderBy("__gb").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__w").over(earlier), F.lit(0))).drop("__w")
    if about is not None:
        sums = sums.join(about, F.col("__g").eqNullSafe(F.col("of")), "left").drop("of")
    inside = Window.partitionBy(group, "__b").orderBy("__h", order, weight).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = df.join(sums, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__gb")), "left")
    return joined.withColumn(before, (F.col("__base") + F.col("__in")).cast("long")).drop("__h", "__b", "__g", "__gb", "__base", "__in")
