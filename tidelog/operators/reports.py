"""Reports over a store's files: what windows would read, and what the bytes are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(files: DataFrame) -> DataFrame:
    """One row: files, rows, and how much of the whole time range a file covers (median,
    mean, most)."""
    every = Window.partitionBy()
    span = (F.max("max_ts").over(every) - F.min("min_ts").over(every)).cast("double")
    each = files.withColumn("__c", (F.col("max_ts") - F.col("min_ts")) / span)
    return each.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.median("__c").alias("median"), F.avg("__c").alias("mean"), F.max("__c").alias("most"))


def prune_analysis(files: DataFrame, windows_ns: list[int], trials: int = 24) -> DataFrame:
    """Per window: the shares of files and of rows that it reads, over `trials` starts spread
    evenly. A row a file is all there is, and each meets the starts as literals."""
    low, high, n, rows = files.agg(F.min("min_ts"), F.max("max_ts"), F.count("*"), F.sum("rows")).first()
    starts = [(low or 0) + ((high or 0) - (low or 0)) * i // trials for i in range(trials)]
    hits = [sum((((F.col("max_ts") >= s) & (F.col("min_ts") <= s + w)).cast("long") for s in starts), F.lit(0)) for w in windows_ns]
    each = files.select("rows", F.explode(F.array(*(F.struct(F.lit(w).alias("window_ns"), h.alias("hits")) for w, h in zip(windows_ns, hits)))).alias("x"))
    whole = float(trials)
    return each.groupBy(F.col("x.window_ns").alias("window_ns")).agg((F.sum("x.hits") / (whole * (n or 1))).alias("files_read"), (F.sum(F.col("x.hits") * F.col("rows")) / (whole * (rows or 1))).alias("rows_read"))


def space(logs: DataFrame, stored_bytes: int) -> DataFrame:
    """Bytes of the raw lines and of the store, per record and against each other."""
    raw = logs.agg(F.count("*").alias("records"), F.sum(F.octet_length("body") + 1).alias("raw_bytes"))
    b = F.lit(stored_bytes)
    return raw.withColumn("stored_bytes", b.cast("long")).withColumn("raw_per_record", F.col("raw_bytes") / F.col("records")).withColumn("stored_per_record", b / F.col("records")).withColumn("ratio", F.col("raw_bytes") / b)


def column_shares(columns: DataFrame, records: int) -> DataFrame:
    """Of store.column_sizes(): each column's share of the bytes, and bytes a record."""
    whole = F.sum("bytes").over(Window.partitionBy())
    return columns.withColumn("share", F.col("bytes") / whole).withColumn("per_record", F.col("bytes") / records)
