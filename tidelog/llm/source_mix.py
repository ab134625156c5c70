"""Mixing sources to target weights, in DataFrame operations only.

Targets: sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3 and so on and
share all words; a target stops at `most` times its source's words and the excess is
shared again by weight, which is the level at which the capped shares add up.

Schedule: slot j of `slots` is the golden-ratio point frac(j * 0.618...), computed in
64-bit integers; the point falls into one source's interval of the cumulative targets,
found through a grid of cells and an equal join. A source's slots are ranked (counts
per run of slots first, so that no task ranks a whole source). A source's documents in
hash order, repeated up to `most` times, are cut into blocks of equal words, and block r
is joined to the slot of rank r; a block may end one pass and begin the next. What a
document gives is the sum of its overlaps with joined blocks. `block` is the words of the
table over `slots`, rounded up, and there are as many slots as whole blocks in all words,
so the schedule keeps its size at any scale. The slots are an order and not an amount: a
source takes round(target) words exactly, however long a block is. Slots past its last
block are left out, blocks without a slot come after the last slot, and the last block
is cut.

Defined results: a null text has size 0; null sources are one source, the last; sources
without words have target 0; documents of size 0 take 0; null or repeated doc_ids pass
through, one row out per row in; an empty table gives an empty result; other columns of
the input are ignored. Runs agree: the order is by xxhash64 of doc_id, then doc_id,
then size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, running_totals, words_in

#: floor(2^63 / golden ratio): steps of the schedule, in units of 2^-63.
GOLDEN = 5_700_357_409_661_599_241


def _words() -> Column:
    return F.coalesce(words_in(F.col("text")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = 3, cycle: int = 3) -> DataFrame:
    """One row per source: source, source_size, weight, target, low, high (its interval
    of the cumulative targets, as shares). The windows run over sources, not rows."""
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    named = every.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", (F.row_number().over(named) - 1) % cycle + 1)
    by = by.withColumn("total", F.sum("source_size").over(every)).withColumn("cap", F.col("source_size") * most)
    full = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(full), F.lit(0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0))
    # the level is right at the first source, by fullness, that stays under its cap
    by = by.withColumn("level", left.cast("double") / heavy)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("f"), F.col("source").isNull().alias("n"), "source", "level"))
    by = by.withColumn("level", F.min(fits).over(every)["level"])
    by = by.withColumn("target", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))))
    run = named.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = F.sum("target").over(run)
    by = by.withColumn("high", high).withColumn("low", F.col("high") - F.col("target"))
    whole = F.greatest(F.max("high").over(every), F.lit(1.0))
    return by.withColumn("low", F.col("low") / whole).withColumn("high", F.col("high") / whole).select("source", "source_size", "weight", "total", "target", "low", "high")


def ranked_slots(sources: DataFrame, slots: int, cells: int = 4096, run: int = 4096) -> DataFrame:
    """The schedule: slot, source, rank (from 0 within the source)."""
    spark = sources.sparkSession
    point = F.expr(f"cast(pmod(cast(id as decimal(38,0)) * {GOLDEN}, cast(9223372036854775808 as decimal(38,0))) as double) / 9223372036854775808D")
    s = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1)).cast("int"))
    end = F.lit(cells - 1)
    span = F.sequence(F.least(F.floor(F.col("low") * cells), end).cast("int"), F.least(F.floor(F.col("high") * cells), end).cast("int"))
    last = F.max("high").over(Window.partitionBy(F.lit(0)))
    near = sources.where("high > low").withColumn("high", F.when(F.col("high") == last, F.lit(2.0)).otherwise(F.col("high")))
    near = near.select("source", "low", "high", F.explode(span).alias("cell"))
    got = s.join(near, "cell").where("u >= low and u < high").select("slot", "source", F.floor(F.col("slot") / run).alias("run"))
    per = got.groupBy("source", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "run").orderBy("slot")
    got = got.withColumn("k", F.row_number().over(inside) - 1)
    return got.join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r"))).select("slot", "source", (F.col("base") + F.col("k")).alias("rank"))


def _shares(docs: DataFrame, slots: int, most: int) -> DataFrame:
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _words().alias("size"))
    sizes = kept(sizes, "mix-sizes")
    sources = kept(targets(sizes, most), "mix-sources")
    total = sources.agg(F.max("total")).first()[0] or 0
    block = max(1, -(-total // slots))
    ranked = kept(ranked_slots(sources, total // block).select("slot", F.col("source").alias("s"), F.col("rank").cast("long").alias("rank")), "mix-slots")
    ranks = ranked.groupBy("s").agg((F.max("rank") + 1).alias("ranks"))
    whole = lambda c: F.call_function("div", c, F.lit(block).cast("long"))
    about = sources.withColumn("wanted", F.round("target").cast("long")).withColumn("blocks", whole(F.col("wanted") + block - 1))
    # blocks that the schedule has no slot for follow its last slot
    rest = about.join(ranks, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("ranks", F.coalesce("ranks", F.lit(0))).where("ranks < blocks")
    rest = rest.select(F.lit(None).cast("long").alias("slot"), F.col("source").alias("s"), F.explode(F.sequence("ranks", F.col("blocks") - 1)).alias("rank"))
    ranked = ranked.unionByName(rest)
    about = about.select(F.col("source").alias("of"), "source_size", "target", "wanted", "blocks")
    placed = kept(running_totals(sizes, "source", "doc_id", "size", "begin", about=about), "mix-placed")

    # a document's stretch of words in each pass over its source, and the blocks it meets
    times = placed.where("size > 0").select("source", "begin", "size", "wanted", "blocks", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: p * F.col("source_size") + F.col("begin"))).alias("at"))
    met = times.where("at < wanted").withColumn("first", whole(F.col("at")))
    met = met.withColumn("block", F.explode(F.sequence("first", F.least(whole(F.col("at") + F.col("size") - 1), F.col("blocks") - 1))))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block, F.col("wanted")) - F.greatest(F.col("at"), F.col("block") * block)
    joined = met.join(ranked, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("rank")))
    # where a document begins names it within its source
    taken = joined.groupBy(F.col("source").alias("s"), F.col("begin").alias("b")).agg(F.sum(words).alias("taken"))
    mine = F.col("source").eqNullSafe(F.col("s")) & (F.col("begin") == F.col("b")) & (F.col("size") > 0)
    return placed.join(taken, mine, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, slots: int = 1 << 18, most: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return _shares(docs, slots, most).drop("source")


def mixed_documents(docs: DataFrame, slots: int = 1 << 18, most: int = 3) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is
    taken, and one with its first words where a part of it is taken (words are then
    joined by single spaces, and n_chars, if there, is the part's). Rows that share
    doc_id, source and size share their words evenly, rounded down."""
    keys = ["doc_id", "source", "size"]
    got = _shares(docs, slots, most).groupBy(*keys).agg(F.floor(F.sum("taken") / F.count("*")).alias("taken")).where("taken > 0")
    got = got.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("taken").alias("__taken"))
    rows = docs.withColumn("__words", _words())
    same = rows["doc_id"].cast("long").eqNullSafe(got["__doc_id"]) & rows["source"].cast("string").eqNullSafe(got["__source"]) & (rows["__words"] == got["__size"])
    rows = rows.join(got, same)
    times = F.ceil(F.col("__taken") / F.col("__words")).cast("int")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), times)))
    rest = F.least(F.col("__words"), F.col("__taken") - (F.col("__copy") - 1) * F.col("__words")).cast("int")
    part = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, rest), " ")
    rows = rows.withColumn("__cut", rest < F.col("__words")).withColumn("text", F.when(F.col("__cut"), part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
