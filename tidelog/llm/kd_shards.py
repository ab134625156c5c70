"""Sharding by a k-d tree over metadata, in DataFrame operations only.

The dimensions are metadata of a text, all free of its language: the binary logarithms of
its UTF-8 bytes, of its words and of its bytes a line, and the shares of digits and of
spaces among its bytes, in whole steps of 2^-20 (2^-30 for shares). Equal texts have equal
coordinates, so no split parts them. A node is split along its widest dimension, widths
being taken relative to the whole table's, at the weighted median: the value up to which
the bytes come nearest the left part's share. Where the values on that median are too heavy
and the split misses its share by more than `tolerance` of the node, the next widest
dimension is tried, at last 33 bits of the text's xxhash64, which part texts that agree in
all metadata; the best split holds, of equal ones the first. Splitting goes on until leaves
reach the target bytes, total over `shards`; a node that holds an odd number of shards is
split in proportion.

Medians are distributed: one row per level and node with the extents, then histograms
of 2^11 bins a digit, three digits for the 33 bits of a coordinate, summed by partial
aggregation. What comes to the driver is bounded: 2^11 sums per node, 2^11 * shards in
all. Slots are numbered by hash buckets, so no task numbers a whole shard.

One text that outweighs a shard makes its leaf larger than the others; it is not split,
as equal texts stay together.

Defined results: a null text has size 1 and the checksum of the empty text; null or
repeated doc_ids pass through, one row out per row in; an empty table gives an empty
result; other columns of the input are ignored; ties in doc_id are numbered in an
arbitrary order among equal rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, running_totals, words_in

DIGIT = 11


@dataclass
class Node:
    first: int  # of its shards
    shards: int
    where: list[tuple[int, bool, int]]  # (dimension, goes left, limit) from the root


def _in(nodes: list[Node], dims: list[str]) -> Column:
    """Which of the nodes a row is in; null: in none."""
    out = F.lit(None).cast("int")
    for k, n in enumerate(nodes):
        test = F.lit(True)
        for d, left, limit in n.where:
            test = test & (F.col(dims[d]) <= limit if left else F.col(dims[d]) > limit)
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def _extents(points: DataFrame, nodes: list[Node], dims: list[str]) -> dict[int, tuple]:
    aggs = [f(d) for d in dims for f in (F.min, F.max)]
    rows = points.withColumn("n", _in(nodes, dims)).where("n is not null").groupBy("n").agg(F.sum("w"), *aggs).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def _cuts(points: DataFrame, nodes: list[Node], dims: list[str], axis: dict[int, int], want: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Per node the value of its axis up to which the weight comes nearest `want`, and
    by how much it misses. Both sides keep rows, unless the node has one value only."""
    value = F.lit(None).cast("long")
    for k, d in axis.items():
        value = F.when(F.col("n") == k, F.col(dims[d])).otherwise(value)
    rows = points.withColumn("n", _in(nodes, dims)).withColumn("v", value).where("v is not null").select("n", "v", "w")
    prefix, before, below = dict.fromkeys(axis, 0), dict.fromkeys(axis, 0), dict.fromkeys(axis, -1)
    out = {}
    for digit in (2, 1, 0):
        mine = F.lit(False)
        for k in axis:
            mine = mine | ((F.col("n") == k) & (F.shiftright("v", DIGIT * (digit + 1)) == prefix[k]))
        low = F.col("v").bitwiseAND((1 << DIGIT * digit) - 1)
        bins = rows.where(mine).groupBy("n", F.shiftright("v", DIGIT * digit).bitwiseAND((1 << DIGIT) - 1).alias("b")).agg(F.sum("w"), F.max(low))
        found = sorted(tuple(r) for r in bins.collect())
        for k in axis:
            own = [x[1:] for x in found if x[0] == k]
            for b, w, top in own:
                if before[k] + w >= want[k] or b == own[-1][0]:
                    if digit == 0:
                        at, over = prefix[k] << DIGIT | b, before[k] + w - want[k]
                        under = want[k] - before[k]
                        out[k] = (below[k], under) if below[k] >= 0 and under < over else (at, abs(over))
                    prefix[k] = prefix[k] << DIGIT | b
                    break
                before[k] += w
                below[k] = (prefix[k] << DIGIT | b) << DIGIT * digit | top
    return out


def kd_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.005) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    log = lambda x: F.floor(F.log2(x.cast("double")) * (1 << 20)).cast("long")
    share = lambda n: F.floor(n.cast("double") / size * (1 << 30)).cast("long")
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    digits = F.octet_length(text) - F.octet_length(F.translate(text, "0123456789", ""))
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    metadata = [log(size).alias("wide"), log(words_in(text) + 1).alias("words"), log(size / lines).alias("long"), share(digits).alias("digits"), share(spaces).alias("spaces"), F.shiftrightunsigned(F.xxhash64(text), 31).alias("finger")]
    points = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("w"), F.crc32(text).cast("long").alias("crc"), *metadata), "kd-points")
    dims = ["wide", "words", "long", "digits", "spaces", "finger"]
    nodes, leaves = [Node(0, shards, [])], []
    root: tuple = ()
    while nodes:
        open_ = [n for n in nodes if n.shards > 1]
        leaves += [n for n in nodes if n.shards == 1]
        if not open_:
            break
        spread = _extents(points, open_, dims)
        root = root or spread.get(0, ())
        cut: dict[int, tuple[int, int]] = {}
        axis, tries, want = {}, {}, {}
        for k, (total, *mm) in spread.items():
            width = [(mm[2 * i + 1] - mm[2 * i]) / max(1, root[2 * i + 2] - root[2 * i + 1]) for i in range(len(dims))]
            tries[k] = [*sorted(range(len(dims) - 1), key=lambda i: -width[i]), len(dims) - 1]
            want[k] = -(-total * (open_[k].shards // 2) // open_[k].shards)
        for turn in range(len(dims)):  # the next widest only where the median's values are too heavy
            again = {k: t[turn] for k, t in tries.items() if k not in cut or cut[k][1] > tolerance * spread[k][0]}
            for k, found in (_cuts(points, open_, dims, again, want) if again else {}).items():
                if k not in cut or found[1] < cut[k][1]:
                    cut[k], axis[k] = found, again[k]
        nodes = []
        for k, n in enumerate(open_):
            left = n.shards // 2
            if k not in cut:  # no rows: nothing to split
                leaves.append(Node(n.first, 1, n.where))
                continue
            nodes += [Node(n.first, left, [*n.where, (axis[k], True, cut[k][0])]), Node(n.first + left, n.shards - left, [*n.where, (axis[k], False, cut[k][0])])]
    leaves.sort(key=lambda n: n.first)
    out = points.withColumn("leaf", _in(leaves, dims))
    shard = F.lit(None).cast("int")
    for k, n in enumerate(leaves):
        shard = F.when(F.col("leaf") == k, F.lit(n.first)).otherwise(shard)
    out = out.withColumn("shard", shard).withColumn("one", F.lit(1))
    out = running_totals(out, "shard", "doc_id", "one", "slot")
    return out.select(
        "doc_id", F.col("w").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
