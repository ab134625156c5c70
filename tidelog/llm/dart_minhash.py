"""MinHash near-dedup with DartMinHash signatures.

A document is the weighted set of its five-word shingles (weight 1 each; with
weighting="count" their number). Darts are thrown at the plane of weight and rank: for
each element and each dyadic strip of weights there is a Poisson process along the rank
axis, made from hashes of element, strip and dart number alone, so all documents see
the same darts. A dart that lands below the element's weight hits; its hash names one of
the signature's coordinates, and the hit of lowest rank keeps the coordinate. Ranks are
followed only as far as the document's total weight needs, about k ln k + 2 k hits a
signature in all, whatever the document's length; a coordinate still empty doubles the
distance. Two signatures agree in a coordinate with the probability of the weighted
Jaccard similarity.

Search: documents of equal words are one class first (its smallest doc_id stands for
it). Signatures are banded and joined on the buckets; 40 bands of 6 rows miss a pair of
similarity 0.8 with probability (1 - 0.8^6)^40 = 5e-6. Buckets of equal members are one.
Each member is compared with the smallest of its bucket, which takes one row a member;
what that links is a component, and a bucket whose members are one component is done.
In the others only pairs of different components are left: the members outside the
bucket's largest component are compared with all, in tiles. A bucket that has very many
of those holds strangers with a passage in common; it is dealt out first, by the shingles
that lead each member's set, rarest first. A pair of similarity t has t of the larger set
and 2t / (1 + t) of the smaller one in common, so the first shingle in common is among the
leading 1 - t of the one and 1 - 2t / (1 + t) of the other: each pair that is sought meets
again, whatever its bucket's size, and strangers mostly don't. What meets is tiled.

A tile has at most about `block` documents and 4 MB of shingles a side (or one document),
and small tiles are packed by bytes. It counts the common shingles of all its pairs as
products of matrices and decides by their exact share, as the comparison with the smallest
does, so it does not matter which of the two a pair meets in. It returns a forest of links,
never pairs.

Defined results: words are runs of anything but ASCII white space; a text of one to
four words has one shingle, all its words; null and empty texts have none and stay
alone; rows with one doc_id are one document; rows without a doc_id stay alone with a
null class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_map, by_weight, kept
from .components import components, roots

_word = re.compile(WORD)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: document number, 64-bit shingle hash (sorted by both, without
    repeats) and how often the document has the shingle."""
    return _shingles([_word.findall(t) for t in texts], width)


def _shingles(found: list[list[str]], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seen: dict[str, int] = {}
    own, hashes = [], []
    for i, words in enumerate(found):
        if not words:
            continue
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
        h = np.array([seen[w] for w in words], np.uint64)
        if len(h) >= width:
            n = len(h) - width + 1
            s = np.zeros(n, np.uint64)
            for k in range(width):
                s = mixed(s + h[k : k + n] + np.uint64(k + 1))
        else:
            s = np.zeros(1, np.uint64)
            for k in range(len(h)):
                s = mixed(s + h[k : k + 1] + np.uint64(k + 101))
        hashes.append(s)
        own.append(np.full(len(s), i, np.int64))
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc, h = np.concatenate(own), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    at = np.flatnonzero(first)
    return doc[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = 128) -> np.ndarray:
    """(docs, k) of uint64; rows of documents without elements are zero."""
    out = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weight, docs)
    reach = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    # dyadic strips [0,1), [1,2), [2,4), ... below each element's weight
    most = int(np.ceil(np.log2(max(1.0, weight.max(initial=1)))))
    strips = [(0.0, 1.0)] + [(2.0**s, 2.0**s) for s in range(most)]
    while todo.any():
        flats, ranks, darts = [], [], []
        best = np.full(docs * k, np.inf)
        for s, (low, width) in enumerate(strips):
            i = np.flatnonzero(todo[doc] & (weight > low))
            seed = mixed(element[i] + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            at, far, base, j = np.zeros(len(i)), reach[doc[i]], doc[i] * k, 0
            whole = low + width <= weight.min(initial=np.inf)  # no dart of the strip can be above an element
            while len(i):
                j += 1
                h = mixed(seed + np.uint64(j * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
                at = at - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width
                on = at <= far
                if not on.all():
                    i, seed, at, far, base, h = i[on], seed[on], at[on], far[on], base[on], h[on]
                g = mixed(h ^ np.uint64(0xA0761D6478BD642F))
                flat, rank = base + (g % np.uint64(k)).astype(np.int64), at
                if not whole:
                    hit = low + width * ((g >> np.uint64(40)).astype(np.float64) / 2.0**24) < weight[i]
                    flat, rank, g = flat[hit], at[hit], g[hit]
                np.minimum.at(best, flat, rank)
                flats.append(flat)
                ranks.append(rank)
                darts.append(g)
        flat, rank, dart = np.concatenate(flats), np.concatenate(ranks), np.concatenate(darts)
        first = rank == best[flat]
        here = np.zeros(docs * k, np.uint64)
        np.maximum.at(here, flat[first], dart[first])  # of equal ranks the larger dart
        hit = np.isfinite(best)
        full = hit.reshape(docs, k).all(1) & todo
        out[full] = here.reshape(docs, k)[full]
        todo &= ~full
        reach = reach * 2
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(docs, bands) of int64."""
    n, k = signatures.shape
    keys = np.broadcast_to(np.arange(k // rows, dtype=np.uint64), (n, k // rows)).copy()
    for r in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + signatures[:, r::rows])
    return keys.view(np.int64)


def _chunks(b: pa.RecordBatch, limit: int = 200_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of consecutive rows of about `limit` bytes; no more become Python
    objects at a time."""
    sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
    for s in by_weight(sizes, limit):
        part = b.slice(s.start, s.stop - s.start)
        yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def sketches(docs: DataFrame, bands: int, rows: int, weighting: str) -> DataFrame:
    """doc_id, words (a 128-bit hash of the word sequence; null without words), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _chunks(b):
                found = [_word.findall(t) for t in texts]
                doc, h, n = _shingles(found)
                sig = dart_signatures(doc, h, n.astype(float) if weighting == "count" else np.ones(len(n)), len(texts), bands * rows)
                keys = band_keys(sig, rows)
                words = [" ".join(w) for w in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([hashlib.blake2b(w.encode(), digest_size=16).digest() if w else None for w in words], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.reshape(-1))),
                    ],
                    ["doc_id", "words", "bands"],
                )

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, words binary, bands array<long>")


def members(docs: DataFrame, weighting: str) -> DataFrame:
    """doc_id, sorted shingle hashes, their weights, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _chunks(b):
                doc, h, n = shingles(texts)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                sets = [h[i:j].tobytes() for i, j in zip(cut, cut[1:])]
                many = [n[i:j].astype(np.int32).tobytes() if weighting == "count" else None for i, j in zip(cut, cut[1:])]
                size = np.diff(cut) * (12 if weighting == "count" else 8)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary()), pa.array(many, pa.binary()), pa.array(size, pa.int64())], ["doc_id", "s", "n", "bytes"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, s binary, n binary, bytes long")


def _weights(sets: list[bytes], many: list[bytes | None]) -> list[np.ndarray]:
    return [np.ones(len(s) // 8, np.int64) if n is None else np.frombuffer(n, np.int32).astype(np.int64) for s, n in zip(sets, many)]


def similarities(pivot: tuple[bytes, bytes | None], sets: list[bytes], many: list[bytes | None]) -> np.ndarray:
    """Of one document's shingles and weights with those of each other, exactly."""
    p, (wp,) = np.frombuffer(pivot[0], np.uint64), _weights([pivot[0]], [pivot[1]])
    own = np.repeat(np.arange(len(sets)), [len(s) // 8 for s in sets])
    x, wx = np.frombuffer(b"".join(sets), np.uint64), np.concatenate(_weights(sets, many))
    at = np.minimum(np.searchsorted(p, x), len(p) - 1)
    hit = p[at] == x
    low = np.bincount(own[hit], np.minimum(wp[at[hit]], wx[hit]), len(sets))
    return low / np.maximum(1, wp.sum() + np.bincount(own, wx, len(sets)) - low)


def similarity(s1: bytes, n1: bytes | None, s2: bytes, n2: bytes | None) -> float:
    return float(similarities((s1, n1), [s2], [n2])[0])


def _elements(s: bytes, n: bytes | None) -> np.ndarray:
    """A document's shingles; those it counts more than once are as many elements."""
    x = np.frombuffer(s, np.uint64)
    if n is None:
        return x
    w = np.frombuffer(n, np.int32)
    nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    x = np.repeat(x, w)
    return np.where(nth > 0, mixed(x + nth.astype(np.uint64)), x)


def in_common(left: list[np.ndarray], right: list[np.ndarray] | None = None, step: int = 2048) -> np.ndarray:
    """How many elements each set of left shares with each of right, or of left itself:
    products of 0/1 matrices over the elements that more than one set holds."""
    sides = [left] if right is None else [left, right]
    own, x = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in sides], [np.concatenate(s) for s in sides]
    if right is None:
        values, many = np.unique(x[0], return_counts=True)
        both = values[many > 1]
    else:
        both = np.intersect1d(*x)
    out = np.zeros((len(sides[0]), len(sides[-1])))
    if not len(both):
        return out
    cells = []
    for o, v in zip(own, x):
        at = np.minimum(np.searchsorted(both, v), len(both) - 1)
        on = np.flatnonzero(both[at] == v)
        on = on[np.argsort(at[on], kind="stable")]
        cells.append((o[on], at[on]))
    for start in range(0, len(both), step):
        ones = []
        for side, (o, at) in zip(sides, cells):
            lo, hi = np.searchsorted(at, (start, start + step))
            m = np.zeros((len(side), min(step, len(both) - start)), np.float32)
            m[o[lo:hi], at[lo:hi] - start] = 1
            ones.append(m)
        out += ones[0] @ ones[-1].T
    return out


def tile_links(left: pd.DataFrame, right: pd.DataFrame | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and roots of the links between different components (column comp) of a
    tile; without `right`, of left with itself."""
    sides = [left] if right is None else [left, right]
    sets = [[_elements(s, n) for s, n in zip(f.s, f.n)] for f in sides]
    low, size = in_common(*sets), [np.array([len(x) for x in v]) for v in sets]
    near = low / np.maximum(1, size[0][:, None] + size[-1][None, :] - low) >= least
    near &= sides[0].comp.to_numpy()[:, None] != sides[-1].comp.to_numpy()[None, :]
    i, j = np.nonzero(np.triu(near, 1) if right is None else near)
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return roots(sides[0].doc_id.to_numpy()[i], sides[-1].doc_id.to_numpy()[j])


LINKS = "a long, b long"


def _forest(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    node, root = roots(np.concatenate([a for a, _ in found]).astype(np.int64), np.concatenate([b for _, b in found]).astype(np.int64))
    return pd.DataFrame({"a": node[node != root], "b": root[node != root]})


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by keys, the first one leading, and where each run of equal ones begins and the last ends."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    return order, np.append(np.flatnonzero(change), len(order))


#: Bytes of shingles in a side of a tile, and in a pack of small tiles.
SIDE, PACK = 1 << 22, 1 << 23


#: Counts by which shingles are ordered; several shingles share one.
SLOTS = 1 << 16


def _slot_counts(mem: DataFrame) -> np.ndarray:
    """How many elements of members fall into each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(SLOTS, np.int64)
        for b in batches:
            for s, n in zip(b.column(0), b.column(1)):
                out += np.bincount((_elements(s.as_py(), n.as_py()) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["slot", "n"])

    found = arrow_map(mem.select("s", "n"), run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def leading(x: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """The elements of a set, rarest first, one of which is the first in common with any
    set of similarity `least`; and how many of them do if that set is not smaller."""
    n = len(x)
    long, short = (min(n, n - int(np.ceil(share * n - 1e-6)) + 1) for share in (least, 2 * least / (1 + least)))
    return x[np.lexsort((x, counts[(x % np.uint64(SLOTS)).astype(np.int64)]))[:long]], short


def _met_again(hot: DataFrame, mem: DataFrame, least: float) -> DataFrame:
    """Members of large buckets (key, doc_id, comp) by bucket and leading shingle."""
    ids = kept(hot.select(F.col("doc_id").alias("id")).distinct(), "hot-ids")
    mem = kept(mem.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "s", "n"), "hot-members")
    counts = _slot_counts(mem)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_weight(pc.binary_length(b.column(1)).to_pylist(), SIDE):
                ids, lead, small = [], [], []
                for i in range(part.start, part.stop):
                    x, short = leading(_elements(b.column(1)[i].as_py(), b.column(2)[i].as_py()), counts, least)
                    ids.append(np.full(len(x), b.column(0)[i].as_py(), np.int64))
                    lead.append(x.view(np.int64))
                    small.append(np.arange(len(x)) < short)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (ids, lead, small)], ["id", "lead", "small"])

    each = kept(arrow_map(mem, run, "id long, lead long, small boolean"), "leading")
    shared = kept(each.groupBy("lead").agg(F.count("*").alias("m"), F.max("small").alias("small")).where("m > 1 and small").select("lead"), "shared-leading")
    each = each.select("id", "lead").join(shared, "lead")
    return hot.select("key", "doc_id", "comp").join(each, F.col("doc_id") == F.col("id")).select(F.xxhash64("key", "lead").alias("key"), "doc_id", "comp").distinct()


def _blocks(rows, size, block: int):
    return F.ceil(F.greatest(rows / block, size / SIDE)).cast("int")


def _packs(per: DataFrame, one: str, block: int) -> int:
    """How many packs the small tiles fill, by bytes and by rows (m)."""
    size, rows = per.where(one).agg(F.sum("bytes"), F.sum("m")).first()
    return 1 + max((size or 0) // PACK, (rows or 0) // block)


def _star_links(pairs: DataFrame, mem: DataFrame, least: float, block: int) -> DataFrame:
    """Links of pairs (low, doc_id), each low with all its doc_ids."""
    size = mem.groupBy("doc_id").agg(F.sum("bytes").alias("bytes"))
    per = pairs.join(size, "doc_id").groupBy("low").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    per = kept(per.withColumn("blocks", _blocks(F.col("m"), F.col("bytes"), block)), "star-sizes")
    packs = _packs(per, "blocks = 1", block)
    sub = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    others = pairs.join(per.select(F.col("low").alias("p"), "blocks"), F.col("low") == F.col("p")).select("low", "doc_id", "blocks", sub.alias("sub"), F.lit(False).alias("pivot"))
    pivots = per.select("low", F.col("low").alias("doc_id"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("sub"), F.lit(True).alias("pivot"))
    dealt = others.unionByName(pivots).join(mem.select(F.col("doc_id").alias("d"), "s", "n"), F.col("doc_id") == F.col("d")).drop("d")
    group = F.when(F.col("blocks") > 1, F.col("low")).otherwise(-1 - F.pmod(F.xxhash64("low"), F.lit(packs)))
    dealt = dealt.select(group.alias("group"), F.when(F.col("blocks") > 1, F.col("sub")).otherwise(0).alias("part"), "low", "sub", "pivot", "doc_id", "s", "n")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, s, n, pivot = (pdf[c].to_numpy() for c in ("doc_id", "s", "n", "pivot"))
        order, ends = _runs(pdf["low"].to_numpy(), pdf["sub"].to_numpy())
        found = []
        for lo, hi in zip(ends, ends[1:]):
            rows = order[lo:hi]
            for p in rows[pivot[rows]]:  # more than one only where rows share a doc_id
                o = rows[~pivot[rows]]
                o = o[similarities((s[p], n[p]), list(s[o]), list(n[o])) >= least] if len(o) else o
                found.append((np.full(len(o), doc[p]), doc[o]))
        return _forest(found)

    return dealt.groupBy("group", "part").applyInPandas(compare, LINKS)


def _tile_links(rest: DataFrame, per: DataFrame, mem: DataFrame, least: float, block: int) -> DataFrame:
    """Links between different components of rest (key, doc_id, comp, major), whose
    blocks of minor and major members are in per (key, nb, mb, m, bytes)."""
    per = per.withColumn("one", (F.col("nb") + F.col("mb") <= 2) & (F.col("bytes") <= SIDE))
    packs = _packs(per, "one", block)
    dealt = rest.join(per.select(F.col("key").alias("k"), "nb", "mb", "one"), F.col("key") == F.col("k")).drop("k")
    h = F.xxhash64("doc_id")
    mine = F.when(F.col("one"), F.lit(0)).when(F.col("major"), F.col("nb") + F.pmod(h, F.greatest("mb", F.lit(1)))).otherwise(F.pmod(h, F.greatest("nb", F.lit(1)))).cast("int")
    dealt = dealt.withColumn("mine", mine)
    last = F.when(F.col("one"), F.lit(0)).when(F.col("major"), F.col("nb") - 1).otherwise(F.col("nb") + F.col("mb") - 1)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    group = F.when(F.col("one"), F.pmod(F.xxhash64("key"), F.lit(packs))).otherwise(F.col("key"))
    dealt = dealt.select(F.col("one"), group.alias("group"), i.alias("i"), j.alias("j"), ((i != j) & (F.col("mine") == j)).alias("right"), "key", "comp", "doc_id")
    dealt = dealt.join(mem.select(F.col("doc_id").alias("d"), "s", "n"), F.col("doc_id") == F.col("d")).drop("d")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        order, ends = _runs(pdf["key"].to_numpy())
        found = []
        for lo, hi in zip(ends, ends[1:]):
            part = pdf.iloc[order[lo:hi]]
            on = part["right"].to_numpy()
            if not on.all():
                found.append(tile_links(part[~on], part[on] if on.any() else None, least))
        return _forest(found)

    return dealt.groupBy("one", "group", "i", "j").applyInPandas(compare, LINKS)


def _links(reps: DataFrame, docs: DataFrame, least: float, weighting: str, block: int) -> DataFrame:
    """Links (a, b) that connect what pairs of reps (doc_id, bands) of similarity
    `least` connect, if they share a bucket."""
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("high > low").select("key")
    met = kept(keys.join(shared, "key").select("key", "doc_id", F.col("doc_id").alias("comp")).distinct(), "met")
    ids = kept(met.select(F.col("doc_id").alias("id")).distinct(), "ids")  # written first: while small it is sent to the texts, not they to it
    mem = kept(members(docs.join(ids, F.col("doc_id").cast("long") == F.col("id"), "left_semi"), weighting).dropDuplicates(["doc_id", "s"]), "members")
    links: list[DataFrame] = []
    for level in range(2):
        h, h2 = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(level))
        same = met.groupBy("key").agg(F.count("*").alias("m"), F.min("doc_id").alias("low"), F.bit_xor(h).alias("x"), F.bit_xor(h2).alias("y"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min_by("comp", "doc_id").alias("c0"))
        same = same.where("m > 1 and c1 <> c2").groupBy("m", "low", "c0", "x", "y").agg(F.min("key").alias("k")).drop("x", "y")
        met = kept(met.join(same, F.col("key") == F.col("k")).drop("k"), "buckets")
        links.append(kept(_star_links(met.where("comp <> c0").select("low", "doc_id").distinct(), mem, least, block), "star-links"))
        comp = components(reduce(DataFrame.unionByName, links))
        known = met.where("m > 2").drop("comp").join(comp, F.col("doc_id") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("node", "component")
        known = kept(known.join(mem.groupBy(F.col("doc_id").alias("d")).agg(F.sum("bytes").alias("bytes")), F.col("doc_id") == F.col("d")).drop("d"), "known")
        each = known.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes"))
        per = each.groupBy("key").agg(F.max(F.struct("c", "bytes", "comp")).alias("top"), F.sum("c").alias("m"), F.sum("bytes").alias("bytes"), F.count("*").alias("comps")).where("comps > 1")
        alone = F.col("top.c") == 1  # then no component is larger than another: all are minor
        c, size = F.when(alone, 0).otherwise(F.col("top.c")), F.when(alone, 0).otherwise(F.col("top.bytes"))
        per = per.select("key", F.when(~alone, F.col("top.comp")).alias("top"), "m", "bytes", _blocks(F.col("m") - c, F.col("bytes") - size, block).alias("nb"), _blocks(c, size, block).alias("mb"))
        per = kept(per, "left-over")
        rest = known.join(per.select(F.col("key").alias("k"), "top", "nb"), F.col("key") == F.col("k")).drop("k")
        rest = rest.withColumn("major", F.coalesce(F.col("comp") == F.col("top"), F.lit(False)))
        hot = F.col("nb") > 4 if level == 0 else F.lit(False)
        links.append(kept(_tile_links(rest.where(~hot).drop("nb"), per.where(~hot), mem, least, block), "tile-links"))
        if level == 1 or not per.where(hot).limit(1).count():
            break
        met = kept(_met_again(rest.where(hot), mem, least), "met-again")
    return reduce(DataFrame.unionByName, links)


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 40, rows: int = 6, weighting: str = "set", block: int = 256, salts: int = 16) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id that links lead to,
    itself included), kept (doc_id = class_id)."""
    sk = kept(sketches(docs, bands, rows, weighting), "sketches")
    classes = kept(sk.where("words is not null and doc_id is not null").groupBy("words").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = sk.where("words is not null").join(classes.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", "bands")
    comp = components(_links(reps, docs, least, weighting, block))
    # a text may have very many copies: its rows meet their class in `salts` parts
    of = classes.join(comp, F.col("rep") == F.col("node"), "left").select(F.col("words").alias("w"), F.coalesce("component", "rep").alias("class_id"), "rep", "copies")
    of = of.where("copies > 1 or class_id <> rep").select("w", "class_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    own = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    out = sk.select("doc_id", "words").join(of, (F.col("words") == F.col("w")) & (own == F.col("salt")), "left")
    out = out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id")))


def deduplicated(docs: DataFrame, least: float = 0.8, bands: int = 40, rows: int = 6, weighting: str = "set") -> DataFrame:
    """The documents, all their columns, without those that near_duplicates doesn't
    keep; rows of equal doc_id and text are one."""
    gone = near_duplicates(docs, least, bands, rows, weighting).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = kept(gone, "gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").dropDuplicates(["doc_id", "text"])
