"""Embedding near-dedup by PCA-ordered, tiled comparison.

Equal vectors of one label are one class first, found by 128 bits of hash. The axes are
the principal components (largest second moment first) of a bounded sample of unit
vectors; they only decide the order and the places of the work. Two unit vectors of
cosine >= t are at most e = sqrt(2 - 2 t) apart.

Cells: the leading `depth` axes are cut in two, each near the sample's middle where few
vectors lie, so a vector has a code of `depth` bits, its home. For x and y at most e apart,
the squared distances of x to y's cell and of y to x's cell add up to e^2 at most, as on
each axis that parts them the way over the cut is no longer than x to y. So one of the
two is within e / sqrt(2) of the other's cell and visits it as a guest: homes meet homes
and guests, guests don't meet, and a pair that both cells have is counted in the smaller
one. Depth is chosen for each label by its number of vectors and by the guests that the
sample has at each depth; a label that fits a block has depth 0.

Cells are cut into blocks of about `block` vectors (fewer where vectors are long; guests
four times as many), so a cell that holds a third of all vectors becomes many tiles, each
a task of its own; small cells are packed together. In a tile, 512 rows at a time meet
blocks of the other side. Products are summed over leading dimensions first. What the
rest can add is at most the product of the two suffix norms; pairs whose sum and bound
stay below the threshold are done, a part without any other pair stops, and few survivors
are finished one by one. Pairs within 1e-9 of the threshold are decided by the cosine of
the given components in double precision. A tile returns counts per vector and a forest
of links, never pairs.

Defined results: null vectors, zero vectors, vectors that hold null or non-finite
components, vectors without a label or vec_id link with nothing (n_links 0, component
themselves, kept); vectors of different lengths never link; a repeated row counts as
another vector; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import arrow_map, kept
from .components import components, roots

STEPS = (8, 16, 32)
#: Rows of one side and the other that are compared at a time.
ROWS, COLUMNS = 512, 4096
CLOSE = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def axes(sample: np.ndarray) -> np.ndarray:
    """Columns: directions by falling second moment."""
    if not len(sample):
        return np.eye(sample.shape[1])
    values, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, np.argsort(-values)]


class Side:
    """One side of a comparison, turned to the axes."""

    def __init__(self, x: np.ndarray, basis: np.ndarray):
        d = x.shape[1]
        self.x, self.a = x, unit(x) @ basis
        self.ends = [s for s in STEPS if s < d] + [d]
        square = np.cumsum(self.a[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = [np.sqrt(square[:, e]) if e < d else np.zeros(len(x)) for e in self.ends]

    def part(self, rows: slice) -> Side:
        out = object.__new__(Side)
        out.x, out.a, out.ends, out.rest = self.x[rows], self.a[rows], self.ends, [r[rows] for r in self.rest]
        return out


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of paired rows, in double precision from the components as they are."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    if len(x) and not (np.isfinite(nx).all() and np.isfinite(ny).all() and nx.min() > 1e-150 and ny.min() > 1e-150):
        x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    return np.einsum("nd,nd->n", x, y) / (nx * ny)


def _part_links(x: Side, y: Side, t: float) -> tuple[np.ndarray, np.ndarray]:
    total, begin, d = np.zeros((len(x.x), len(y.x))), 0, x.a.shape[1]
    for end, rx, ry in zip(x.ends, x.rest, y.rest):
        total += x.a[:, begin:end] @ y.a[:, begin:end].T
        begin = end
        i, j = np.nonzero(total + rx[:, None] * ry[None, :] >= t - CLOSE)
        if not len(i):
            return i, j
        if len(i) * (d - end) < total.size * 2:  # few are left: finish them alone
            break
    sums = total[i, j]
    if begin < d:
        for s in range(0, len(i), 65_536):
            e = slice(s, s + 65_536)
            sums[e] += np.einsum("nd,nd->n", x.a[i[e], begin:], y.a[j[e], begin:])
        near = sums >= t - CLOSE
        i, j, sums = i[near], j[near], sums[near]
    link = sums >= t + CLOSE
    for s in range(0, len(unsure := np.flatnonzero(~link)), 65_536):
        e = unsure[s : s + 65_536]
        link[e] = _cosines(x.x[i[e]], y.x[j[e]]) >= t
    return i[link], j[link]


def links(x: Side, y: Side, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs with cosine >= t, part by part."""
    for r in range(0, len(x.x), ROWS):
        for c in range(0, len(y.x), COLUMNS):
            i, j = _part_links(x.part(slice(r, r + ROWS)), y.part(slice(c, c + COLUMNS)), t)
            if len(i):
                yield i + r, j + c


def tile_links(x: np.ndarray, y: np.ndarray, basis: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    found = [(np.zeros(0, np.int64),) * 2, *links(Side(x, basis), Side(y, basis), t)]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


@dataclass
class Frame:
    """Axes, where the leading ones are cut, and how far a guest may be from a cell."""

    basis: np.ndarray
    cuts: np.ndarray
    reach: float

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """Signed distances to the cuts. Sums run in an order that doesn't depend on the
        rows they come with, so that a vector has the same cells wherever this is asked."""
        lead = np.ascontiguousarray(self.basis[:, : len(self.cuts)].T)
        out = [(u[None, :] * lead).sum(1) for u in unit(x)] if len(x) else []
        return np.array(out).reshape(len(x), len(self.cuts)) - self.cuts

    def places(self, x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home code of each row; and (row, code) of the cells that rows visit."""
        off = self.offsets(x)[:, :depth]
        home = (off > 0) @ (1 << np.arange(off.shape[1], dtype=np.int64)) if off.shape[1] else np.zeros(len(x), np.int64)
        row, code, cost = np.arange(len(x)), home.copy(), np.zeros(len(x))
        for k in range(off.shape[1]):
            far = cost + off[row, k] ** 2
            over = far <= self.reach
            row, code, cost = np.concatenate([row, row[over]]), np.concatenate([code, code[over] ^ (1 << k)]), np.concatenate([cost, far[over]])
        return home, row[len(x) :], code[len(x) :]

    def visits(self, off: np.ndarray, own: np.ndarray | int, other: np.ndarray) -> np.ndarray:
        """Whether rows of home `own`, by their offsets, visit the cells `other`."""
        differs = ((own ^ other)[:, None] >> np.arange(off.shape[1])) & 1
        cost = np.zeros(len(off))
        for k in range(off.shape[1]):  # in the order of `places`
            cost = np.where(differs[:, k] == 1, cost + off[:, k] ** 2, cost)
        return cost <= self.reach


def frame(sample: np.ndarray, least: float, depth: int) -> Frame:
    """From unit vectors. A cut is where fewest of the sample are near, between its first
    and third quartile."""
    basis = axes(sample)
    reach = max(0.0, 1 - least) * (1 + 1e-6) + 1e-12  # half of e^2
    near, cuts = np.sqrt(reach), []
    for k in range(min(depth, basis.shape[1])):
        p = np.sort(sample @ basis[:, k])
        at = np.quantile(p, np.linspace(0.25, 0.75, 21)) if len(p) else np.zeros(1)
        beside = np.searchsorted(p, at + near) - np.searchsorted(p, at - near)
        cuts.append(at[int(np.argmin(beside))])
    return Frame(basis, np.array(cuts), reach)


def guests(f: Frame, sample: np.ndarray) -> list[float]:
    """How many cells a vector of the sample visits on average, at each depth."""
    out = [0.0]
    for depth in range(1, len(f.cuts) + 1):
        n = sum(len(f.places(sample[s : s + 100], depth)[1]) for s in range(0, len(sample), 100)) / max(1, len(sample))
        out.append(n)
        if n > 2000:
            break
    return out


def _depth(m, visits: list[float], block: int):
    """The depth of least cost for m vectors, as a column: rows sent and rows compared."""
    costs = []
    for k, c in enumerate(visits):
        homes = m / float(1 << k)
        blocks, parts = F.ceil(homes / block), F.ceil(homes * c / (4 * block))
        costs.append((c * blocks + blocks + parts) * 1e-5 + homes * (0.5 + c) * 5e-9)
    costs = F.array(*(x.cast("double") for x in costs))
    return (F.array_position(costs, F.array_min(costs)) - 1).cast("int")


OUT = "rep long, add long, is_link boolean, to long"


def _tile(table: pa.Table, frames: dict[int, Frame], t: float) -> pa.Table:
    """Of one tile, or several small cells: (vector, number of other vectors it links to
    here, null) and a forest of links as (vector, 0, smaller vector)."""
    label = table.column("label").combine_chunks().dictionary_encode()
    label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy(zero_copy_only=False)
    d, code, home, rep, n, right, depth = (table.column(c).to_numpy() for c in ("d", "code", "home", "rep", "n", "right", "depth"))
    flat = table.column("v").combine_chunks()
    values, ends = flat.flatten().to_numpy().astype(np.float64), np.concatenate([[0], np.cumsum(d)])
    order = np.lexsort((code, d, label))
    change = np.ones(len(order), bool)
    change[1:] = False
    for k in (label, d, code):
        change[1:] |= k[order][1:] != k[order][:-1]
    begins = np.flatnonzero(change)
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    forest: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(a: np.ndarray, b: np.ndarray, own: bool, frame_: Frame, x: np.ndarray) -> None:
        left, other = Side(x[a], frame_.basis), Side(x[b], frame_.basis)
        off = frame_.offsets(x[a])[:, : depth[rows[0]]] if (home[rows[b]] != code[rows[0]]).any() else None
        add, dda = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for i, j in links(left, other, t):
            keep = i < j if own else np.ones(len(i), bool)
            if off is not None:
                here, there = code[rows[0]], home[rows[b[j]]]
                twice = there < here  # the pair is also in the guest's cell, if this row visits that
                twice[twice] = frame_.visits(off[i[twice]], here, there[twice])
                keep &= ~twice
            i, j = i[keep], j[keep]
            add += np.bincount(i, n[rows[b[j]]], len(a)).astype(np.int64)
            dda += np.bincount(j, n[rows[a[i]]], len(b)).astype(np.int64)
            node, root = roots(rep[rows[a[i]]], rep[rows[b[j]]])
            forest.append((node[node != root], root[node != root]))
        counts.append((rep[rows[a]], add))
        counts.append((rep[rows[b]], dda))

    for lo, hi in zip(begins, [*begins[1:], len(order)]):
        rows = order[lo:hi]
        x = np.stack([values[ends[r] : ends[r + 1]] for r in rows])
        f = frames.get(x.shape[1]) or Frame(np.eye(x.shape[1]), np.zeros(0), 0.0)
        at_home, second = home[rows] == code[rows], right[rows]
        first = np.flatnonzero(at_home & ~second)
        if second.any():
            meet(first, np.flatnonzero(second), False, f, x)
        else:
            meet(first, first, True, f, x)
            if len(visitors := np.flatnonzero(~at_home)):
                meet(first, visitors, False, f, x)
    vec, add = (np.concatenate([c[k] for c in counts]) if counts else np.zeros(0, np.int64) for k in (0, 1))
    some = add > 0
    if forest:
        node, root = roots(np.concatenate([a for a, _ in forest]), np.concatenate([b for _, b in forest]))
        node, root = node[node != root], root[node != root]
    else:
        node = root = np.zeros(0, np.int64)
    return pa.table(
        {
            "rep": pa.array(np.concatenate([vec[some], node]), pa.int64()),
            "add": pa.array(np.concatenate([add[some], np.zeros(len(node), np.int64)]), pa.int64()),
            "is_link": pa.array(np.concatenate([np.zeros(some.sum(), bool), np.ones(len(node), bool)])),
            "to": pa.array(np.concatenate([np.full(some.sum(), -1), root]), pa.int64()),
        }
    )


def near_vectors(embeddings: DataFrame, least: float = 0.98, grid: int | None = None, block: int = 4096, sample: int = 20_000, sample_values: int = 1 << 22, axes_most: int = 16, salts: int = 16) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. `grid` fixes the depth."""
    spark = embeddings.sparkSession
    ship(spark)
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    src = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"), F.col("label").alias("label"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda c: c != 0)
    src = src.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("k1", F.xxhash64("label", "v")).withColumn("k2", F.xxhash64(F.lit(7), "label", "v"))
    classes = src.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = kept(classes.withColumn("d", F.size("v")), "vector-classes")

    # what comes to the driver: `sample` rows and `sample_values` components at most
    longest = classes.agg(F.max("d")).first()[0] or 0
    drawn = classes.select("v", "d", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(min(sample, sample_values // max(1, longest))).select("v").toPandas().v
    frames, visits = {}, [0.0]
    for d in sorted(set(map(len, drawn)), key=lambda d: sum(len(x) == d for x in drawn)):
        own = unit(np.stack([np.asarray(x, float) for x in drawn if len(x) == d]))
        frames[d] = frame(own, least, axes_most if grid is None else grid)
        visits = guests(frames[d], own[:1000])  # of the length that most have, at last
    size = F.greatest(F.lit(64), F.least(F.lit(block), F.floor(F.lit(1 << 25) / (8 * F.col("d"))))) if block > 64 else F.lit(block)

    of = classes.groupBy(F.col("label").alias("l"), F.col("d").alias("e")).agg(F.count("*").alias("m"), F.first("d").alias("d"))
    depth = F.lit(grid) if grid is not None else _depth(F.col("m"), visits, block)
    of = of.select("l", "e", depth.cast("int").alias("depth"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    deep = classes.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(salts)))
    deep = deep.join(of, (F.col("label") == F.col("l")) & (F.col("d") == F.col("e")) & (F.col("part") == F.col("salt"))).select("label", "v", "rep", "n", "d", "depth")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                d, depth = b.column(4).to_numpy(), b.column(5).to_numpy()
                x, ends = b.column(1).flatten().to_numpy().astype(float), np.concatenate([[0], np.cumsum(d)])
                home, cells = np.zeros(len(d), np.int64), [np.zeros(0, np.int64)] * len(d)
                for key in set(zip(d, depth)):
                    if key[0] not in frames or key[1] == 0:
                        continue
                    rows = np.flatnonzero((d == key[0]) & (depth == key[1]))
                    mine, row, code = frames[key[0]].places(np.stack([x[ends[r] : ends[r + 1]] for r in rows]), int(key[1]))
                    home[rows] = mine
                    for k, r in enumerate(rows):
                        cells[r] = code[row == k]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(cells, pa.list_(pa.int64()))], [*b.schema.names, "home", "visited"])

    name = classes.schema["label"].dataType.simpleString()
    placed = kept(arrow_map(deep, places, f"label {name}, v {kind}, rep long, n long, d int, depth int, home long, visited array<long>"), "placed")
    cell = ["label", "d", "code"]
    homes = placed.groupBy("label", "d", F.col("home").alias("code")).agg(F.count("*").alias("h"))
    others = placed.select("label", "d", F.explode("visited").alias("code")).groupBy(*(F.col(c).alias(f"{c}_") for c in cell)).agg(F.count("*").alias("g"))
    same = (F.col("label") == F.col("label_")) & (F.col("d") == F.col("d_")) & (F.col("code") == F.col("code_"))
    cells = homes.join(others, same, "left").select(*cell, "h", F.coalesce("g", F.lit(0)).alias("g")).withColumn("b", size)
    cells = cells.select(*(F.col(c).alias(f"{c}_") for c in cell), F.ceil(F.col("h") / F.col("b")).cast("int").alias("hb"), F.ceil(F.col("g") / (4 * F.col("b"))).cast("int").alias("gb"), (F.col("h") + F.col("g")).alias("m"), (F.col("h") + F.col("g") <= F.col("b")).alias("small"), "d")
    cells = kept(cells.where("m > 1"), "cells")
    total = cells.where("small").agg(F.sum(F.col("m") * F.col("d"))).first()[0] or 0
    packs = 1 + total // (1 << 20)
    cells = cells.drop("m", "d")

    rows = placed.select("label", "v", "rep", "n", "d", "depth", "home", F.explode(F.concat(F.array("home"), "visited")).alias("code")).join(cells, same).drop("label_", "d_", "code_")
    h, guest = F.xxhash64("rep"), F.col("home") != F.col("code")
    mine = F.when(F.col("small"), F.lit(0)).when(guest, F.col("hb") + F.pmod(h, F.greatest("gb", F.lit(1)))).otherwise(F.pmod(h, F.greatest("hb", F.lit(1)))).cast("int")
    last = F.when(F.col("small"), F.lit(0)).when(guest, F.col("hb") - 1).otherwise(F.col("hb") + F.col("gb") - 1)
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    i, j, key = F.least("mine", "other"), F.greatest("mine", "other"), F.xxhash64(*cell)
    group = F.when(F.col("small"), F.pmod(key, F.lit(packs))).otherwise(key)
    dealt = dealt.select("small", group.alias("group"), i.alias("i"), j.alias("j"), ((i != j) & (F.col("mine") == j)).alias("right"), "label", "d", "depth", "code", "home", "rep", "n", "v")

    def compare(table: pa.Table) -> pa.Table:
        return _tile(table, frames, least)

    found = kept(dealt.groupBy("small", "group", "i", "j").applyInArrow(compare, OUT), "tile-links")
    linked = found.where("not is_link").groupBy("rep").agg(F.sum("add").alias("others"))
    comp = components(found.where("is_link").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    of = classes.select("k1", "k2", "rep", "n").join(linked.withColumnRenamed("rep", "r1"), F.col("rep") == F.col("r1"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    of = of.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")).where("n_links > 0")
    # rows meet their class in parts, as a vector may come very often; those that meet none link with nothing
    of = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = F.col("good") & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")) & (F.pmod(F.xxhash64("vec_id"), F.lit(salts)) == F.col("salt"))
    out = src.select("vec_id", "good", "k1", "k2").join(of, same, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))

