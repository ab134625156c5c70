"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measured over the whole text: lengths, letter case, symbols, digits,
repetition of words, word triples and lines, sentence ends. Each is cut into quantile
bins. Cyclic boosting visits one feature after another and fits a tree of at most three
leaves on its bins to the logistic gradient; the steps add up to one lookup table a
feature. Then the pairs of features whose residual gain is largest get tables too, from
trees of four leaves. A document's score is the sigmoid of the intercept and the table
entries of its bins, added up in numpy.

Fitting takes at most `fit_rows` labelled rows (those with the smallest xxhash64 of
doc_id) whose crc32(doc_id) mod 4 is not 2; that sample is what comes to the driver, and
its ids are broadcast. doc_id, lang, source and labels are no features.

Defined results: a null text is an empty one and is scored like any text; a doc_id that
is labelled more than once has its smallest label, null labels count as none; null
doc_ids are not held out; repeated rows pass through, one row out per row in. Without
labels every score is 0.5; with labels of one kind only, all scores are the smoothed
share. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import arrow_map, let_go

FEATURES = ["log_words", "word_length", "longest_word", "upper", "symbols", "digits", "distinct_words", "top_word", "repeats", "triples", "lines_repeated", "odd_ends", "sentence_ends", "line_ends", "bars", "shouted"]
_symbols = re.compile(r"[^\w\s.,;:!?'\"()-]")
_odd = re.compile(r"[^\w\s.,;:!?'\")]+(?=\s|$)|[!?]{2,}(?=\s|$)")
_ends = re.compile(r"[.!?](?=\s|$)")


def _numbered(text: str, step: int = 1 << 20) -> tuple[np.ndarray, list[str]]:
    """The words as numbers, and the distinct words; no more than about `step` characters
    are cut into words at a time."""
    known: dict[str, int] = {}
    parts, start = [], 0
    while start < len(text):
        end = min(len(text), start + step)
        while end < len(text) and not text[end].isspace():
            end += 1
        parts.append(np.array([known.setdefault(w, len(known)) for w in text[start:end].split()], np.int64))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), list(known)


def _distinct_triples(ids: np.ndarray, words: int) -> int:
    if words < 1 << 21:
        return len(np.unique((ids[:-2] * words + ids[1:-1]) * words + ids[2:]))
    return len(np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1).T)


def _matches(pattern: re.Pattern, text: str) -> int:
    return sum(1 for _ in pattern.finditer(text))


def features(text: str) -> list[float]:
    """The measures of FEATURES. Beside the text itself they take some bytes a word."""
    ids, distinct = _numbered(text)
    n, chars = len(ids), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(ids)
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    loud = np.fromiter((len(w) > 1 and w.isupper() for w in distinct), bool, len(distinct))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = int((counts * lengths).sum())
    upper = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    return [
        float(np.log1p(n)),
        letters / n,
        float(np.log1p(lengths.max())),
        upper / letters,
        _matches(_symbols, text) / chars,
        sum(map(text.count, "0123456789")) / chars,
        len(distinct) / n,
        float(counts.max()) / n,
        float((ids[1:] == ids[:-1]).sum()) / n,
        _distinct_triples(ids, len(distinct)) / (n - 2) if n > 2 else 1.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        _matches(_odd, text) / n,
        _matches(_ends, text) / n,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines) if lines else 0.0,
        text.count("|") / n,
        float(counts[loud].sum()) / n,
    ]


@dataclass
class Gam:
    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # which coarse bin each bin is in
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        if self.cuts and len(x):
            b = self.bins(x)
            for f, t in enumerate(self.tables):
                z += t[b[f]]
            for f, g, t in self.pairs:
                z += t[self.coarse[f][b[f]], self.coarse[g][b[g]]]
        return 1 / (1 + np.exp(-z))


def _leaf(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g / (h + l2)


def _line_tree(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> np.ndarray:
    """Step per bin: the best tree of up to three leaves over ordered bins."""
    parts, out = [(0, len(g))], np.zeros(len(g))

    def best(lo: int, hi: int) -> tuple[float, int]:
        cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(cg):
            return 0.0, lo
        tg, th = g[lo:hi].sum(), h[lo:hi].sum()
        gain = cg**2 / (ch + l2) + (tg - cg) ** 2 / (th - ch + l2) - tg**2 / (th + l2)
        gain[(ch < least) | (th - ch < least)] = 0
        k = int(np.argmax(gain))
        return float(gain[k]), lo + k + 1

    for _ in range(2):
        gain, at, i = max((*best(*p), i) for i, p in enumerate(parts))
        if gain <= 1e-12:
            break
        lo, hi = parts.pop(i)
        parts += [(lo, at), (at, hi)]
    for lo, hi in parts:
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum(), l2)
    return out


def _square_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and step of the best four-leaf tree: one cut on each side of a bin square."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    quads = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    quads.append((cg[-1, -1] - a - quads[1][0] - quads[2][0], ch[-1, -1] - b - quads[1][1] - quads[2][1]))
    gain = sum(x**2 / (y + l2) for x, y in quads) - cg[-1, -1] ** 2 / (ch[-1, -1] + l2)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    for k, (rows, cols) in enumerate([(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]):
        out[rows, cols] = _leaf(quads[k][0][i, j], quads[k][1][i, j], l2)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, most_bins: int = 32, pairs: int = 8, pair_rounds: int = 60, l2: float = 1.0) -> Gam:
    if not len(y):
        return Gam(0.0)
    p = (y.sum() + 0.5) / (len(y) + 1)
    m = Gam(float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return m
    m.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, most_bins + 1)[1:-1])) for c in x.T]
    bins = m.bins(x)
    sizes = [len(c) + 1 for c in m.cuts]
    m.tables = [np.zeros(s) for s in sizes]
    m.coarse = [np.arange(s) * 8 // s if s > 8 else np.arange(s) for s in sizes]
    z = np.full(len(y), m.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for f, b in enumerate(bins):
            g, h = gradient()
            step = rate * _line_tree(np.bincount(b, g, sizes[f]), np.bincount(b, h, sizes[f]), l2, 1e-3)
            m.tables[f] += step
            z += step[b]
    small = [c[b] for c, b in zip(m.coarse, bins)]
    width = [int(c.max()) + 1 for c in m.coarse]

    def square(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradient()
        at, n = small[a] * width[b] + small[b], width[a] * width[b]
        return np.bincount(at, g, n).reshape(width[a], width[b]), np.bincount(at, h, n).reshape(width[a], width[b])

    ranked = sorted(((_square_tree(*square(a, b), l2)[0], a, b) for a in range(len(bins)) for b in range(a) if width[a] > 1 and width[b] > 1), reverse=True)
    m.pairs = [(a, b, np.zeros((width[a], width[b]))) for _, a, b in ranked[:pairs]]
    for _ in range(pair_rounds):
        for a, b, t in m.pairs:
            step = rate * _square_tree(*square(a, b), l2)[1]
            t += step
            z += step[small[a], small[b]]
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


def _measured(batches: Iterator[pa.RecordBatch], then) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        x = np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES))
        yield then(b, x)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Gam:
    """The model of at most fit_rows labelled documents that are not held out."""
    got = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    got = got.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _measured(batches, lambda b, x: pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"]))

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(got), "id").select("id", "label", "text")
    rows = sorted({(r[0], r[1], tuple(r[2])) for r in arrow_map(rows, run, "id long, label int, x array<double>").collect()})
    return fit(np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float))


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.7, fit_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _measured(batches, lambda b, x: pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(x))], [*b.schema.names[:-1], "score"]))

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("__text"))
    out = arrow_map(src, run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.7, fit_rows: int = 20_000) -> DataFrame:
    """The documents, all their columns, that the classifier doesn't reject."""
    model = train(docs, labels, fit_rows)

    def score(texts: pa.Array) -> pa.Array:
        let_go()
        found = [np.zeros(0)]
        for at in range(0, len(texts), 1000):  # few texts become Python objects at a time
            x = [features(t or "") for t in texts.slice(at, 1000).to_pylist()]
            found.append(model.score(np.array(x, float).reshape(-1, len(FEATURES))))
        return pa.array(np.concatenate(found))

    ship(docs.sparkSession)
    return docs.where(F.arrow_udf(score, "double")("text") >= least)
