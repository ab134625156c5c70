"""Near-dedup, classifier, mixing, sharding, components and the pipeline: brute force."""

from __future__ import annotations

import math
import random
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import dart_minhash as dm
from tidelog.llm import gam_quality, pca_dedup
from tidelog.llm.components import components, roots
from tidelog.llm.kd_shards import kd_shards
from tidelog.llm.source_mix import mix, mixed_documents, targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, cluster long, rep long, words long, w long, n long, taken int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", 5, 5, 6, 8, 9, 1) for i, t, s in rows], DOCS)


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 470)]
    want = union_find(471, pairs)
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: want[n] for n in {x for p in pairs for x in p if p[0] != p[1]}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    node, root = roots(*map(np.array, zip(*pairs)))
    assert [want[n] for n in node] == list(root)


def shingle_set(text, width=5):
    words = (text or "").split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def corpus(seed=1, n=120):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([8, 30, 150, 400]))]
        rows.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 6, 20])):
                copy[r.randrange(len(copy))] = f"w{r.randrange(3000)}"
            rows.append(" ".join(copy))
    return rows


def test_near_duplicates_against_all_pairs(spark):
    texts = corpus() + ["", None, "", "one two", "one  two", "one two three", "same words " * 4000, "same words " * 4000 + "x"]
    rows = [(10 * i + 3, t, None) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    want = union_find(len(sets), pairs)
    for block in (256, 5):
        got = {r.doc_id: r for r in dm.near_duplicates(docs(spark, rows), block=block).collect()}
        assert [got[10 * i + 3].class_id for i in range(len(sets))] == [10 * w + 3 for w in want]
        assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_near_duplicates_odd_tables(spark):
    assert dm.near_duplicates(docs(spark, []).limit(0)).collect() == []
    rows = dm.near_duplicates(docs(spark, [(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (4, "a b c d e f", "s"), (4, "a b c d e f", "s"), (9, "a b c d e f", None)])).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, -1, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    kept = dm.deduplicated(docs(spark, [(4, "a b c d e f", "s"), (4, "a b c d e f", "s"), (9, "a b c d e f", None)])).collect()
    assert [r.doc_id for r in kept] == [4] and kept[0].cluster == 5


def test_weighted_signatures():
    a, b = "a b c d e " * 3 + "x y z q w", "a b c d e " * 9 + "x y z q w"
    doc, h, n = dm.shingles([a, b])
    sig = dm.dart_signatures(doc, h, n.astype(float), 2, 8192)
    part = [(h[doc == i].tobytes(), n[doc == i].astype(np.int32).tobytes()) for i in (0, 1)]
    true = dm.similarity(*part[0], *part[1])
    assert true < 0.5 and abs((sig[0] == sig[1]).mean() - true) < 0.03


@pytest.mark.parametrize("cut", [20, 60, 150])
def test_signatures_estimate_similarity(cut):
    r = random.Random(cut)
    base = [f"w{r.randrange(5000)}" for _ in range(400)]
    other = base[:-cut] + [f"z{i}" for i in range(cut)]
    doc, h, n = dm.shingles([" ".join(base), " ".join(other), ""])
    sig = dm.dart_signatures(doc, h, np.ones(len(n)), 3, 4096)
    assert abs((sig[0] == sig[1]).mean() - jaccard(shingle_set(" ".join(base)), shingle_set(" ".join(other)))) < 0.03
    assert not sig[2].any()


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_similarities_are_exact(weighting):
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(6)}" for _ in range(r.choice([1, 3, 40, 200]))) for _ in range(20)]
    doc, h, n = dm.shingles(texts)
    sets = [h[doc == i].tobytes() for i in range(20)]
    many = [n[doc == i].astype(np.int32).tobytes() if weighting == "count" else None for i in range(20)]
    counts = [Counter(shingle_list(t)) if weighting == "count" else Counter(set(shingle_list(t))) for t in texts]
    want = [(counts[0] & c).total() / (counts[0] | c).total() for c in counts]
    assert dm.similarities((sets[0], many[0]), sets, many) == pytest.approx(want)


def shingle_list(text, width=5):
    words = text.split()
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def test_near_duplicates_by_count(spark):
    texts = corpus(4, 25) + ["a b c d e f g " * 30, "a b c d e f g " * 33, "a b c d e f g " * 60, "a b c d e f g " * 31 + "z"] + ["", None, "x"]
    counts = [Counter(shingle_list(t)) if (t or "").split() else None for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if counts[i] and counts[j] and (counts[i] & counts[j]).total() >= 0.8 * (counts[i] | counts[j]).total()]
    want = union_find(len(texts), pairs)
    got = {r.doc_id: r.class_id for r in dm.near_duplicates(docs(spark, [(i, t, None) for i, t in enumerate(texts)] + [(None, "x", "s")]), weighting="count").collect() if r.doc_id is not None}
    assert [got[i] for i in range(len(texts))] == want


def test_strangers_with_a_common_half_share_few_buckets(spark):
    """600 documents of pairwise similarity 0.33, and a chain of copies among them."""
    r = random.Random(8)
    half = [f"h{r.randrange(9000)}" for _ in range(60)]
    texts = [" ".join(half + [f"w{r.randrange(9000)}" for _ in range(60)]) for _ in range(600)]
    texts += [t.rsplit(" ", 2)[0] for t in texts[::40]]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    d = docs(spark, rows)
    keys = dm.sketches(d, 40, 6, "set").select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").agg(F.sum("m"), F.sum("m") / F.lit(600)).first()
    assert shared[0] < 3 * len(rows) and keys.groupBy("key").count().agg(F.max("count")).first()[0] < 150
    sets = [shingle_set(t) for t in texts]
    want = union_find(len(texts), [(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8])
    # tiny blocks: buckets of strangers are banded again, then tiled
    got = {x.doc_id: x.class_id for x in dm.near_duplicates(d, block=2).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_common_elements_are_counted():
    r = np.random.default_rng(1)
    x, y = ([np.sort(r.choice(5000, r.integers(0, 300), replace=False)).astype(np.uint64) for _ in range(n)] for n in (30, 20))
    assert dm.in_common(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert np.triu(dm.in_common(x, step=64), 1).tolist() == np.triu([[len(np.intersect1d(a, b)) for b in x] for a in x], 1).tolist()


@pytest.mark.parametrize("least", [0.5, 0.8])
@pytest.mark.parametrize("weighting", ["set", "count"])
def test_leading_elements_meet(least, weighting):
    """Each pair that is similar enough has its first common element in both leads, and in
    the short one of the smaller set."""
    r = random.Random(6)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(30)}" for _ in range(r.choice([1, 5, 6, 9, 40, 90]))]
        texts += [" ".join(w for w in base + ["x", "y", "a", "b"] * r.randrange(3) if r.random() > 0.02) or "x" for _ in range(6)]
    doc, h, n = dm.shingles(texts)
    parts = [(h[doc == i].tobytes(), n[doc == i].astype(np.int32).tobytes() if weighting == "count" else None) for i in range(len(texts))]
    elements = [dm._elements(*p) for p in parts]
    counts = np.bincount((np.concatenate(elements) % np.uint64(dm.SLOTS)).astype(np.int64), minlength=dm.SLOTS)
    leads, pairs = [dm.leading(x, counts, least) for x in elements], 0
    for i, (x, short) in enumerate(leads):
        for j, (y, _) in enumerate(leads):
            if i != j and len(elements[i]) <= len(elements[j]) and dm.similarity(*parts[i], *parts[j]) >= least:
                pairs += 1
                assert set(x[:short].tolist()) & set(y.tolist())
    assert pairs > 50


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_links_do_not_depend_on_a_buckets_size(spark, weighting):
    """Strangers with a passage in common, and near copies among them, which mostly share
    one bucket only; with tiny blocks it counts as a large one."""
    r = random.Random(9)
    half = [f"h{k}" for k in range(60)]
    texts = [" ".join(half + [f"w{r.randrange(9000)}" for _ in range(30)]) for _ in range(60)]
    texts += [t.rsplit(" ", 3)[0] + f" z{i}" for i, t in enumerate(texts[::2])] + ["same words " * 40, "same words " * 44]
    d = docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    whole, small = ({x.doc_id: x.class_id for x in dm.near_duplicates(d, bands=2, rows=1, weighting=weighting, block=block).collect()} for block in (256, 1))
    assert small == whole and sum(i != c for i, c in whole.items()) > 20


def test_one_large_group_of_near_copies(spark):
    """Members link with the smallest one, or through others, or not at all."""
    r = random.Random(5)
    base = [f"w{r.randrange(4000)}" for _ in range(100)]
    texts = []
    for i in range(250):
        t = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 4, 6])):
            t[r.randrange(len(t))] = f"z{r.randrange(4000)}"
        texts.append(" ".join(t))
    sets = [shingle_set(t) for t in texts]
    want = union_find(len(texts), [(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8])
    for block in (256, 10):
        got = {x.doc_id: x.class_id for x in dm.near_duplicates(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want


def vectors(n=260, d=16, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for i in range(1, n):
        if i % 3 == 0:
            x[i] = x[i - 1] * r.uniform(0.5, 2) + r.normal(size=d) * r.choice([0.0, 0.03, 0.15])
    return x, r.integers(0, 3, n)


@pytest.mark.parametrize("block,grid", [(512, 2), (7, 1), (20, 3), (20, 9), (4096, None)])
def test_near_vectors_against_all_pairs(spark, block, grid):
    x, label = vectors()
    norm = np.linalg.norm(x, axis=1)
    link = (x @ x.T / norm[:, None] / norm[None, :] >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want = union_find(len(x), zip(*np.nonzero(link)))
    rows = [(i, [float(v) for v in x[i]], int(label[i]), 1, "c") for i in range(len(x))]
    odd = [(1000, None, 1, 1, "c"), (1001, [0.0] * 16, 1, 1, "c"), (1002, [1.0, None], 1, 1, "c"), (1003, [float("nan")] * 16, 1, 1, "c"), (1004, rows[0][1], None, 1, "c"), (None, rows[0][1], int(label[0]), 1, "c"), (1005, [float("inf")] * 16, 1, 1, "c"), (1006, [], 1, 1, "c"), (1007, [1.0, 2.0], 1, 1, "c")]
    schema = "vec_id long, embedding array<double>, label int, n long, cell string"
    got = {r.vec_id: r for r in pca_dedup.near_vectors(spark.createDataFrame(rows + odd, schema), block=block, grid=grid).collect()}
    assert [got[i].n_links for i in range(len(x))] == list(link.sum(1))
    assert [got[i].component_id for i in range(len(x))] == want
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert pca_dedup.near_vectors(spark.createDataFrame([], schema)).collect() == []


def test_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in (5, 3, 9, 9)] + [(7, [2.0, 4.0, 6.0], 1), (8, [1.0, 2.0, 3.0], 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pca_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(3, 4, 3), (5, 4, 3), (7, 4, 3), (8, 0, 8), (9, 4, 3), (9, 4, 3)]


def test_tile_stops_early_and_late():
    x, _ = vectors(80, 64, 9)
    n = np.linalg.norm(x, axis=1)
    cos = x @ x.T / n[:, None] / n[None, :]
    for t in (0.5, 0.98, 1.5):
        i, j = pca_dedup.tile_links(x, x, pca_dedup.axes(pca_dedup.unit(x)), t)
        assert set(zip(i, j)) == set(zip(*np.nonzero(cos >= t)))


def test_gam_learns_and_adds_up():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, len(gam_quality.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = gam_quality.fit(x, y, rounds=40)
    s = m.score(x)
    assert ((s >= 0.5) == y).mean() > 0.95 and m.pairs and s.min() >= 0 and s.max() <= 1
    b = m.bins(x)
    z = m.intercept + sum(t[c] for t, c in zip(m.tables, b)) + sum(t[m.coarse[f][b[f]], m.coarse[g][b[g]]] for f, g, t in m.pairs)
    assert np.allclose(1 / (1 + np.exp(-z)), s)


def naive_fit(x, y, rounds, rate=0.1, l2=1.0):
    """The main effects, row by row and cut by cut; scores of the rows."""
    n, p = len(y), (sum(y) + 0.5) / (len(y) + 1)
    z = [math.log(p / (1 - p))] * n
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1]))) for f in range(x.shape[1])]
    bins = [[sum(c <= v for c in cuts[f]) for v in x[:, f]] for f in range(x.shape[1])]
    for _ in range(rounds):
        for f in range(x.shape[1]):
            q = [1 / (1 + math.exp(-v)) for v in z]
            g, h = [b - a for a, b in zip(q, y)], [a * (1 - a) for a in q]
            leaves = [(0, len(cuts[f]) + 1)]
            total = lambda v, lo, hi: sum(a for a, b in zip(v, bins[f]) if lo <= b < hi)  # noqa: E731, B023
            for _ in range(2):
                best = (1e-12, None, None)
                for k, (lo, hi) in enumerate(leaves):
                    tg, th = total(g, lo, hi), total(h, lo, hi)
                    for at in range(lo + 1, hi):
                        lg, lh = total(g, lo, at), total(h, lo, at)
                        gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
                        if lh >= 1e-3 and th - lh >= 1e-3 and gain > best[0] + 1e-12:
                            best = (gain, k, at)
                if best[1] is None:
                    break
                lo, hi = leaves.pop(best[1])
                leaves += [(lo, best[2]), (best[2], hi)]
            for lo, hi in leaves:
                step = rate * total(g, lo, hi) / (total(h, lo, hi) + l2)
                z = [v + step if lo <= b < hi else v for v, b in zip(z, bins[f])]
    return [1 / (1 + math.exp(-v)) for v in z]


def test_gam_against_plain_boosting():
    r = np.random.default_rng(4)
    x = r.normal(size=(120, 3)).round(1)
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(size=120) * 0.5 > 0).astype(float)
    got = gam_quality.fit(x, y, rounds=4, pairs=0).score(x)
    assert got == pytest.approx(naive_fit(x, list(y), 4))


def naive_features(text):
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(gam_quality.FEATURES)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    return [
        math.log1p(n), letters / n, math.log1p(max(map(len, words))), sum(c.isupper() for c in text) / letters, len(re.findall(r"[^\w\s.,;:!?'\"()-]", text)) / len(text), sum(c in "0123456789" for c in text) / len(text), len(set(words)) / n,
        Counter(words).most_common(1)[0][1] / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(re.findall(r"[^\w\s.,;:!?'\")]+(?=\s|$)|[!?]{2,}(?=\s|$)", text)) / n, len(re.findall(r"[.!?](?=\s|$)", text)) / n, sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines) if lines else 0.0, text.count("|") / n, sum(w.isupper() and len(w) > 1 for w in words) / n,
    ]


def test_scores_against_a_plain_sum(spark, sf):
    """The registered query's rows: features measured anew, table entries added one by one."""
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = gam_quality.train(d, labels)
    texts = {r.doc_id: r.text for r in d.collect()}
    got = {r.doc_id: r.score for r in gam_quality.quality_scores(d, labels).collect()}
    for i, t in texts.items():
        b = [sum(c <= v for c in cuts) for v, cuts in zip(naive_features(t or ""), m.cuts)]
        z = m.intercept + sum(table[k] for table, k in zip(m.tables, b)) + sum(t2[m.coarse[f][b[f]], m.coarse[g][b[g]]] for f, g, t2 in m.pairs)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))


def test_features_of_long_texts():
    text = ("Word other WORD 12 | . " * 40_000 + "\n") * 3 + "end?!"
    assert gam_quality.features(text) == pytest.approx(naive_features(text))
    ids, words = gam_quality._numbered(text, 50)
    assert [words[i] for i in ids] == text.split()


def test_gam_without_labels():
    assert (gam_quality.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((3, 2))) == 0.5).all()
    assert gam_quality.fit(np.zeros((9, 2)), np.ones(9)).score(np.zeros((1, 2)))[0] > 0.9


def test_quality_held_out(spark, sf):
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = gam_quality.quality_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert rows and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    one = gam_quality.quality_scores(d, labels).select("doc_id", F.round("score", 9).alias("s")).collect()
    assert sorted(one) == sorted(gam_quality.quality_scores(d, labels).select("doc_id", F.round("score", 9).alias("s")).collect())


def test_quality_odd_tables(spark):
    d = docs(spark, [(1, "a b", None), (1, "a b", None), (None, None, "s"), (2, "", "s"), (3, "word " * 20_000, "s")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = gam_quality.quality_scores(d, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len(gam_quality.quality_scores(d, labels.limit(0)).collect()) == 5
    assert gam_quality.quality_scores(d.limit(0), labels).collect() == []
    assert gam_quality.accepted(d, labels.limit(0)).columns == d.columns


def water(sizes, weights, most=3):
    """Targets by resharing until none is above its cap."""
    total, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), {}
    while open_:
        left = total - sum(out.values())
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        if not over:
            return {**out, **{i: left * weights[i] / w for i in open_}}
        for i in over:
            out[i] = Fraction(most * sizes[i])
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_mix(spark, seed):
    r = random.Random(seed)
    names = [f"s{i:02d}" for i in range(r.randrange(2, 9))] + [None]
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 3, 40, 400]))), names[min(int(r.expovariate(0.7)), len(names) - 1)]) for i in range(400)]
    d = docs(spark, rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = water([sizes[s] for s in order], [i % 3 + 1 for i in range(len(order))])
    got = {x.source: x.target for x in targets(d.select("source", F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long").alias("size"))).collect()}
    for i, s in enumerate(order):
        assert got[s] == pytest.approx(float(want[i]))
    out = mix(d).collect()
    taken = defaultdict(int)
    of = {i: s for i, _, s in rows}
    for x in out:
        assert 0 <= x.taken <= 3 * x.size and x.source_size == sizes[of[x.doc_id]]
        taken[of[x.doc_id]] += x.taken
    for i, s in enumerate(order):
        assert abs(taken[s] - want[i]) <= 20
    assert sorted(out) == sorted(mix(d.repartition(7)).collect())


@pytest.mark.parametrize("slots", [1, 7, 64, 1 << 18])
def test_sources_take_their_targets_exactly(spark, slots):
    rows = [(i, "w " * (i % 90 + 1), f"big{i % 3}") for i in range(600)] + [(1000 + i, "a few words", f"small{i % 4}") for i in range(9)] + [(2000, "one", None)]
    taken, want = defaultdict(int), {}
    of = {i: s for i, _, s in rows}
    for x in mix(docs(spark, rows), slots=slots).collect():
        assert 0 <= x.taken <= 3 * x.size
        taken[of[x.doc_id]] += x.taken
        want[of[x.doc_id]] = int(x.target + 0.5)
    assert taken == want and min(want.values()) > 0
    words = defaultdict(int)
    for x in mixed_documents(docs(spark, rows), slots=slots).collect():
        words[x.source] += len(x.text.split())
    assert words == want


def spark_hash(i):
    h = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)
    return h - (1 << 64) if h >> 63 else h


def naive_mix(rows, slots, most=3, golden=5_700_357_409_661_599_241):
    """The schedule, slot after slot, and each document's words in it."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    of = defaultdict(list)
    for i, _, s in rows:
        of[s].append(i)
    order = sorted((s for s in of if s is not None)) + [None] * (None in of)
    totals = [sum(size[i] for i in of[s]) for s in order]
    want = water(totals, [i % 3 + 1 for i in range(len(order))], most)
    wanted = {s: int(float(want[k]) + 0.5) for k, s in enumerate(order)}
    total = sum(totals)
    block = max(1, -(-total // slots))
    ends, run = [], 0.0
    for k in range(len(order)):
        run += float(want[k])
        ends.append(run)
    given = defaultdict(int)
    for slot in range(total // block):
        u = slot * golden % 2**63 / 2**63
        k = next((k for k, e in enumerate(ends) if u < e / ends[-1]), len(order) - 1)
        given[order[k]] += 1
    taken = defaultdict(int)
    for s in order:
        line = sorted(of[s], key=lambda i: (spark_hash(i) % 1024, spark_hash(i), i))
        words = [i for _ in range(most) for i in line for _ in range(size[i])]
        blocks = max(given[s], -(-wanted[s] // block))  # those without a slot follow its last
        for i in words[: min(wanted[s], blocks * block)]:
            taken[i] += 1
    return {i: taken[i] for i, _, _ in rows}, given, block


@pytest.mark.parametrize("slots", [40, 1 << 18])
def test_mix_against_a_plain_schedule(spark, slots):
    r = random.Random(slots)
    rows = [(i, "w " * r.choice([0, 1, 7, 60, 300]), r.choice(["a", "b", "b", "c", "d", None, "e"] + ["a"] * 6)) for i in range(300)]
    want, given, block = naive_mix(rows, slots)
    assert {x.doc_id: x.taken for x in mix(docs(spark, rows), slots=slots).collect()} == want
    from tidelog.llm.source_mix import ranked_slots

    sizes = spark.createDataFrame([(s, len((t or "").split())) for _, t, s in rows], "source string, size long")
    total = sum(len(t.split()) for _, t, _ in rows)
    have = ranked_slots(targets(sizes), total // block).collect()
    assert {s: n for s, n in Counter(x.source for x in have).items()} == {s: n for s, n in given.items() if n}
    for s in given:
        mine = sorted((x.slot, x.rank) for x in have if x.source == s)
        assert [k for _, k in mine] == list(range(len(mine)))


def test_mixed_documents_hold_what_is_taken(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 13)), f"s{i % 4}" if i % 5 else None) for i in range(200)]
    d = docs(spark, rows)
    want = {x.doc_id: x.taken for x in mix(d).collect()}
    got = defaultdict(int)
    for x in mixed_documents(d).collect():
        got[x.doc_id] += len(x.text.split())
        assert rows[x.doc_id][1].startswith(x.text) and x.n_chars in (len(x.text), len(rows[x.doc_id][1]))
    assert got == {k: v for k, v in want.items() if v}
    assert mixed_documents(d).columns == d.columns
    assert mix(d.limit(0)).collect() == [] and mixed_documents(d.limit(0)).collect() == []


def test_mix_odd_rows(spark):
    out = mix(docs(spark, [(None, None, None), (None, "", "s"), (1, "a b", "s"), (1, "a b", "s"), (2, "x " * 30_000, None)])).collect()
    assert len(out) == 5 and sum(x.taken for x in out if x.size == 0) == 0


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_shards(spark, shards):
    r = random.Random(shards)
    rows = [(i, "".join(r.choice("abcdé ") for _ in range(r.choice([5, 50, 500]))), None) for i in range(900)] + [(2000 + i, "copy of a text " * 10, None) for i in range(60)]
    out = kd_shards(docs(spark, rows), shards).collect()
    size = {i: len(t.encode()) + 1 for i, t, _ in rows}
    assert {x.doc_id: x.size for x in out} == size
    total = [sum(x.size for x in out if x.shard == k) for k in range(shards)]
    assert max(total) <= 1.1 * sum(total) / shards and min(total) >= 0.9 * sum(total) / shards
    for k in range(shards):
        slots = sorted(x.slot for x in out if x.shard == k)
        assert slots == list(range(len(slots)))
    assert len({x.shard for x in out if x.doc_id >= 2000}) == 1
    assert {x.law for x in out} == {"bytes"} and all(x.grown_shard is None for x in out)


def naive_tree(rows, shards, tolerance=0.005):
    """doc_id to shard, by recursion over plain lists."""
    points = []
    for i, t, _ in rows:
        t = t or ""
        b = t.encode()
        n = len(b) + 1
        log = lambda x: math.floor(math.log2(x) * (1 << 20))
        digits, spaces = sum(map(t.count, "0123456789")), t.count(" ")
        finger = xxhash.xxh64_intdigest(b, seed=42) >> 31
        points.append((i, n, (log(n), log(len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1), log(n / (t.count("\n") + 1)), math.floor(digits / n * (1 << 30)), math.floor(spaces / n * (1 << 30)), finger)))
    spread = lambda ps: [max(p[2][d] for p in ps) - min(p[2][d] for p in ps) for d in range(6)]
    root, out = spread(points), {}

    def cut(ps, d, want):
        by = defaultdict(int)
        for _, n, x in ps:
            by[x[d]] += n
        best, run = None, 0
        values = sorted(by)
        for k, v in enumerate(values):
            run += by[v]
            if run >= want or k == len(values) - 1:
                over, under = run - want, want - (run - by[v])
                return (values[k - 1], under) if k and under < over else (v, abs(over))
        return best

    def split(ps, first, n):
        if n == 1 or not ps:
            out.update({p[0]: first for p in ps})
            return
        total, wide = sum(p[1] for p in ps), spread(ps)
        want = -(-total * (n // 2) // n)
        turns = [*sorted(range(5), key=lambda d: -wide[d] / max(1, root[d])), 5]
        best = None
        for d in turns:
            if best is not None and best[1] <= tolerance * total:
                break
            at, miss = cut(ps, d, want)
            if best is None or miss < best[1]:
                best = (at, miss, d)
        at, _, d = best
        split([p for p in ps if p[2][d] <= at], first, n // 2)
        split([p for p in ps if p[2][d] > at], first + n // 2, n - n // 2)

    split(points, 0, shards)
    return out


@pytest.mark.parametrize("shards,seed", [(8, 1), (5, 2), (8, 3)])
def test_shards_against_a_plain_tree(spark, shards, seed):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("abcdé 12\n") for _ in range(r.choice([1, 5, 50, 500]))), None) for i in range(400)] + [(1000 + i, "one text with copies " * 9, None) for i in range(30)] + [(2000 + i, f"{i:04d} alike", None) for i in range(200)]
    assert {x.doc_id: x.shard for x in kd_shards(docs(spark, rows), shards).collect()} == naive_tree(rows, shards)


def test_shards_odd_tables(spark):
    import zlib

    rows = [(None, None, None), (None, "", None), (3, "x", "s"), (3, "x", "s"), (4, "long " * 50_000, "s")]
    out = kd_shards(docs(spark, rows)).collect()
    assert len(out) == 5 and {x.text_crc32 for x in out} == {zlib.crc32((t or "").encode()) for _, t, _ in rows}
    assert len({x.shard for x in out if x.doc_id == 3}) == 1 and all(0 <= x.shard <= 7 for x in out)
    assert kd_shards(docs(spark, []).limit(0)).collect() == []
    assert len(kd_shards(docs(spark, [(i, "same", "s") for i in range(9)])).collect()) == 9


def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from tidelog.llm.sentencepiece_bpe import vocabulary

    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "mixing", "sentencepiece"]
    d = spark.read.parquet(f"{sf}/documents.parquet").cache()
    out = {n: None for n, _ in p.STAGES}
    now = d
    for name, stage in p.STAGES[:-1]:
        now = p.kept(stage(spark, now, sf), "t")
        assert now.columns == d.columns
        out[name] = now.collect()
    good = {r.doc_id for r in gam_quality.quality_scores(d, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in out["quality"]} == good
    texts = {r.doc_id: r.text for r in out["quality"]}
    ids = sorted(texts)
    sets = [shingle_set(texts[i]) for i in ids]
    want = union_find(len(ids), [(a, b) for b in range(len(ids)) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8])
    assert sorted(r.doc_id for r in out["near_dedup"]) == [ids[k] for k, w in enumerate(want) if k == w]
    last = p.run(spark, sf).collect()
    v = vocabulary()
    assert sorted((r.doc_id, r.n_tokens) for r in last) == sorted((r.doc_id, len(v.sp.encode(r.text))) for r in out["mixing"])


@pytest.mark.parametrize("rows", [[], [(None, None, None), (1, "", "s"), (1, "", "s"), (2, "a b", None), (3, "long text " * 30_000, "s"), (4, "long text " * 30_000, "t"), (5, "one two three four five six", "s")]])
def test_pipeline_odd_documents(spark, sf, rows):
    import corpus_pipeline as p

    now = docs(spark, rows) if rows else docs(spark, [(1, "x", "s")]).limit(0)
    columns = now.columns
    for name, stage in p.STAGES:
        now = p.kept(stage(spark, now, sf), "odd")
        assert now.columns == columns or name == p.STAGES[-1][0]
    got = now.collect()
    assert len({r.doc_id for r in got} & {3, 4}) <= 1
    if not rows:
        assert got == []
