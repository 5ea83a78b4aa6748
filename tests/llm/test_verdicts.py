"""Whole results of the quality classifier and the outlier rules against brute force."""

import collections
import math
import random

import numpy as np
import pytest

from touchline.llm import ngram_quality, quality_rules


def kneser_ney(good):
    """A dictionary model of one language's trusted texts: probability of an n-gram code."""
    n = ngram_quality.ORDER
    tables = {n: collections.Counter(c for t in good for c in grams(t))}
    for k in range(n - 1, 0, -1):
        tables[k] = collections.Counter(c & ((1 << 8 * k) - 1) for c in tables[k + 1])
    context, disc = {}, {}
    for k, t in tables.items():
        f = collections.Counter(t.values())
        y = f[1] / max(f[1] + 2 * f[2], 1)
        disc[k] = [min(max(j - (j + 1) * y * f[j + 1] / f[j], 0.1), j - 0.1) if f[j] and f[1] + f[2] else 0.5 for j in (1, 2, 3)]
        for c, v in t.items():
            total, mass = context.get((k, c >> 8), (0, 0.0))
            context[k, c >> 8] = total + v, mass + disc[k][min(v, 3) - 1]

    def prob(code, k=n):
        if k == 0:
            return 1 / 256
        low = prob(code & ((1 << 8 * (k - 1)) - 1), k - 1)
        total, mass = context.get((k, code >> 8), (0, 0.0))
        v = tables[k].get(code, 0)
        return (max(v - disc[k][min(v, 3) - 1], 0) if v else 0) / total + mass / total * low if total else low

    return prob


def grams(text):
    padded = bytes([ngram_quality.START]) * (ngram_quality.ORDER - 1) + text + bytes([ngram_quality.END])
    return [int.from_bytes(padded[i : i + ngram_quality.ORDER], "big") for i in range(len(text) + 1)]


def test_classifier_columns_against_brute_force(spark):
    rng = random.Random(4)
    words = ["river", "stone", "bridge", "light", "green", "paper", "north", "tower"]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))
    bad = lambda: "".join(chr(rng.randrange(33, 120)) for _ in range(rng.randrange(20, 300)))
    rows = [(i, good() if i % 9 else bad(), "xx" if i % 3 else "yy") for i in range(240)] + [(None, good(), "xx"), (500, None, "yy"), (501, good(), None)]
    labels = [(i, 1 if i % 9 else 0, 0) for i in range(200)] + [(7, None, 0), (8, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = ngram_quality.quality_classifier(docs, marked).collect()
    held = {r.doc_id: r.held_out for r in ngram_quality.trusted_ids(marked).collect()}
    assert set(held) == {i for i, q, _ in labels if q == 1} - {7, 8}
    probs = {lang: kneser_ney([t.encode() for i, t, x in rows if x == lang and held.get(i) is False]) for lang in ("xx", "yy")}
    want = []
    for i, text, lang in rows:
        text = (text or "").encode()
        prob = probs.get(lang, lambda c: 1 / 256)
        want.append((i, lang or "", len(text) + 1, sum(math.log10(prob(c)) for c in grams(text))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for r, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert (r.doc_id, r.lang, r.n_bytes) == w[:3] and r.log10_prob == pytest.approx(w[3])
        assert r.perplexity == pytest.approx(10 ** (-w[3] / w[2]))
    pick = lambda xs, q: sorted(xs)[max(0, math.ceil(q * len(xs)) - 1)]
    middle = {lang: pick([-p / n for _, x, n, p in want if x == lang], 0.5) for lang in ("xx", "yy", "")}
    drawn = lambda w: (-w[3] + ngram_quality.PRIOR_BYTES * middle[w[1]]) / (w[2] + ngram_quality.PRIOR_BYTES)
    out = [w for w in want if held.get(w[0])]
    excess = pick([drawn(w) - middle[w[1]] for w in out], ngram_quality.QUANTILE)
    limit = {}
    for lang in middle:
        mine = [drawn(w) for w in out if w[1] == lang]
        limit[lang] = pick(mine, ngram_quality.QUANTILE) if len(mine) >= ngram_quality.MIN_HELD_OUT else middle[lang] + excess
    by = {w[0]: w for w in want}
    for r in got:
        w = by[r.doc_id]
        assert r.kept == (drawn(w) <= limit[w[1]] + 1e-12) == (r.perplexity <= r.threshold * (1 + 1e-9))
    assert not any(r.kept for r in got if r.doc_id in range(0, 240, 9))


def test_outlier_verdicts_against_numpy(spark):
    """Distances, cutoffs and verdicts of a whole table against the same steps in numpy."""
    rng = np.random.default_rng(6)
    stats = []
    for i in range(700):
        words = int(rng.integers(60, 400))
        far = i % 35 == 0
        stats.append((i, "en", "a" if i < 500 else "b", words, words * (5 if not far else 14) + int(rng.integers(0, 40)), int(rng.integers(0, 4)) + 60 * far, int(rng.integers(0, 2)), int(rng.integers(0, 9)), int(rng.integers(5, 30)), int(rng.integers(0, 6)), 0))
    df = spark.createDataFrame(stats, quality_rules.STATS_DDL)
    got = {r.doc_id: r for r in quality_rules.outlier_verdicts(df).collect()}
    cols = [f.split()[0] for f in quality_rules.STATS_DDL.split(", ")]
    x = np.array([r[1:] for r in quality_rules.with_features(df).select("doc_id", *quality_rules.FEATURES).orderBy("doc_id").collect()], float)
    assert cols[0] == "doc_id"
    floor = np.diag(np.square(quality_rules.FLOORS))
    low = lambda v, q: np.sort(v)[max(0, math.ceil(q * len(v)) - 1)]
    for rows in (np.arange(500), np.arange(500, 700)):
        y = x[rows]
        quart = np.array([[low(y[:, f], q) for f in range(quality_rules.P)] for q in (0.25, 0.5, 0.75)])
        scatter = np.diag(((quart[2] - quart[0]) / 1.349) ** 2 + np.square(quality_rules.FLOORS))
        starts = [(quart[1], scatter), (quart[0], scatter), (y.mean(0), np.cov(y.T, bias=True) + floor)]
        dist = lambda m, c: np.einsum("ni,ij,nj->n", y - m, np.linalg.inv(c), y - m)
        best = None
        for m, c in starts:
            for _ in range(quality_rules.STEPS):
                d = dist(m, c)
                near = y[d <= low(d, quality_rules.H_SHARE)]
                m, c = near.mean(0), quality_rules.CONSISTENT_H * np.cov(near.T, bias=True) + floor
            if best is None or np.linalg.slogdet(c)[1] < best[0] - 1e-9:
                best = (np.linalg.slogdet(c)[1], m, c)
        near = y[dist(*best[1:]) <= quality_rules.REWEIGHTED]
        m, c = near.mean(0), quality_rules.CONSISTENT_REWEIGHTED * np.cov(near.T, bias=True) + floor
        d = dist(m, c)
        scale = max(1.0, low(d, 0.5) / quality_rules.CHI2_6_MEDIAN)
        q = [np.cbrt(low(d, p) / scale) for p in (0.25, 0.5, 0.75)]
        cutoff = max(quality_rules.CUTOFF, (q[1] + quality_rules.NORMAL_9999 / quality_rules.NORMAL_RANGE * (q[2] - q[0])) ** 3)
        for k, i in enumerate(rows.tolist()):
            assert got[i].distance == pytest.approx(d[k] / scale, rel=0.02)
            assert got[i].kept == (d[k] / scale <= cutoff), (i, d[k] / scale, cutoff)
    assert not any(got[i].kept for i in range(0, 700, 35))


def test_small_pools_are_judged_by_all_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "en" if i < 290 else "fr", "s", 100, 500 + int(rng.integers(0, 60)), int(rng.integers(0, 3)), 0, 0, 10, 2, 0) for i in range(300)]
    rows[299] = (299, "fr", "s", 100, 2500, 900, 0, 0, 900, 500, 0)
    got = {r.doc_id: r for r in quality_rules.outlier_verdicts(spark.createDataFrame(rows, quality_rules.STATS_DDL)).collect()}
    assert all(r.distance is not None for r in got.values()) and not got[299].kept and sum(r.kept for r in got.values()) >= 297
