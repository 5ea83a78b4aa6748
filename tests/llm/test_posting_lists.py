"""Posting lists: sizes, lists searched and recall on vectors without clusters, with clusters and of mixed norms."""

import numpy as np
import pytest

from touchline.llm import ann

N, DIM, K = 40_000, 64, 20


def vectors(kind):
    rng = np.random.default_rng(5)
    if kind == "clustered":
        return rng.normal(size=(200, DIM))[rng.integers(0, 200, N)] * 4 + rng.normal(size=(N, DIM))
    x = rng.normal(size=(N, DIM))
    return x if kind == "normal" else x / np.linalg.norm(x, axis=1)[:, None] * np.exp(rng.normal(0, 1, N))[:, None]


@pytest.mark.parametrize("kind,most_lists", [("normal", 0.75), ("clustered", 0.2), ("mixed norms", 0.2)])
def test_lists_are_balanced_and_few_are_searched(spark, kind, most_lists):
    x = vectors(kind)
    frame = spark.createDataFrame(((i, v) for i, v in enumerate(x.tolist())), "vec_id long, embedding array<double>")
    index = ann.fit(frame)
    placed = [found for at in range(0, N, 1000) for found in index.lists_of(x[at : at + 1000])]
    ids = np.array([i for i, (lists, _) in enumerate(placed) for _ in lists])
    lists = np.array([c for lists, _ in placed for c in lists])
    spare = np.array([-1 if k else s for lists, s in placed for k in range(len(lists))])
    counts = [np.bincount(lists[m], minlength=len(index.size)) for m in (spare >= 0, spare < 0)]
    to = ann.overflowed(ann.shares_kept(*counts), lists, spare, ids)
    index.size = np.bincount(to[to >= 0], minlength=len(index.size))
    used = index.size > 0
    assert set(ids[to >= 0]) == set(range(N))  # every vector is in a list
    assert index.size.max() <= 2 * index.size[used].mean()
    members = {c: ids[to == c] for c in np.flatnonzero(used)}
    recall, searched = [], []
    for q in range(0, N, N // 100):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argsort(-score)[:K]
        asked = index.search(q, x[q], K)
        searched.append(len(asked) / used.sum())
        recall.append(np.isin(best, np.concatenate([members.get(c, np.empty(0, int)) for c in asked])).mean())
    assert np.mean(recall) >= 0.95 and np.mean(searched) <= most_lists


def test_bands_that_cannot_matter_are_left_out(spark):
    rng = np.random.default_rng(2)
    u = rng.normal(size=(4000, 16))
    u /= np.linalg.norm(u, axis=1)[:, None]
    x = u * np.where(np.arange(4000) < 2000, 100.0, 0.1)[:, None]
    frame = spark.createDataFrame(((i, v) for i, v in enumerate(x.tolist())), "vec_id long, embedding array<double>")
    rows = ann.nearest(frame, frame.where("vec_id % 200 = 7")).collect()
    assert all(r.vec_id < 2000 for r in rows) and len(rows) == 20 * 20
    index = ann.fit(frame)
    short = {c + b.first for b in index.bands[4:] for c in range(len(b.centre))}
    index.size[:] = 1000
    assert not short & set(index.search(7, x[7], 20))


def test_doubles_are_scored_as_they_are(spark):
    v = [1 / 3, 1e-9, 7.123456789012345]
    frame = spark.createDataFrame([(0, v), (1, [2 / 7, 1.0, 0.1]), (20, v)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(frame, frame.where("vec_id % 20 = 0")).collect()}
    assert got[0, 1] == pytest.approx(v[0] * 2 / 7 + v[1] + v[2] * 0.1, rel=1e-15) and got[0, 20] == got[20, 0]
