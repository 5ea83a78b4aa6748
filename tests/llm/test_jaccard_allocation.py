"""The Jaccard join's allocation by counted costs: exact whatever the counts, and popular keys are avoided."""

import numpy as np
from pyspark.sql import functions as F

from touchline.llm import jaccard_join as jj

from .test_operators import brute_components


def test_allocation_never_misses():
    """Whatever other sets' entries cost, the larger of two linked sets probes a key of the smaller."""
    rng = np.random.default_rng(14)
    tried = 0
    for _ in range(600):
        percent = int(rng.choice([80, 85]))
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 200)), dtype=np.uint64))
        drop = int(rng.integers(0, jj.differences(len(a), len(a), percent) + 1))
        b = np.unique(np.concatenate([a[drop // 2 :], rng.integers(0, 1 << 63, drop - drop // 2, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < percent * (len(a) + len(b) - common):
            continue
        tried += 1
        big, small = (a, b) if len(a) >= len(b) else (b, a)
        keys, units = jj.unpacked_keys(len(big), jj.packed_keys(big, percent), percent)
        theirs, roles = jj.unpacked_keys(len(small), jj.packed_keys(small, percent), percent)
        entries = theirs[roles < 1 << jj.SCHEME_SHIFT]
        cost = np.where(np.isin(keys, entries), 1, 0) * rng.integers(1, 50, len(keys)) + (rng.random(len(keys)) < 0.3) * rng.integers(0, 30, len(keys))
        listed = cost > 0
        chosen = jj.allocated(len(big), units[listed], cost[listed], percent)
        assert np.isin(keys[listed][chosen], entries).any(), (len(a), len(b), percent)
    assert tried > 200


def test_passage_in_all_texts_makes_no_family(spark):
    rng = np.random.default_rng(2)
    footer = " ".join(f"f{i}" for i in range(25))
    rows = {i: " ".join(f"w{x}" for x in rng.integers(0, 10**9, 150)) + " " + footer for i in range(150)}
    rows |= {200 + i: rows[i] + " more" for i in range(20)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(df).collect()}
    assert got == brute_components({k: v.encode() for k, v in rows.items()}, 4, 85)
    reps = df.select("doc_id", F.col("text")).collect()
    packed = [(r.doc_id, len(s := jj.shingle_set(r.text.encode())), bytearray(jj.packed_keys(s))) for r in reps]
    ties = jj.family_ties(spark.createDataFrame(packed, "rep long, n long, keys binary"), 85).collect()
    assert {(r.a, r.b) for r in ties} == {(200 + i, i) for i in range(20)}
