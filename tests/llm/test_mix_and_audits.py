"""Source mix, filter interaction audit and source divergence audit against brute force."""

import collections
import re
from contextlib import contextmanager
from itertools import permutations, product

import numpy as np
import pytest

from touchline.llm import filter_audit, mixing, source_divergence

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"
#: Names that the operators use themselves, as columns of the input.
CLASHING = ["print", "part", "mask", "place", "run", "kind", "size", "bucket", "source_key", "target", "rounds", "extra", "last", "need", "block", "term", "n", "unused", "v", "at", "p", "q", "value", "rank"]


@contextmanager
def parted(spark, n=13):
    """So many shuffle partitions, none of them joined."""
    new = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def table(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC).repartition(parts)
    return df.selectExpr("*", *(f"doc_id AS {c}" for c in CLASHING))


def odd_rows(seed=0, n=300):
    rng = np.random.default_rng(seed)
    bodies = [None, "", " \n ", "one", "# hash", "ALL CAPS TEXT", "Straße ÉCLAIR 東京 東京 \U0001d538b", "x" * 50_000, " ".join(f"w{i % 7}" for i in range(400)), " ".join(f"w{i}" for i in range(230))]
    bodies += [" ".join(rng.choice(["the", "The", "of", "été", "zig-zag", "a_b", "$5"], int(k))) for k in rng.integers(1, 260, 12)]
    rows = []
    for i in range(n):
        body = bodies[0 if rng.random() < 0.02 else 8 if rng.random() < 0.33 else int(rng.integers(len(bodies)))]
        rows.append((None if rng.random() < 0.03 else int(rng.integers(0, n // 2)), body, [None, "", "en", "de"][int(rng.integers(4))], [None, "", "a", "b", "c\U0001f600"][int(rng.integers(5))]))
    return rows + rows[:20]


# -- source mix


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Targets by repeated resharing, as the contract tells it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        still = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[t] for t in still) for s in still}
        over = [s for s in still if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mix_of_odd_rows(spark, seed):
    rows = odd_rows(seed)
    with parted(spark):
        got = mixing.mixed(table(spark, rows)).collect()
        again = mixing.mixed(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    key = lambda t: repr(t)
    assert sorted(((r.doc_id, r["size"], r.source) for r in got), key=key) == sorted(((i, words(t), s) for i, t, _, s in rows), key=key)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want = brute_targets({s: sizes[s] for s in {r[3] for r in rows}})
    taken, lengths = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in {k * r["size"] for k in range(4)}
        taken[r.source] += r.taken
        lengths[r.source].append(r["size"])
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(1.0, min(x for x in lengths[s] if x) if any(lengths[s]) else 1.0)


def test_mix_limits_small_sources(spark):
    """A source of weight 3 and few words stops at three times its size, and the rest goes to the others by weight."""
    rows = [(i, "w " * 10, "en", "a") for i in range(100)] + [(i, "w " * 10, "en", "b") for i in range(100, 200)] + [(500, "w w", "en", "c")]
    got = {r.source: (r.source_size, r.target) for r in mixing.mixed(table(spark, rows)).collect()}
    assert got["c"] == (2, 6.0)
    assert got["a"][1] == pytest.approx((2002 - 6) / 3) and got["b"][1] == pytest.approx(2 * (2002 - 6) / 3)


def test_mix_of_nothing(spark):
    assert mixing.mixed(spark.createDataFrame([], DOC)).collect() == []
    got = mixing.mixed(spark.createDataFrame([(1, None, None, None, 0), (2, " ", "en", "a", 0)], DOC)).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_mix_of_one_repeated_row(spark):
    """Rows that are equal in every column are still taken one by one."""
    rows = [(7, "four words of text", "en", "a")] * 900 + [(8, "two words", "en", "b")] * 300
    with parted(spark):
        got = mixing.mixed(table(spark, rows, 9)).collect()
    by = collections.Counter()
    for r in got:
        by[r.source] += r.taken
    assert len(got) == 1200 and by == {"a": 2400, "b": 1800}


def test_nearest_sum_equals_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(200):
        k = int(rng.integers(1, 4))
        sizes = sorted({int(x) for x in rng.integers(1, 30, k)})
        counts = [int(x) for x in rng.integers(0, 4, len(sizes))]
        budget = int(rng.integers(0, 80))
        chosen = mixing.nearest_sum(sizes, counts, budget)
        assert all(0 <= a <= b for a, b in zip(chosen, counts))
        sums = {sum(s * c for s, c in zip(sizes, picks)) for picks in product(*(range(c + 1) for c in counts))}
        assert abs(sum(s * c for s, c in zip(sizes, chosen)) - budget) == min(abs(x - budget) for x in sums)


def test_long_lengths_bring_the_budget_within_the_window():
    rng = np.random.default_rng(4)
    sizes = sorted({int(x) for x in rng.integers(1, 100_000, 800)})
    counts = [int(x) for x in rng.integers(1, 9, len(sizes))]
    total = sum(s * c for s, c in zip(sizes, counts))
    for budget in (0, 1, total // 3, total // 2 + 1, total - 5, total):
        taken = mixing.documents_of_lengths(sizes, counts, budget, window=5_000)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert abs(sum(s * t for s, t in zip(sizes, taken)) - budget) <= 40


# -- filter interaction audit


def brute_audit(rows, labels):
    by_id = collections.defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        if i is not None:
            by_id[i] = [max(by_id[i][0], q == 1), max(by_id[i][1], t == 1)]
    failed = []
    for i, text, _, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows) else set()
        failed.append((source or "", fails, *(by_id[i] if i is not None else (0, 0))))
    out, shapley = {}, collections.Counter()
    for part, order in product({f[0] for f in failed}, map("".join, permutations("ABCDE"))):
        left = [f for f in failed if f[0] == part]
        gone = []
        for step, f in enumerate(order, 1):
            removed = [x for x in left if f in x[1]]
            left = [x for x in left if f not in x[1]]
            redundant = sum(f in x[1] for x in gone)
            gone += removed
            unique = sum(x[0] == part and x[1] == {f} for x in failed)
            out[part, order, step] = (len(left), len(removed), redundant, unique, sum(x[2] for x in removed), sum(x[3] for x in removed))
            shapley[part, f] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("n", [1, 13, 40])
def test_filter_audit_equals_brute_force(spark, n):
    rows = odd_rows(n, 120)
    labels = [(i, i % 3 % 2, i % 4 // 3) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (10, None, None), (9999, 1, 0)]
    with parted(spark, n):
        got = filter_audit.filter_audit(table(spark, rows), spark.createDataFrame([(*x, 0) for x in labels], LABEL + ", part int")).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.FIGURES) for r in got}
    assert len(found) == len(got)
    assert found == brute_audit(rows, labels)


def test_duplicates_over_many_partitions(spark):
    """One text on most rows reaches over many partitions, some of which hold nothing else; only its least id stays."""
    rows = [(i % 400, "same", "en", "s") for i in range(800)] + [(i, f"text {i}", "en", "s") for i in range(400, 450)]
    with parted(spark, 29):
        masks, _ = filter_audit.failure_masks(table(spark, rows, 7))
        got = masks.collect()
    assert len(got) == 850
    assert sorted(r.doc_id for r in got if not r["mask"] & 16) == sorted([0, 0, *range(400, 450)])


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """Texts of one fingerprint are compared by themselves, also at the edges of partitions."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    rows = [(i, f"text {i % 11}", "en", "s") for i in range(150)]
    with parted(spark, 9):
        got = filter_audit.failure_masks(table(spark, rows, 4))[0].collect()
    assert sorted(r.doc_id for r in got if not r["mask"] & 16) == list(range(11))


def test_filter_audit_of_nothing(spark):
    assert filter_audit.filter_audit(spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)).collect() == []


# -- source divergence audit


def brute_divergence(rows, least=3, top=200):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        sources = {d[1] for d in docs if d[0] == lang}
        count = {s: collections.Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if t in kept) for s in sources}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(count[s]) for s in sources}, share(sum(count.values(), collections.Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, items, last in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:last], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


@pytest.mark.parametrize("block", [20_000, 16 << 20])
def test_divergence_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(source_divergence, "BLOCK_BYTES", block)
    monkeypatch.setattr(source_divergence, "PAIRS", 7)
    rows = odd_rows(5)
    with parted(spark):
        got = source_divergence.source_divergence(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows)


def test_divergence_ranks_to_its_limit(spark):
    rows = [(i, " ".join("".join(chr(97 + d) for d in divmod(j, 26)) for j in range(i % 40, 400)), "en", "ab"[i % 2]) for i in range(80)]
    got = source_divergence.source_divergence(table(spark, rows), top=25).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows, top=25)


def test_divergence_without_kept_terms(spark):
    rows = [(1, "once", "en", "a"), (2, None, "en", None), (3, "123", "de", "x")]
    got = source_divergence.source_divergence(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)]
    assert source_divergence.source_divergence(spark.createDataFrame([], DOC)).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    for n, total in ((3, 7), (10**12 + 7, 3 * 10**14 + 1), (9 * 10**14, 9 * 10**14 + 11), (0, 10**15)):
        got = spark.range(1).selectExpr(f"{source_divergence._share(f'CAST({n} AS BIGINT) + 1', f'CAST({total} AS BIGINT)')} AS p").first().p
        assert got == 1 + 10**9 * (n + 1) // total
