"""The suffix index: merge scan with common prefixes, levels on disk, heavy grams, names and characters."""

import hashlib
import random

import numpy as np
import pytest

from touchline.llm import suffix_dedup
from touchline.llm.base import scratch_path

from .test_operators import brute_suffix


def sample_texts(seed, n):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([60, 120, 200, 400]))) for _ in range(8)]
    return ["".join(rng.choice([rng.choice(passages), "".join(rng.choice("xyz ") for _ in range(rng.randrange(90)))]) for _ in range(rng.randrange(6))) for _ in range(n)]


def digests(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("crowd", [1, 3, 24])
def test_index_against_all_pairs(monkeypatch, crowd):
    """Batches scanned against levels prove the same strings repeated as a comparison of all strings."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    least, gram = 20, 8
    texts = [t.encode() for t in sample_texts(5, 60)]
    h, doc, first, offset, more = suffix_dedup.anchors(texts, least, gram)
    context = [texts[d][f : f + m + least] for d, f, m in zip(doc, first, more)]
    s = suffix_dedup.Suffixes(h.view(np.int64), offset, more, context, least, gram)
    index = suffix_dedup.LogIndex(s)
    found = [x for at in range(0, len(h), 37) for x in index.add(np.arange(at, min(at + 37, len(h))))] + index.settle_crowded()
    sizes = [len(x.array) for x in index.levels]
    assert sum(sizes) == len(h) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    got = {(int(doc[i]), int(first[i] + offset[i] - d)) for late, low, high in found for i, a, b in zip(late, low, high) for d in range(a, b + 1)}
    want, seen = set(), set()
    for k, t in enumerate(texts):
        for i in range(len(t) - least + 1):
            if t[i : i + least] in seen:
                want.add((k, i))
            seen.add(t[i : i + least])
    assert got == want


def test_batches_into_a_stored_index_equal_one_run(spark):
    texts = sample_texts(6, 90)
    frame = lambda ids: spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string")
    folder = scratch_path(spark, "index")
    got, sizes = {}, []
    for a, b in ((0, 40), (40, 60), (60, 70), (70, 90)):
        got |= digests(suffix_dedup.extend_index(folder, frame(range(a, b))))
        sizes.append([int(x.rsplit("-", 1)[1]) for x in sorted(suffix_dedup.subfolders(spark, folder))])
    assert got == brute_suffix({i: t.encode() for i, t in enumerate(texts)}, 100)
    assert all(x > 2 * y for level in sizes for x, y in zip(level, level[1:])) and max(map(len, sizes)) > 1
    with pytest.raises(ValueError):
        suffix_dedup.extend_index(folder, frame(range(5)))


def test_heavy_grams_are_grouped_exactly(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY", 5)
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefghij ") for _ in range(180))
    texts = {i: "".join(rng.choice("klmnop ") for _ in range(rng.randrange(60))) + shared + "".join(rng.choice("qrstu ") for _ in range(40)) for i in range(40)}
    texts[40] = "ab" * 400
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert digests(suffix_dedup.suffix_dedup(df)) == brute_suffix({k: v.encode() for k, v in texts.items()}, 100)


def test_extra_columns_of_any_name_and_whole_characters(spark):
    text = "é" * 300
    rows = [(1, text, 5, "a"), (2, "x" + text + "é", 6, "b"), (3, None, 7, None)]
    names = ("d", "th", "copy", "digest", "spans", "shared", "size", "s")
    df = spark.createDataFrame([(*r[:2], *([r[2]] * len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df).collect()}
    assert len(out) == 3 and all(out[k][n] == v for k, _, v, _ in rows for n in names)
    assert out[2].text == "x" and out[3].text == "" and set(out[1].text) <= {"é"}
    want = brute_suffix({k: (t or "").encode() for k, t, *_ in rows}, 100)
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in out.items()} == want
    # a run that begins or ends within a character leaves that character whole
    assert suffix_dedup.whole_characters("aébéc".encode(), [(2, 5)]) == [(3, 4)]
    assert hashlib.sha256(suffix_dedup.cut("aébéc".encode(), [(2, 5)])).hexdigest()
