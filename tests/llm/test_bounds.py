"""Long words, vector lengths, hot shards of packing, sidecar indexes, clashing names."""

import itertools
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from touchline.llm import ann, bpe, line_dedup, packing, warc
from touchline.llm.base import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_long_words_are_merged_like_the_library():
    rng = random.Random(5)
    model, library = bpe.MergeRounds(WORDS), Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    words = ["".join(rng.choice("aehnorst") for _ in range(n)) for n in (511, 512, 513, 700, 3000)] + ["ab" * 900, "a" * 1500, "é" * 600]
    for text in [*words, " ".join(words)]:
        assert model.encode_batch([text], {})[0] == library.encode(text, add_special_tokens=False).ids


def test_a_megabyte_of_letters_is_linear():
    rng = random.Random(6)
    ids = bpe.MergeRounds(WORDS).merge_long("".join(rng.choice("aehnorst") for _ in range(1_000_000)).encode())
    assert 100_000 < len(ids) < 900_000


def test_vectors_decide_the_length_and_ids_repeat(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 16)] + [(3, [9.0, 9.0])]
    asking = [(20, [1.0, 1.0, 1.0]), (40, [1.0, 2.0, 1.0]), (60, [1.0, 0.0])]
    frame = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(frame(rows), frame(asking), 3).orderBy("rank").collect()]
    assert got == [(60, 1, 15, 15.0), (60, 2, 14, 14.0), (60, 3, 13, 13.0)]


def test_hot_shards_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 5 = 0"), 5, 50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    assert sum(len(got[q] & set(np.argsort(-s[q])[:5].tolist())) for q in range(0, 600, 5)) / 600 >= 0.9


def packed_rows(spark, lengths, **more):
    rows = [(i if i % 4 else None, 0, 0, n, 7) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    path = scratch_path(spark, "pieces")
    pieces.repartition(3).write.parquet(path)
    return packing.packed(spark.read.schema(packing.PIECES).parquet(path), 100, **more).collect()


def test_repeated_rows_spread_and_part_filled_bins_meet(spark):
    rng = random.Random(8)
    lengths = [rng.randrange(5, 70) for _ in range(300)]
    got = packed_rows(spark, [n if i % 3 else 33 for i, n in enumerate(lengths)], shard_items=40)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(r.length for r in got)
    assert len(got) == 300 and all(sum(n for _, n in v) <= 100 for v in by.values())
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
    assert len(by) <= -(-total // 100) + 6


def fewest(sizes, capacity):
    """Least number of bins, by all assignments without symmetric ones."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            rooms[k] -= sizes[i]
            place(i + 1, rooms)
            rooms[k] += sizes[i]
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_small_packings_are_optimal():
    rng = random.Random(9)
    worse = 0
    for _, n in itertools.product(range(12), (6, 8, 10)):
        sizes = [rng.randrange(15, 75) for _ in range(n)]
        people = [packing.evolve(sizes, [], 100, seed)[0] for seed in range(packing.ISLANDS)]
        worse += min(len(set(p.tolist())) for p in people) - fewest(sorted(sizes, reverse=True), 100)
    assert worse == 0


def test_sidecars_are_what_was_written(spark):
    rows = [(1, "http://a/ü", "x" * 50), (2, None, None), (2, None, None), (None, "http://b", "y"), (3, "http://c", "x" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc")
    archives = warc.write_archives(warc.with_roles(pages), f"{folder}/monolithic", 40)
    index = warc.normalise(archives, f"{folder}/members")
    key = lambda r: (r.archive.rsplit("/", 1)[1], r.offset, r.length, r.record_id, r.record_type)
    assert sorted(map(key, warc.read_index(spark, f"{folder}/members").collect())) == sorted(map(key, index.collect()))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect())
    assert got == [("1", 50, "revisit", 3), ("2", 0, "response", None), ("2", 0, "response", None), ("3", 50, "response", None), ("None", 1, "response", None)]


def test_line_dedup_passes_any_column_and_long_texts(spark):
    names = ("d", "th", "gone", "cut", "ks", "k", "h", "lines")
    long = "\n".join(f"line {i % 700} of a long text" for i in range(9000))
    rows = [(1, "a\nb\nc", 5), (2, long, 6), (3, None, 7), (None, long, 8)]
    df = spark.createDataFrame([(i, t, *([v] * len(names))) for i, t, v in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = {(r.doc_id, r.d): r for r in line_dedup.line_dedup(df).collect()}
    assert len(out) == 4 and all(out[i, v][n] == v for i, _, v in rows for n in names)
    first, later = out[None, 8], out[2, 6]
    assert first.n_lines == later.n_lines == 9000 and later.n_removed_lines > first.n_removed_lines > 0
