"""Batched merges against the tokenizers library, word for word and on odd texts."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from touchline.llm.bpe import MergeRounds, encoded, round_trip_digests

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "it's we'LL ΑΣ Σ İstanbul", "aaaaaaaaaaaaaaa", "x<|endoftext|>y <|STARTOFTEXT|>", "été z\x1cq", "日本語 123456 ١٢", "à" * 50, "!!!???...---" * 40, "\U0001f600‍\U0001f600", "\r\n\t tab"]


def test_encode_and_decode_equal_the_library():
    lib, own = Tokenizer.from_file(PATH), MergeRounds(PATH)
    ids = own.encode_batch(ODD, {})
    assert ids == [e.ids for e in lib.encode_batch(ODD, add_special_tokens=False)]
    assert [own.decode(i) for i in ids] == [lib.decode(i, skip_special_tokens=False) for i in ids]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    lib = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = lib.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip_digests(docs, PATH).collect()} == want


def test_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (2, "a b", 7), (2, "a b", 7)], "doc_id long, text string, n_tokens int")
    got = encoded(docs, PATH).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == [(0, 2), (1, 0), (2, 2), (2, 2)]
    assert round_trip_digests(docs.limit(0), PATH).count() == 0
