"""The recurrent language model: word hashes, training that doesn't depend on partitions, trees of averages."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from touchline.llm import gru_lm


def test_words_and_endings_against_splitting():
    rng = random.Random(3)
    parts = ["", "a", "Zeta", "\tb\n", "é" * 70, "x" * 64, "X" * 65, "q" * 5000, "\x0b\x0c", "naïve café", "1 2  3\r\n4"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(8))).encode() for _ in range(300)]
    h, ending, n = gru_lm.hashes_and_endings(texts)
    words = [t.lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    by_word = {}
    for w, x, e in zip(flat, h.tolist(), ending.tolist()):
        assert by_word.setdefault(w, (x, e)) == (x, e)
    assert len({x for x, _ in by_word.values()}) == len(by_word)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "CHUNK_BYTES", 4000)  # many chunks
    monkeypatch.setattr(gru_lm, "FAN_IN", 3)  # a tree of several levels
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), (F.col("id") * k % 17).cast("string")) for k in range(1, 25))).alias("text"))
    got = [{r.doc_id: r.score for r in gru_lm.lm_scores(d).collect()} for d in (docs.repartition(7, "text"), docs.coalesce(1).orderBy(F.desc("doc_id")))]
    assert len(got[0]) == 300 and all(abs(got[0][k] - got[1][k]) < 1e-5 for k in got[0]), max(abs(got[0][k] - got[1][k]) for k in got[0])  # widths of batches round apart


def test_training_by_hand(spark, monkeypatch):
    """The distributed rounds equal a plain loop over chunks, rounds and averages."""
    monkeypatch.setattr(gru_lm, "CHUNK_BYTES", 1500)
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), (F.col("id") * k % 11).cast("string")) for k in range(1, 12))).alias("text"))
    seen = {}
    real = gru_lm.trained
    monkeypatch.setattr(gru_lm, "trained", lambda encoded, v, n, rounds: seen.setdefault("model", real(seen.setdefault("encoded", encoded), seen.setdefault("v", v), seen.setdefault("n", n), rounds)))
    scores = {r.doc_id: r.score for r in gru_lm.lm_scores(docs).collect()}
    rows = seen["encoded"].withColumn("round", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(gru_lm.ROUNDS))).collect()
    model = gru_lm.Model.fresh(seen["v"])
    for k in range(gru_lm.ROUNDS):
        total, n = 0, 0
        for c in range(seen["n"]):
            mine = sorted((r.doc_id, bytes(r.ids)) for r in rows if r["round"] == k and r.chunk == c and not r.held_out)
            if mine:
                docs_ = [gru_lm._sequence(x) for _, x in mine]
                tokens = sum(len(d) - 1 for d in docs_)
                total = total + tokens * gru_lm.train(model, docs_).weights.astype(np.float64)
                n += tokens
        model = gru_lm.Model((total / n).astype(np.float32))
    assert np.allclose(model.weights, seen["model"].weights, atol=1e-5)
    for r in rows:
        assert abs(gru_lm.log10_of(model, [gru_lm._sequence(bytes(r.ids))])[0] + r.tail_score - scores[r.doc_id]) < 1e-3


def test_a_step_multiplies_once_for_all_parts_and_negates_no_gate(monkeypatch):
    """Element-wise numpy calls that a training window makes for each of its steps stay few."""
    v = gru_lm.Vocabulary([(h, 9) for h in range(40)], {}, 400, 40, 4)
    docs = [np.r_[gru_lm.START_ID, np.arange(3 * gru_lm.WINDOW) % 40, gru_lm.END_ID].astype(np.int64) for _ in range(4)]
    calls = {"multiply": 0, "negative": 0, "prod": 0}
    for name in calls:
        real = getattr(np, name)
        monkeypatch.setattr(np, name, lambda *a, _real=real, _name=name, **k: (calls.__setitem__(_name, calls[_name] + 1), _real(*a, **k))[1])
    gru_lm.train(gru_lm.Model.fresh(v), docs)
    windows = -(-(len(docs[0]) - 1) // gru_lm.WINDOW)
    assert calls["negative"] <= windows and calls["prod"] == 0 and calls["multiply"] <= windows * (2 * gru_lm.WINDOW + 4)


def test_texts_are_dealt_and_hashed_once(spark, monkeypatch):
    """Only the report of distinct words reads texts; what is encoded afterwards comes from its places of words."""
    plans, real = {}, gru_lm.stored
    monkeypatch.setattr(gru_lm, "stored", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().analyzed().toString()), real(df, name))[1])
    texts = {0: "a b a", 1: None, 2: "", 3: "B c", 4: "a  z\n", 7: "q"}
    rows = {r.doc_id: r for r in gru_lm.lm_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert "text" in plans["chunk-words"] and "text" not in plans["encoded"]
    assert {k: r.n_tokens for k, r in rows.items()} == {k: len((t or "").split()) + 1 for k, t in texts.items()}


def test_training_equals_plain_adam(monkeypatch):
    """Sums that leave rows without gradient as they are give the same weights as sums that decay at every step."""
    rng = np.random.default_rng(4)
    v = gru_lm.Vocabulary([(h, 900 - h) for h in range(gru_lm.HEAD)], {(e, g): (2, 2 + g * 8, 2) for e in range(16) for g in range(3)}, 5000, 60, 9)
    docs = [np.r_[gru_lm.START_ID, rng.integers(0, gru_lm.END_ID, n) // rng.integers(1, 9), gru_lm.END_ID] for n in rng.integers(0, 90, 90)] + [np.r_[gru_lm.START_ID, rng.integers(0, gru_lm.END_ID, 1500), gru_lm.END_ID]]
    start = gru_lm.Model(gru_lm.Model.fresh(v).weights.astype(np.float64))
    w, first, second, steps, real = start.weights.copy(), 0.0, 0.0, 0, gru_lm.Model._gradient

    def spy(self, x, target, live, h, g):
        nonlocal w, first, second, steps
        assert np.abs(self.weights - w).max() < 1e-9
        plain = gru_lm.Model(np.zeros_like(w))
        ids, of_ids, _ = real(gru_lm.Model(w.copy()), x, target, live, h, plain)
        plain.gx[ids] = of_ids
        grad = plain.weights / live.sum()
        grad *= min(1.0, 1.0 / (np.sqrt(grad @ grad) + 1e-9))
        first, second, steps = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad, steps + 1
        w = w - gru_lm.RATE * first / (1 - 0.9**steps) / (np.sqrt(second / (1 - 0.99**steps)) + 1e-6)
        return real(self, x, target, live, h, g)

    monkeypatch.setattr(gru_lm.Model, "_gradient", spy)
    got = gru_lm.train(start, docs)
    assert steps > 64 and np.abs(got.weights - w).max() < 1e-9


def test_places_are_read_back_at_every_width():
    """Counts of distinct words around one and two bytes, and none at all: encoded ids are those of each word's own hash."""
    rng = np.random.default_rng(6)
    for words in (0, 1, 2, 256, 257, 65_536, 65_537):
        drawn = rng.permutation(np.r_[np.arange(words), rng.integers(0, max(words, 1), 99 if words else 0)])
        texts = [" ".join(f"w{k}" for k in part) for part in np.array_split(drawn, 3)] + [None]
        docs = pa.table({"chunk": pa.array([5] * 4, pa.int32()), "doc_id": [4, None, 2, 1], "held_out": [False, True, False, False], "text": pa.array(texts, pa.string())})
        pre = gru_lm._report(docs)
        assert pre.column("n").to_numpy(zero_copy_only=False)[: words + 1].sum() == len(texts[0].split()) + len(texts[2].split())
        mine, rows = pre.slice(0, words), pre.slice(words + 1)
        shuffled = mine.take(pa.array(rng.permutation(words), pa.int64()))
        answers = pa.table({"h": shuffled.column("h"), "c": shuffled.column("n"), "ending": shuffled.column("ending")})
        head = [(k, c) for k, c in zip(mine.column("h").to_pylist(), mine.column("n").to_pylist()) if c][: gru_lm.HEAD]
        v = gru_lm.Vocabulary(head, {}, 100, 10, 3)
        got = gru_lm._encoder(v)(rows, answers)
        h, ending, n = gru_lm.hashes_and_endings([(t or "").encode() for t in texts])
        c = dict(zip(mine.column("h").to_pylist(), mine.column("n").to_pylist()))
        want = v.ids(h, np.array([c[x] for x in h.tolist()], np.int64), ending)
        assert np.concatenate([np.frombuffer(x, np.int16) for x in got.column("ids").to_pylist()]).tolist() == want.tolist()
        assert got.column("n_tokens").to_pylist() == (n + 1).tolist() and got.column("doc_id").to_pylist() == [4, None, 2, 1]
