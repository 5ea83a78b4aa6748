"""Corpus operators take part in all of their input."""

from pyspark.sql import functions as F

from touchline.llm import gru_lm, ngram_quality, quality_rules


def test_gru_rounds_share_out_all_training_documents(spark):
    rows = [(i if i else None, i % 5 == 1) for i in range(300)]
    encoded = spark.createDataFrame(rows, "doc_id long, held_out boolean")
    seen = [r.doc_id for k in range(gru_lm.ROUNDS) for r in gru_lm.of_round(encoded, k).collect()]
    assert sorted(seen, key=str) == sorted((i for i, held in rows if not held), key=str)


def test_gru_training_takes_every_document(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    real, taken = gru_lm.of_round, []
    monkeypatch.setattr(gru_lm, "of_round", lambda encoded, k, rounds=gru_lm.ROUNDS: taken.append(real(encoded, k, rounds).count()) or real(encoded, k, rounds))
    rows = gru_lm.lm_scores(docs).collect()
    assert len(rows) == 200 and sum(taken) == sum(not r.held_out for r in rows)


def test_good_rows_keep_their_own_verdict(spark):
    good = " ".join(f"word{i}" for i in range(40))
    bad = "too short"
    rows = [(None, good, "en", "s"), (None, bad, "en", "s"), (7, good, "en", "s"), (7, bad, "en", "s"), (8, good, None, None), (9, None, None, "s")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_words int")
    kept = [(r.doc_id, r.text) for r in quality_rules.keep_good(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, good), (7, good), (8, good)], key=str)


def test_few_trusted_documents_take_the_pooled_threshold(spark):
    assert ngram_quality.ORDER == 5
    rows = [(i, f"plain words number {i} of the usual kind", "aa" if i < 200 else "bb") for i in range(203)] + [(900, "plain words number 5 of the usual kind", "bb")]
    docs = spark.createDataFrame([*rows, (901, "\x01\x02 zq#%& 0x7f~~" * 60, "aa")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(203)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ngram_quality.quality_classifier(docs, labels).collect()}
    assert len(got) == 205 and all(r.perplexity is not None and r.threshold is not None for r in got.values())
    assert not got[901].kept and got[5].kept
