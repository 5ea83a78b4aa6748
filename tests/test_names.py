"""Name resolution against brute force over all names and keys, in several scripts and with any type of id."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest

from touchline.operators import names as N

PARTS = ["manchester", "united", "city", "real", "madrid", "köln", "malmö", "спартак", "москва", "динамо", "神戸", "大阪", "ヴィッセル", "서울", "ολυμπιακός", "al", "ah", "x", "fc", "91", "ＳＣ", "straße"]


def mixed_names(seed, n):
    rng = random.Random(seed)
    return sorted({" ".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 4))) for _ in range(n)})


def misspelt(rng, name):
    for _ in range(rng.randrange(0, 4)):
        at = rng.randrange(len(name) + 1)
        name = rng.choice([name[:at] + name[at + 1 :], name[:at] + rng.choice("aeиx神 ") + name[at:], name.upper(), name])
    return name


def brute(asked, entities, threshold, floor):
    keys = {(e, N.fold(a)) for e, a in entities if N.fold(a)}
    owners = Counter(k for _, k in keys)
    out = {}
    for name in set(asked):
        key = N.fold(name)
        own = [e for e, k in keys if k == key and owners[k] == 1]
        if own:
            out[name] = (own[0], 1.0, "key")
            continue
        scored = sorted((-SequenceMatcher(None, key, k).ratio(), e) for e, k in keys) if key else []
        score = -scored[0][0] if scored else 0.0
        out[name] = (scored[0][1], score, "fuzzy") if score >= threshold else (None, score if score >= floor else 0.0, "staged")
    return out


@pytest.mark.parametrize("seed,text_ids", [(1, False), (2, True)])
def test_resolution_equals_brute_force_over_mixed_scripts(spark, seed, text_ids):
    rng = random.Random(seed)
    known = mixed_names(seed, 150)
    entities = [(f"id{i % 120}" if text_ids else i % 120, a) for i, a in enumerate(known)]
    asked = [misspelt(rng, rng.choice(known)) for _ in range(250)] + ["", " ", "!!!", "神戸", "Z", "ab", "abc", None]
    kind = "string" if text_ids else "long"
    got = N.resolve(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame(entities, f"entity {kind}, alias string"))
    assert {r.name: (r.entity, pytest.approx(r.score), r.step) for r in got.collect()} == brute(asked, entities, 0.8, 0.5)


def test_no_pair_of_short_or_repeating_keys_is_lost(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(400)})
    frame = spark.createDataFrame([(w,) for w in words], "key string")
    for t in (0.5, 0.8, 0.9):
        want = {(a, b) for a in words for b in words if SequenceMatcher(None, a, b).ratio() >= t}
        assert {(r.key, r.other) for r in N.similar(frame, frame, t).collect()} == want


def test_few_pairs_meet(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(10, 18)))
    keys = [word() for _ in range(2000)]
    asked = [k[:5] + k[6:] for k in keys[::4]]
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    assert N.candidates(frame(asked), frame(keys), 0.8).count() < 0.002 * len(asked) * len(keys)
    got = {r.key: r.other for r in N.similar(frame(asked), frame(keys), 0.8).collect()}
    assert got == dict(zip(asked, keys[::4]))


def test_other_scripts_and_empty_keys(spark):
    entities = spark.createDataFrame([("s", "Спартак"), ("v", "ヴィッセル神戸"), ("e", "!!!")], "entity string, alias string")
    asked = spark.createDataFrame([("神戸",), ("спартак",), ("???",), ("ウ゛ィッセル神戸",)], "name string")
    got = {r.name: (r.entity, r.step) for r in N.resolve(asked, entities).collect()}
    assert got["神戸"][0] is None and got["спартак"] == ("s", "key") and got["???"] == (None, "staged")
    assert N.fold("FC Köln") == "koln" and N.fold("ＡＣ Ｍｉｌａｎ") == "acmilan" and N.fold("Ωμέγα") == "ωμεγα"
