"""Paper trading: the replay equals a loop over days, however rows come in batches."""

import datetime as dt
import random

import pytest

from touchline.functions.pricing import KELLY_MULTIPLIER, STAKE_CAP
from touchline.streaming import paper as T
from touchline.streaming.jobs import shared_folder
from touchline.streaming.settlement import settle_to

DDL = "obs_id long, match_id long, known_at timestamp, league string, market string, selection string, p double, odds double, data_score double, confidence double, no_bet boolean"
T0 = dt.datetime(2024, 5, 1)


def observations(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(minutes=rng.randrange(4 * 1440))
        rows.append((i, rng.randrange(60), at, rng.choice(["A", "A", "A", "A", "B", None]), rng.choice(["1X2", "OU"]), rng.choice("HDA"), rng.choice([None, 0.0, 0.3, 0.5, 0.6, 0.7]), rng.choice([1.0, 1.9, 2.2, 3.5]), rng.choice([None, 40.0, 60.0, 100.0]), rng.uniform(40, 120), rng.random() < 0.1))
    return rows


def loop(rows):
    """Every day anew, row by row."""
    out = {}
    for day in sorted({r[2].date() for r in rows}):
        used, opened = {}, []
        for i, match, at, league, market, selection, p, odds, score, conf, no_bet in sorted((r for r in rows if r[2].date() == day), key=lambda r: (r[2], r[0])):
            valid = p is not None and 0 < p <= 1 and odds > 1
            if no_bet or not valid or score is None or score < 50 or p * odds - 1 < 0.05:
                out[i] = 0.0
                continue
            stake = max(0.0, min((p * odds - 1) / (odds - 1), 1.0)) * KELLY_MULTIPLIER * min(score, 100) / 100 * min(conf, 100) / 100
            stake = min(stake * (0.7 if any(o[0] == match for o in opened) else 1.0), STAKE_CAP)
            fits = stake <= 0.05 - sum(used.values()) + 1e-15 and stake <= 0.03 - used.get(league, 0.0) + 1e-15
            if stake <= 0 or (match, market, selection) in opened or not fits:
                out[i] = 0.0
                continue
            used[league] = used.get(league, 0.0) + stake
            opened.append((match, market, selection))
            out[i] = stake
    return out


def replay(spark, batches):
    source, journal, log = (shared_folder(spark, x) for x in ("observations", "journal", "log"))
    for rows in batches:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(source)
        settle_to(T.paper_trades(spark.readStream.schema(DDL).parquet(source)), journal, log)
    return {r.obs_id: r for r in spark.read.parquet(journal).collect()}


FLUSH = (None, None, T0 + dt.timedelta(days=10), None, None, None, None, None, None, None, None)


def test_replay_equals_a_loop_over_days(spark):
    rows = observations()
    got = replay(spark, [[*rows, FLUSH]])
    want = loop(rows)
    assert {i: pytest.approx(r.stake) for i, r in got.items()} == want
    assert {"ok", "pipeline", "invalid", "data", "ev", "pending", "day cap", "league cap"} <= {r.gate for r in got.values()}
    assert all((r.stake > 0) == (r.gate == "ok") for r in got.values())


def test_batches_in_any_order_within_the_clock_decide_alike(spark):
    rows = sorted(observations(200, 2), key=lambda r: r[2])
    first, second = rows[:90], rows[90:]
    random.Random(3).shuffle(first)
    got = replay(spark, [first, second[::-1], [FLUSH]])
    assert {i: pytest.approx(r.stake) for i, r in got.items()} == loop(rows)


def test_rows_beyond_the_clock_wait(spark):
    rows = [(1, 1, T0, "A", "1X2", "H", 0.6, 2.2, 100.0, 100.0, False), (2, 2, T0 + dt.timedelta(days=1), "A", "1X2", "H", 0.6, 2.2, 100.0, 100.0, False)]
    assert set(replay(spark, [rows])) == {1}
    assert set(replay(spark, [rows, [FLUSH]])) == {1, 2}
