"""Paper trading as a keyed stream: observations known at a time become pending bets, within the caps of day and league.

Gates and Kelly scaling are Column expressions.  What depends on earlier decisions is state of a day: what is used of its caps,
and the bets open on each match.  Observations wait until the clock has passed the time they became known and are then decided
in that order, so decisions don't depend on how rows come in batches; an observation that comes after the clock has passed it is
decided on arrival.  A new day starts with nothing used, because a day is a key; the state of a past day is dropped by a timer.

Defined results: an observation that fails a gate is told on arrival and opens nothing, so it need not wait; a bet on a match and selection that is
open stays single; later bets on a match with open ones get ``DISCOUNT`` less; a null league is one of its own.  Caps make a day
a sequence, so one task decides it, holding sums, open bets and rows that wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import pricing as P

MIN_DATA_SCORE, MIN_EV = 50.0, 0.05
DISCOUNT = 0.30
DAY_CAP, LEAGUE_CAP = 0.05, 0.03
LATENESS = "1 hour"
#: Days after its end for which a day's state is kept.
KEPT_DAYS = 3
DAY_MS = 86_400_000
TINY = 1e-15

_WAITING = "obs_id long, match_id long, known long, league string, market string, selection string, gate string, scaled double"
_USED = "league string, used double"
_OPEN = "match_id long, market string, selection string"
DECIDED = "obs_id long, match_id long, market string, selection string, gate string, stake double, known_ms long"


def gate(p: Column, odds: Column, data_score: Column, no_bet: Column) -> Column:
    """The first rule that an observation fails, else ``ok``."""
    ev, k = P.expected_value(p, odds), P.full_kelly(p, odds)
    return F.when(F.coalesce(no_bet, F.lit(False)), "pipeline").when(ev.isNull() | (p <= 0), "invalid").when(~(data_score >= MIN_DATA_SCORE) | data_score.isNull(), "data").when(ev < MIN_EV, "ev").when(k <= 0, "kelly").otherwise("ok")


def scaled_stake(p: Column, odds: Column, data_score: Column, confidence: Column) -> Column:
    """Kelly fraction by data score and confidence, both of a hundred."""
    share = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)) / 100.0
    return P.full_kelly(p, odds) * P.KELLY_MULTIPLIER * share(data_score) * share(confidence)


def decide(rows: list[tuple], used: dict[str | None, float], opened: set[tuple], day_cap: float = DAY_CAP, league_cap: float = LEAGUE_CAP) -> list[tuple]:
    """Decisions on waiting rows in order; ``used`` (by league) and ``opened`` go along."""
    out, matches = [], {o[0] for o in opened}
    for obs, match, known, league, market, selection, why, scaled in rows:
        stake = 0.0
        if why == "ok":
            key = (match, market, selection)
            stake = min(scaled * (1.0 - DISCOUNT if match in matches else 1.0), P.STAKE_CAP)
            if key in opened:
                why, stake = "pending", 0.0
            elif stake <= 0.0:
                why, stake = "zero", 0.0
            elif stake > day_cap - sum(used.values()) + TINY:
                why, stake = "day cap", 0.0
            elif stake > league_cap - used.get(league, 0.0) + TINY:
                why, stake = "league cap", 0.0
            else:
                used[league] = used.get(league, 0.0) + stake
                opened.add(key)
                matches.add(match)
        out.append((obs, match, market, selection, why, stake, known))
    return out


class Trading(StatefulProcessor):
    """One day's sequence of decisions."""

    def __init__(self, day_cap: float, league_cap: float):
        self.caps = day_cap, league_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.used, self.opened = (handle.getListState(n, s) for n, s in (("waiting", _WAITING), ("used", _USED), ("opened", _OPEN)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True)
        fresh = fresh[fresh["obs_id"].notna()].astype({"obs_id": "int64", "match_id": "int64", "known": "int64"}).fillna({"scaled": 0.0})
        stakes = fresh["gate"] == "ok"
        yield fresh[~stakes].assign(stake=0.0).rename(columns={"known": "known_ms"})[[c.split()[0] for c in DECIDED.split(", ")]]
        new = list(zip(*(fresh.loc[stakes, c.split()[0]].tolist() for c in _WAITING.split(", "))))
        yield self._turn(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._turn(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _turn(self, key, new: list[tuple], watermark: int) -> pd.DataFrame:
        rows = sorted([tuple(r) for r in self.waiting.get()] + new, key=lambda r: (r[2], r[0]))
        ready = [r for r in rows if r[2] <= watermark]
        left = rows[len(ready) :]
        done = []
        if ready:
            used, opened = dict(map(tuple, self.used.get())), set(map(tuple, self.opened.get()))
            done = decide(ready, used, opened, *self.caps)
            for state, held in ((self.used, list(used.items())), (self.opened, sorted(opened, key=repr))):
                if held:
                    state.put(held)
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][2])
        else:
            self.waiting.clear()
            over = (int(key[0]) + 1 + KEPT_DAYS) * DAY_MS
            if watermark >= over:
                self.used.clear()
                self.opened.clear()
            else:
                self.handle.registerTimer(over)
        return pd.DataFrame(done, columns=[c.split()[0] for c in DECIDED.split(", ")])


def paper_trades(observations: DataFrame, day_cap: float = DAY_CAP, league_cap: float = LEAGUE_CAP) -> DataFrame:
    """Decisions (``DECIDED``, stake above zero where a bet is placed) on a stream of observations: obs_id, match_id, known_at, league,
    market, selection, p, odds, data_score, confidence, no_bet.  Rows whose ``obs_id`` is null only move the clock."""
    c = F.col
    rows = observations.select("obs_id", "match_id", F.unix_millis("known_at").alias("known"), "league", "market", "selection", gate(c("p"), c("odds"), c("data_score"), c("no_bet")).alias("gate"), scaled_stake(c("p"), c("odds"), c("data_score"), c("confidence")).alias("scaled"), c("known_at").alias("clock"))
    kinds = {"obs_id": "long", "match_id": "long", "known": "long", "league": "string", "market": "string", "selection": "string", "gate": "string", "scaled": "double"}
    content = F.struct(*(c(n).cast(t).alias(n) for n, t in kinds.items()), F.lit(None).cast("timestamp").alias("at"))
    ticking = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in kinds.items()), c("clock").alias("at"))  # moves the clock, is never missed
    both = rows.select(F.floor(c("known") / DAY_MS).cast("int").alias("day"), F.explode(F.array(content, ticking)).alias("e")).select("day", "e.*").withWatermark("at", LATENESS)
    both = both.where("at IS NULL")  # the copies have moved the clock and need not be dealt
    return both.groupBy("day").transformWithStateInPandas(statefulProcessor=Trading(day_cap, league_cap), outputStructType=DECIDED, outputMode="Append", timeMode="EventTime")
