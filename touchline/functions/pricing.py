"""Column functions of pricing and settlement: expected value, stakes, margins, ranks, pay-outs and closing-line value."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KELLY_MULTIPLIER = 0.10
STAKE_CAP = 0.01
LABELS = ("LOSS", "HALF_LOSS", "PUSH", "HALF_WIN", "WIN")
SHIN_STEPS = 50


def _sum(xs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def valid_price(odds: Column) -> Column:
    return odds.isNotNull() & ~F.isnan(odds) & (odds > 1.0)


def implied(odds: Column) -> Column:
    """1 / odds, null unless a price above one."""
    return F.when(valid_price(odds), 1.0 / odds)


def expected_value(p: Column, odds: Column) -> Column:
    """p * odds - 1, null outside the domain."""
    return F.when(valid_price(odds) & p.between(0.0, 1.0), p * odds - 1.0)


def full_kelly(p: Column, odds: Column) -> Column:
    """Kelly fraction clipped to [0, 1]."""
    return F.when(expected_value(p, odds).isNotNull(), F.least(F.greatest((p * odds - 1.0) / (odds - 1.0), F.lit(0.0)), F.lit(1.0)))


def capped_kelly(p: Column, odds: Column, multiplier: float = KELLY_MULTIPLIER, cap: float = STAKE_CAP) -> Column:
    return F.least(full_kelly(p, odds) * multiplier, F.lit(cap))


def overround(*odds: Column) -> Column:
    """Sum of implied probabilities, null unless all prices are valid."""
    return _sum([implied(o) for o in odds])


def devig_multiplicative(*odds: Column) -> list[Column]:
    total = overround(*odds)
    return [implied(o) / total for o in odds]


def devig_additive(*odds: Column) -> list[Column]:
    """Equal margin taken from each implied probability, floored at zero and renormalised."""
    share = (overround(*odds) - 1.0) / len(odds)
    cut = [F.when(share.isNotNull(), F.greatest(implied(o) - share, F.lit(0.0))) for o in odds]
    return [c / _sum(cut) for c in cut]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def devig_shin(*odds: Column) -> Column:
    """Array of fair probabilities by Shin's insider model; the share z solves sum p(z) = 1 by bisection in one expression."""
    total = lambda pi: F.aggregate(pi, F.lit(0.0), lambda a, x: a + x)
    prob = lambda x, z, t: (F.sqrt(z * z + 4.0 * (1.0 - z) * x * x / t) - z) / (2.0 * (1.0 - z))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0 - 1e-9).alias("hi"))

    def halve(pi: Column, t: Column, s: Column) -> Column:
        def step(mid: Column) -> Column:
            above = F.aggregate(pi, F.lit(0.0), lambda a, x: a + prob(x, mid, t)) > 1.0
            return F.struct(F.when(above, mid).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

        return let((s["lo"] + s["hi"]) / 2.0, step)

    def solved(pi: Column, t: Column) -> Column:
        z = F.aggregate(F.sequence(F.lit(1), F.lit(SHIN_STEPS)), start, lambda s, _: halve(pi, t, s), lambda s: (s["lo"] + s["hi"]) / 2.0)
        raw = let(F.when(t > 1.0, z).otherwise(F.lit(0.0)), lambda v: F.transform(pi, lambda x: prob(x, v, t)))
        return let(raw, lambda f: let(total(f), lambda n: F.transform(f, lambda x: x / n)))

    return F.when(overround(*odds).isNotNull(), let(F.array(*(implied(o) for o in odds)), lambda pi: let(total(pi), lambda t: solved(pi, t))))


def american_to_decimal(a: Column) -> Column:
    return F.round(F.when(a > 0, 1.0 + a / 100.0).when(a < 0, 1.0 + 100.0 / F.abs(a)), 3)


def quarter_split(line: Column) -> tuple[Column, Column]:
    """The two half-goal lines of a quarter line; twice the line itself if whole or half."""
    return F.floor(line * 2) / 2, F.ceil(line * 2) / 2


def rank(value: Column, line: Column) -> Column:
    """-2 .. 2: sum of the signs of ``value`` minus both halves of the line."""
    low, high = quarter_split(line)
    return (F.signum(value - low) + F.signum(value - high)).cast("int")


def rank_of_bet(market: Column, selection: Column, line: Column, home: Column, away: Column) -> Column:
    """Settlement rank of a bet on a final score.  An away handicap's line is the away side's own."""
    outcome = F.when(home > away, "H").when(home < away, "A").otherwise("D")
    over = rank((home + away).cast("double"), line)
    side = F.when(selection == "Home", home - away).otherwise(away - home)
    return (
        F.when(market == "1X2", F.when(selection == outcome, 2).otherwise(-2))
        .when(market == "OU", F.when(selection == "Over", over).otherwise(-over))
        .when(market == "AH", _handicap(side, line))
    )


def _handicap(margin: Column, line: Column) -> Column:
    low, high = quarter_split(line)
    return (F.signum(margin + low) + F.signum(margin + high)).cast("int")


def label(r: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), r + 2)


def profit(r: Column, odds: Column, stake: Column) -> Column:
    """Profit by rank: whole or half win at odds - 1, whole or half loss of the stake."""
    return F.when(r > 0, stake * (odds - 1.0) * r / 2.0).otherwise(stake * r / 2.0)


def payout(r: Column, odds: Column, stake: Column) -> Column:
    return stake + profit(r, odds, stake)


def commission(pnl: Column, rate: float) -> Column:
    """Commission is taken from winnings only."""
    return F.when(pnl > 0, pnl * (1.0 - rate)).otherwise(pnl)


def clv_ratio(taken: Column, close: Column) -> Column:
    return F.when(valid_price(taken) & valid_price(close), taken / close - 1.0)


def clv_log(taken: Column, fair_close: Column) -> Column:
    return F.when(valid_price(taken) & valid_price(fair_close), F.ln(taken / fair_close))


def push_adjusted(win: Column, half_win: Column, half_loss: Column, lose: Column) -> Column:
    """W' / (W' + L') with halves counted by half."""
    w, lo = win + half_win / 2.0, lose + half_loss / 2.0
    return F.try_divide(w, w + lo)


def stake_at_risk(win: Column, half_win: Column, half_loss: Column, lose: Column) -> Column:
    return win + lose + (half_win + half_loss) / 2.0


def settlement_ev(win: Column, half_win: Column, half_loss: Column, lose: Column, odds: Column) -> Column:
    b = odds - 1.0
    return win * b + half_win * b / 2.0 - half_loss / 2.0 - lose


def xg_proxy(shots: Column, on_target: Column) -> Column:
    """0.1 a shot and 0.3 a shot on target; a missing term counts zero."""
    return F.coalesce(shots, F.lit(0)) * 0.1 + F.coalesce(on_target, F.lit(0)) * 0.3


def xg_strict(shots: Column, on_target: Column) -> Column:
    """The same, null if either is missing."""
    return shots * 0.1 + on_target * 0.3


def settlement_kelly(win: Column, half_win: Column, half_loss: Column, lose: Column, odds: Column, steps: int = 50) -> Column:
    """Fraction of greatest expected log growth over the five settlements, by bisection on the slope; zero without an edge."""
    return settlement_kellys([(win, half_win, half_loss, lose, odds)], steps=steps)[0]


def settlement_kellys(sides: Sequence[tuple[Column, Column, Column, Column, Column]], most: float | None = None, steps: int = 50) -> list[Column]:
    """``settlement_kelly`` of several sides (masses and odds) of one row, which goes to Python once; at most ``most``, if given.

    The steps run over whole Arrow batches, sides without an edge or beyond ``most`` left out; a higher-order function would walk
    each step row by row, and conditions on every side as columns make methods that Java leaves uncompiled.
    """
    n = len(sides)

    @F.pandas_udf(", ".join(f"f{k} double" for k in range(n)))
    def solved(*columns: pd.Series) -> pd.DataFrame:
        out = {}
        for k in range(n):
            *masses, odds = (c.to_numpy("float64", na_value=np.nan) for c in columns[5 * k : 5 * k + 5])
            b = odds - 1.0
            win, half_win, half_loss, lose = masses
            found = np.where(odds > 1.0, 0.0, np.nan)  # no number is null
            edge = (odds > 1.0) & (win * b + half_win * b / 2.0 - half_loss / 2.0 - lose > 0)
            if most is not None:
                with np.errstate(all="ignore"):  # prices without an edge may be anything
                    beyond = edge & (sum(m * v / (1.0 + most * v) for m, v in zip(masses, (b, b / 2.0, -0.5, -1.0))) > 0)
                found[beyond] = most
                edge &= ~beyond
            asked = np.flatnonzero(edge)
            x = b[asked]
            terms = [(m[asked] * v, v) for m, v in zip(masses, (x, x / 2.0, -0.5, -1.0))]
            lo, hi = np.zeros(len(asked)), np.full(len(asked), 1.0 - 1e-9)
            for _ in range(steps):
                mid = (lo + hi) / 2.0
                up = sum(mv / (1.0 + mid * v) for mv, v in terms) > 0
                lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
            found[asked] = (lo + hi) / 2.0
            out[f"f{k}"] = found
        return pd.DataFrame(out)

    found = solved(*(c for side in sides for c in (*side[:4], F.when(valid_price(side[4]), side[4]))))
    return [found[f"f{k}"] for k in range(n)]
