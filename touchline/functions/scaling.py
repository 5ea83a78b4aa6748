"""Column functions that scale, cap and classify model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label spellings of the journal and their one form.
LABEL_FORMS = {"WON": "WIN", "WIN": "WIN", "LOST": "LOSS", "LOSS": "LOSS", "REFUND": "VOID", "VOID": "VOID", "PUSH": "PUSH", "HALF_WON": "HALF_WIN", "HALF_LOST": "HALF_LOSS"}
PULL = 0.85
PULL_GRID = tuple(i / 20 for i in range(21))


def normal_label(label: Column) -> Column:
    forms = F.create_map(*(F.lit(x) for pair in LABEL_FORMS.items() for x in pair))
    return F.coalesce(F.try_element_at(forms, F.upper(F.trim(label))), F.upper(F.trim(label)))


def ev_fraction(ev: Column) -> Column:
    """Values within two are fractions already, others per cent."""
    return F.when(F.abs(ev) <= 2, ev).otherwise(ev / 100)


def quality_tier(score: Column, a: float = 80.0, b: float = 60.0, low: str = "C") -> Column:
    return F.when(score >= a, "A").when(score >= b, "B").otherwise(low)


def tier_scale(own_top: Column, other_top: Column, weight: Column) -> Column:
    """0.8 against or in weaker company, by four rules: either side outside the top flight, a light league, or unknown weight."""
    return F.when(~own_top | ~other_top | (F.coalesce(weight, F.lit(0.0)) < 0.85), 0.8).otherwise(1.0)


def sample_weight(n: Column, full: int = 100) -> Column:
    """Scale with the sample until it is full."""
    return F.least(n / full, F.lit(1.0))


def new_team_cap(pct: Column, thin: Column, cap: float = 0.005) -> Column:
    return F.when(thin, F.least(pct, F.lit(cap))).otherwise(pct)


def confidence_percent(x: Column) -> Column:
    """0-1 or 0-100 on the latter scale, clipped."""
    return F.least(F.greatest(F.when(x <= 1, x * 100).otherwise(x), F.lit(0.0)), F.lit(100.0))


def line_disparity(model: Column, book: Column, step: float = 0.25) -> Column:
    """Distance of two lines in whole quarter steps."""
    return step * F.round(F.abs(model - book) / step)


def tempered(probabilities: list[Column], temperature: Column | float) -> list[Column]:
    """softmax(log p / T)."""
    warm = [F.exp(F.ln(F.greatest(p, F.lit(1e-12))) / temperature) for p in probabilities]
    total = sum(warm[1:], warm[0])
    return [w / total for w in warm]


def pulled(model: list[Column], market: list[Column], share: float = PULL) -> list[Column]:
    mixed = [share * m + (1 - share) * k for m, k in zip(model, market)]
    total = sum(mixed[1:], mixed[0])
    return [m / total for m in mixed]
