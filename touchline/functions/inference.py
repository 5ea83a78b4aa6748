"""What names, labels and addresses say: cup rounds, amateur sides, gender, competition codes, slugs and team pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of a cup's late rounds.
LATE_ROUND = r"(?i)final|semi|quarter|round\s*of\s*16|1/8|1/4|1/2|\br16\b|\bqf\b|\bsf\b"
#: Marks of amateur sides.
AMATEUR = r"(?i)university|univ\.?|sangyo|college|high\s*school|amateur|\bacademy\b|\bu\d{2}\b"
#: Marks of women's competitions in their codes.
WOMEN = ("WOMEN", "WSL", "UWCL", "_W", "WCL")
#: What a competition's label says, in order of precedence.
COMPETITIONS = (
    (r"(?i)\bj1\b", "J1"),
    (r"(?i)\bj2\b", "J2"),
    (r"(?i)\bj3\b", "J3"),
    (r"(?i)emperor", "EMPERORS_CUP"),
    (r"(?i)afc\s*champions|asian\s*champions|\bacl\b", "ACL"),
    (r"(?i)j\.?\s*league\s*cup|levain", "J_LEAGUE_CUP"),
    (r"(?i)club\s*friendly|friendly", "FRIENDLY"),
    (r"(?i)\blaliga\b|la\s*liga", "LALIGA"),
    (r"(?i)premier\s*league", "EPL"),
    (r"(?i)champions\s*league\s*women|uwcl|women.?s\s*champions", "UWCL"),
    (r"(?i)women.?s\s*super\s*league|\bwsl\b", "WSL"),
)
#: A country's short name behind a team's, and the address of a team's page.
COUNTRY = r"\s*\([A-Za-z]{2,4}\)\s*$"
TEAM_PAGE = r"(?i)^(?:https?://)?(?:www\.)?[a-z0-9-]+\.[a-z.]+/team/([a-z0-9_-]+)/([a-z0-9]+)(?:/(?:results?)?)?/?(?:\?[^#\s]*)?(?:#\S*)?\s*$"


def blank(s: Column) -> Column:
    return s.isNull() | (F.trim(s) == "")


def early_cup_round(label: Column) -> Column:
    """True unless the label names a late round; a missing one counts as early."""
    return blank(label) | ~label.rlike(LATE_ROUND)


def amateur(name: Column) -> Column:
    return F.coalesce(name.rlike(AMATEUR), F.lit(False))


def gender(code: Column) -> Column:
    """``W`` or ``M`` by the competition's code; men's where nothing is known."""
    return F.when(F.upper(F.trim(code)).rlike("|".join(WOMEN)), "W").otherwise("M")


def competition_code(label: Column, other: str) -> Column:
    """The code of the first rule that the label meets, ``other`` if none does."""
    out = F.lit(other)
    for pattern, code in reversed(COMPETITIONS):
        out = F.when(label.rlike(pattern), code).otherwise(out)
    return out


def without_country(name: Column) -> Column:
    """``Ulsan (Kor)`` reads ``Ulsan``."""
    return F.trim(F.regexp_replace(F.trim(name), COUNTRY, ""))


def versus(slug: Column) -> Column:
    """Both sides of ``A_B_vs_C`` with blanks for underscores; null if there aren't two."""
    side = lambda i: F.trim(F.regexp_replace(F.get(F.split(slug, "(?i)_vs_", 2), F.lit(i)), "_", " "))
    pair = F.struct(side(0).alias("home"), side(1).alias("away"))
    return F.when((F.length(side(0)) > 0) & (F.length(side(1)) > 0), pair)


def team_page(url: Column) -> Column:
    """Slug and code of a team page's address; null for other addresses."""
    part = lambda i: F.regexp_extract(F.trim(url), TEAM_PAGE, i)
    return F.when(F.trim(url).rlike(TEAM_PAGE), F.struct(part(1).alias("slug"), part(2).alias("code")))
