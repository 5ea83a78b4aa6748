"""Column functions on names, selections and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Club words that carry no identity.
CLUB_WORDS = ("fc", "cf", "sc", "afc")
#: Books whose prices are taken as sharp.
SHARP_BOOKS = ("pinnacle", "betfair exchange", "betfair")


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def strip_accents(s: Column) -> Column:
    """Accents of Latin letters removed, in either case."""
    return F.translate(F.translate(s, ACCENTED, PLAIN), ACCENTED.upper().replace("SS", ""), PLAIN.upper())


def folded_key(s: Column) -> Column:
    """Lower case, one club word dropped from the front, letters and digits only."""
    words = "|".join(CLUB_WORDS)
    return F.regexp_replace(F.regexp_replace(squeeze(F.lower(strip_accents(s))), rf"^({words})\s+", ""), "[^a-z0-9]", "")


def team_key(s: Column, gender: Column) -> Column:
    """Key scoped by gender: ``&`` is and, club words go."""
    words = "|".join(CLUB_WORDS)
    plain = F.regexp_replace(F.lower(strip_accents(s)), "&", " and ")
    return F.concat_ws("_", F.regexp_replace(squeeze(F.regexp_replace(F.regexp_replace(plain, rf"\b({words})\b", " "), "[^a-z0-9 ]", " ")), " ", "-"), gender)


def slug(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(s)), "[^a-z0-9]+", "-"), F.lit("-"))


def humanise(code: Column) -> Column:
    """``JP_VISSEL_KOBE`` reads ``Vissel Kobe``."""
    return F.initcap(F.regexp_replace(F.lower(F.regexp_replace(code, "^[A-Z]{2}_", "")), "_", " "))


def match_key(day: Column, home: Column, away: Column) -> Column:
    return F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), home, away)


def is_sharp(book: Column) -> Column:
    plain = squeeze(F.lower(book))
    return plain.startswith("pinnacle") | plain.isin(*SHARP_BOOKS)


def parse_score(s: Column) -> tuple[Column, Column]:
    """Both numbers of ``3 - 0``; null if there aren't two."""
    ok = F.when(s.rlike(r"^\s*\d+\s*[-:]\s*\d+\s*$"), s)
    return (F.regexp_extract(ok, r"(\d+)\s*[-:]\s*(\d+)", i).cast("int") for i in (1, 2))


def parse_selection(s: Column) -> tuple[Column, Column]:
    """Label and signed line of ``AH Home -0.25``; the line is null where there is none."""
    number = r"\s([+-]?\d+(?:\.\d+)?)\s*$"
    line = F.when(s.rlike(number), F.regexp_extract(s, number, 1)).cast("double")
    return F.trim(F.regexp_replace(s, number, "")), line


def market_family(s: Column) -> Column:
    x = F.lower(s)
    return F.when(x.rlike("corner"), "corners").when(x.rlike("handicap|^ah"), "ah").when(x.rlike("over|under|total|^o/?u"), "ou").when(x.rlike("1x2|result"), "1x2").when(x.rlike("winner|moneyline|^ml"), "ml")
