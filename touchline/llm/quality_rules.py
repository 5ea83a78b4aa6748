"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

``document_stats`` counts a document's words, symbols, repeated lines and repeated five-word windows in one Arrow pass.
``outlier_verdicts`` turns the counts into six transformed statistics and fits location and scatter of every (language,
source) group.  As usual for this estimate, concentration first runs to its end on a subset of each group, from three starts;
its best solutions then start concentration steps over all rows of the group until the determinants settle.  The solution of
least determinant is made consistent for the normal law and reweighted once over the rows within the 0.975 quantile.  A row is
rejected beyond the 0.9999 quantile of its squared Mahalanobis distance (column ``cutoff``).  That quantile is the chi-square
law's, or, where a group's own distances have heavier tails, the one that their quartiles give (``own_cutoff``): cube roots of
chi-square distances are nearly normal, so median and quartile range of the cube roots extend to the quantile.

Scale: the texts are read once; the steps run over a table of a few numbers per row.  Subsets are bounded and only start the
steps.  A step is two map-side combined aggregations keyed by group and start, so a group holding a third of all rows costs no
more than any other; solutions that have settled leave the next step.  Parameters (one row per group) are written and joined
back; Spark broadcasts them only if their written size is below its threshold.

Defined results: null text counts as no text; null language or source is a group of its own value; groups under
``min_group`` rows are pooled by language, then altogether; rows of a pool still too small are judged by an estimate over all
rows; empty tables give empty results; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import as_bytes, stored, unstore, unused

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rows a group needs for its own estimate.
MIN_GROUP = 200
#: Share of rows in the concentrated half.
H_SHARE = 0.75
#: Most concentration steps over all rows, and the change of a log-determinant below which it has settled.
STEPS = 20
SETTLED = 1e-3
#: Rows of a group on which concentration starts, and how many of its solutions go on to all rows.
SUBSET = 2000
SOLUTIONS = 2
#: Rows that a subset must have; groups below (whose rows repeat) start from their plain moments.
LEAST_SUBSET = 30
#: Steps on a subset.
SUBSET_STEPS = 200
#: Tasks that invert matrices, one row each for a group and start.
INVERTING = 16
#: Quantiles of the chi-square law with six degrees of freedom: 0.9999 (beyond it a row is rejected) and 0.975 (reweighting).
CUTOFF = 27.856
REWEIGHTED = 14.449
#: Consistency factors of the scatter of the rows within the 0.75 and the 0.975 quantile: share / chi-square law with eight degrees there.
CONSISTENT_H = 0.75 / 0.5509
CONSISTENT_REWEIGHTED = 0.975 / 0.9293
#: The normal law's 0.9999 quantile, and its quartile range.
NORMAL_9999, NORMAL_RANGE = 3.719, 1.349
#: Median of the chi-square law with six degrees of freedom.
CHI2_6_MEDIAN = 5.348
#: Characters of pseudo-count by which shares of short texts are drawn to zero.
PRIOR_CHARS = 200.0
#: Least standard deviation of each transformed statistic.
FLOORS = (0.04, 0.02, 0.03, 0.02, 0.05, 0.05)
#: The group of all rows.
EVERY = "every"
FEATURES = tuple(f"x{i}" for i in range(len(FLOORS)))
P = len(FEATURES)

_CLASS = np.zeros(256, np.uint8)
_CLASS[0x80:0xC0] = 1
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 2
_CLASS[list(b"#*$%&|<>")] = 3
_CLASS[ord("A") : ord("Z") + 1] = 4
_CLASS[list(b"!?{}[]()=_^~@\\/")] = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)

STATS = pa.schema(
    [("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "text_key")]
)
STATS_DDL = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, text_key long"


def repeated_window_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in ``width``-word windows occurring at least twice in the text, the first occurrence included."""
    n = len(words)
    if n <= width:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = sum(ids[i : n - width + 1 + i] * _MIX[i] for i in range(width))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    seen: dict[tuple, list[int]] = {}
    for i in at.tolist():  # equal hashes are confirmed by the words themselves
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    edge = np.zeros(n + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                edge[i] += 1
                edge[i + width] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks) of a UTF-8 text."""
    words = text.split()
    by = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text) - int(by[1]) - int(by[2]), int(by[3]), len(lines) - len(set(lines)), repeated_window_words(words), int(by[4]), int(by[5]))


def _stats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = [text_counts(t) for t in as_bytes(b.column(3))]
        cols = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([*(b.column(i).cast(t) for i, t in enumerate(STATS.types[:3])), *(pa.array(c, pa.int64()) for c in cols), b.column(4)], schema=STATS)


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def document_stats(docs: DataFrame) -> DataFrame:
    """One row of counts per document, with a hash of its text."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), _text_key().alias("text_key")]
    return docs.select(*cols).mapInArrow(_stats, STATS_DDL)


def with_base_rule(stats: DataFrame) -> DataFrame:
    return stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def with_features(stats: DataFrame) -> DataFrame:
    """Six transformed statistics; shares are square-rooted and shrunk for short texts."""
    share = lambda c: F.sqrt(F.col(c) / (F.col("word_chars") + PRIOR_CHARS))
    words = F.col("n_words") + F.lit(PRIOR_CHARS / 6)
    xs = (
        F.log((F.col("word_chars") + PRIOR_CHARS) / words),
        share("n_symbols"),
        share("n_upper"),
        share("n_marks"),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return stats.withColumns(dict(zip(FEATURES, xs)))


def _grouped(stats: DataFrame, min_group: int) -> DataFrame:
    """``grp``: own group, else the language's pool, else the common pool."""
    sized = stored(stats.groupBy("lang", "source").count(), "group-sizes")
    small = sized.where(F.col("count") < min_group)
    pools = small.groupBy(F.col("lang").alias("p_lang")).agg(F.sum("count").alias("pool"))
    key = lambda *c: F.to_json(F.array(*(F.coalesce(F.concat(F.lit("="), x), F.lit("null")) for x in c)))
    lang, source = F.col("lang"), F.col("source")
    named = sized.join(pools, lang.eqNullSafe(F.col("p_lang")), "left").select(
        lang.alias("g_lang"),
        source.alias("g_source"),
        F.when(F.col("count") >= min_group, key(lang, source)).when(F.col("pool") >= min_group, key(lang)).otherwise(F.lit("pool")).alias("grp"),
    )
    named = stored(named, "groups")
    return stats.join(named, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))).drop("g_lang", "g_source")


_PARAMS = "grp string, start int, logdet double, moved double, " + ", ".join([f"m{i} double" for i in range(P)] + [f"q{i}_{j} double" for i in range(P) for j in range(i, P)])


def _inverter(consistent: float):
    return lambda it: _inverted(it, consistent)


def _inverted(it: Iterator[pd.DataFrame], consistent: float) -> Iterator[pd.DataFrame]:
    """Mean, inverse covariance and log-determinant from one row of moments per group and start."""
    floor = np.diag(np.square(FLOORS))
    for moments in it:
        out = []
        for r in moments.itertuples(index=False):
            n = max(r.n, 1.0)
            mean = np.array([getattr(r, f"s{i}") for i in range(P)]) / n
            cov = np.zeros((P, P))
            for i in range(P):
                for j in range(i, P):
                    cov[i, j] = cov[j, i] = getattr(r, f"s{i}_{j}") / n - mean[i] * mean[j]
            cov = consistent * cov + floor
            inv = np.linalg.inv(cov)
            logdet = float(np.linalg.slogdet(cov)[1])
            out.append((r.grp, r.start, logdet, abs(logdet - r.before), *mean, *(inv[i, j] for i in range(P) for j in range(i, P))))
        yield pd.DataFrame(out, columns=_NAMES)


_NAMES = [c.split()[0] for c in _PARAMS.split(", ")]


def _params_of(rows: DataFrame, consistent: float = 1.0) -> DataFrame:
    """Parameters by group and start; ``moved`` is the change of the log-determinant that the rows come with."""
    x = [F.col(f) for f in FEATURES]
    sums = [F.max("logdet").alias("before"), F.count("*").cast("double").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(P)), *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P))]
    return rows.groupBy("grp", "start").agg(*sums).coalesce(INVERTING).mapInPandas(_inverter(consistent), _PARAMS)


def _with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    joined = rows.join(params, "grp")
    d = [F.col(FEATURES[i]) - F.col(f"m{i}") for i in range(P)]
    terms = [d[i] * d[j] * F.col(f"q{i}_{j}") * (1.0 if i == j else 2.0) for i in range(P) for j in range(i, P)]
    return joined.withColumn("d2", sum(terms[1:], terms[0])).select("grp", "start", "logdet", *FEATURES, "d2")


def subset_solutions(x: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(log-determinant, mean, inverse scatter) of the best distinct solutions on a subset, least determinant first.

    Starts: medians and lower quartiles, both with quartile scales, and plain moments.
    """
    floor, h = np.diag(np.square(FLOORS)), max(int(np.ceil(H_SHARE * len(x))), 1)
    low, mid, high = np.quantile(x, (0.25, 0.5, 0.75), axis=0)
    spread = np.diag(((high - low) / NORMAL_RANGE) ** 2) + floor
    found: list[tuple[float, np.ndarray, np.ndarray]] = []
    for mean, cov in ((mid, spread), (low, spread), (x.mean(0), np.cov(x.T, bias=True) + floor)):
        last = np.inf
        for _ in range(SUBSET_STEPS):
            d = x - mean
            near = x[np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), kind="stable")[:h]]
            mean, cov = near.mean(0), CONSISTENT_H * np.cov(near.T, bias=True) + floor
            logdet = float(np.linalg.slogdet(cov)[1])
            if abs(last - logdet) < 1e-9:
                break
            last = logdet
        if all(abs(logdet - f[0]) > SETTLED for f in found):
            found.append((logdet, mean, np.linalg.inv(cov)))
    return sorted(found, key=lambda f: f[0])[:SOLUTIONS]


def _subset_params(rows: pd.DataFrame) -> pd.DataFrame:
    if len(rows) < LEAST_SUBSET:
        return pd.DataFrame([], columns=_NAMES)
    upper = [(i, j) for i in range(P) for j in range(i, P)]
    found = subset_solutions(rows[list(FEATURES)].to_numpy(float))
    out = [(rows["grp"].iloc[0], k, logdet, np.inf, *mean, *(inv[i, j] for i, j in upper)) for k, (logdet, mean, inv) in enumerate(found)]
    return pd.DataFrame(out, columns=_NAMES)


def _starts(rows: DataFrame) -> DataFrame:
    """Solutions on a subset of at most ``SUBSET`` rows of each group, by hash."""
    sizes = rows.groupBy("grp").agg(F.count("*").alias("size"))
    draw = F.xxhash64("doc_id", *FEATURES)
    drawn = rows.withColumn("draw", draw).join(sizes, "grp").where(F.pmod("draw", F.lit(1 << 20)) * F.col("size") < 3 * SUBSET * (1 << 20))
    k = F.row_number().over(Window.partitionBy("grp").orderBy("draw", "doc_id", *FEATURES))
    subset = drawn.withColumn("k", k).where(F.col("k") <= SUBSET).select("grp", *FEATURES)
    solved = stored(subset.groupBy("grp").applyInPandas(_subset_params, _PARAMS), "mcd")
    other = rows.join(solved.select("grp"), "grp", "left_anti").select("grp", F.lit(0).alias("start"), F.lit(float("inf")).alias("logdet"), *FEATURES)
    return solved.unionByName(_params_of(other))


def mcd(rows: DataFrame, h_share: float = H_SHARE, steps: int = STEPS) -> DataFrame:
    """Reweighted estimates per group, with ``scale`` that brings the median distance to the normal law's, ``cutoff``, and
    ``settled``: whether the group's best solution settled within ``steps``."""
    active = stored(_starts(rows), "mcd")
    made, ended = [active], []
    for _ in range(steps):
        far = _with_distance(rows, active)
        cut = far.groupBy("grp", "start").agg(F.percentile_approx("d2", h_share, 10_000).alias("cut"))
        near = far.join(cut, ["grp", "start"]).where("d2 <= cut")
        nxt = stored(_params_of(near, CONSISTENT_H), "mcd")
        made.append(nxt)
        ended.append(nxt.where(F.col("moved") < SETTLED))
        active = nxt.where(F.col("moved") >= SETTLED)
        if active.isEmpty():
            break
    params = reduce(DataFrame.unionByName, ended, active)
    best = params.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    best = stored(params.join(best, ["grp", "start"]), "mcd")
    unstore(*made)
    within = _with_distance(rows, best).where(F.col("d2") <= REWEIGHTED)
    again = stored(best.select("grp").join(_params_of(within, CONSISTENT_REWEIGHTED), "grp"), "mcd")
    few = best.join(again.select("grp"), "grp", "left_anti")  # no row of the group lies within: the raw estimate stands
    raw = best
    best = stored(again.unionByName(few), "mcd")
    quartiles = _with_distance(rows, best).groupBy("grp").agg(F.percentile_approx("d2", F.array(*map(F.lit, (0.25, 0.5, 0.75))), 2000).alias("q"))
    root = lambda k: F.cbrt(F.col("q")[k] / F.col("scale"))
    tail = F.pow(root(1) + NORMAL_9999 / NORMAL_RANGE * (root(2) - root(0)), 3)
    scaled = quartiles.withColumn("scale", F.greatest(F.lit(1.0), F.col("q")[1] / CHI2_6_MEDIAN))
    settled = raw.select("grp", (F.col("moved") < SETTLED).alias("settled"))
    return best.join(scaled.select("grp", "scale", tail.alias("cutoff")), "grp").join(settled, "grp")


def outlier_verdicts(stats: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, also: tuple[str, ...] = ()) -> DataFrame:
    """``stats`` with ``base_failed``, ``distance``, ``cutoff``, ``own_cutoff``, ``settled``, ``kept`` and the columns ``also``;
    ``cutoff`` is the least one of a group."""
    stats = with_features(with_base_rule(stats))
    fit_rows = _grouped(stats.where("NOT base_failed"), min_group)
    fit_rows = stored(fit_rows.select("doc_id", "lang", "source", "grp", *FEATURES), "features")
    sizes = stored(fit_rows.groupBy("grp").agg(F.count("*").alias("n")), "pool-sizes")
    groups = fit_rows.select("lang", "source", "grp").distinct().join(sizes, "grp")
    groups = stored(groups.select("lang", "source", F.when(F.col("n") >= min_group, F.col("grp")).otherwise(F.lit(EVERY)).alias("grp")), "groups")
    large = sizes.where(F.col("n") >= min_group).select("grp")
    mine = fit_rows.join(large, "grp")
    if not groups.where(F.col("grp") == EVERY).isEmpty():
        mine = mine.unionByName(fit_rows.withColumn("grp", F.lit(EVERY)))
        mine = stored(mine, "features")
    params = stored(mcd(mine), "mcd-final")
    per_group = groups.join(params, "grp", "left").withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    per_group = stored(per_group, "group-parameters")
    unstore(fit_rows, sizes, groups)
    joined = stats.join(per_group, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    d = [F.col(FEATURES[i]) - F.col(f"m{i}") for i in range(P)]
    terms = [d[i] * d[j] * F.col(f"q{i}_{j}") * (1.0 if i == j else 2.0) for i in range(P) for j in range(i, P)]
    judged = joined.withColumn("distance", sum(terms[1:], terms[0]) / F.col("scale"))
    judged = judged.withColumn("own_cutoff", F.col("cutoff") > cutoff).withColumn("cutoff", F.greatest(F.lit(cutoff), F.col("cutoff")))
    near = F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True))  # no distance: all rows of its group failed the base rule
    return judged.withColumn("kept", ~F.col("base_failed") & near).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "cutoff", "own_cutoff", "settled", "kept", *also
    )


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts and verdict of every document; texts are read once."""
    return outlier_verdicts(stored(document_stats(docs), "doc-stats"), cutoff, min_group)


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with the columns they came with.

    A verdict follows from language, source and text, so these find a row's own verdict also if its id is null or shared.
    """
    kept = outlier_verdicts(stored(document_stats(docs), "doc-stats"), cutoff, min_group, ("text_key",)).where("kept")
    names = dict(zip(("doc_id", "lang", "source", "text_key"), unused(docs, "kept_doc_id", "kept_lang", "kept_source", "kept_text_key")))
    kept = kept.select(*(F.col(c).alias(to) for c, to in names.items())).distinct()
    own = {"doc_id": F.col("doc_id").cast("long"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"), "text_key": _text_key()}
    same = [v.eqNullSafe(F.col(names[c])) for c, v in own.items()]
    return docs.join(kept, same, "left_semi")
