"""Model fits: team strengths, count rates, calibrators and an outcome classifier.

Fits read sufficient statistics (sums by pair of teams), which Spark aggregates; a fit's group is bounded by the square
of the number of teams however many matches there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.jobs import shared_folder
from .quasi_newton import bounded_minimum

DECAY = 0.0018
STRENGTH_LIMIT = 3.0
#: Bounds of the home advantage and of the low-score parameter; their starts.
ADVANTAGE, RHO = (0.0, 1.5), (-0.2, 0.1)
ADVANTAGE_START, RHO_START = 0.25, -0.05
#: Least value of a low-score factor under the logarithm.
LEAST_FACTOR = 1e-10
MIN_CALIBRATION = 80
FIT = "comp string, team int, att double, def double, advantage double, rho double, n double"


def pair_statistics(matches: DataFrame, home: str, away: str, by: str = "comp", decay: float = DECAY) -> DataFrame:
    """Weighted sums by pair: weight, both counts, and the four low-score cells."""
    latest = matches.groupBy(by).agg(F.max("match_date").alias("latest"))
    w = F.exp(-decay * F.date_diff("latest", "match_date"))
    cell = lambda x, y: F.sum(F.when((F.col(home) == x) & (F.col(away) == y), F.col("w")).otherwise(0.0)).alias(f"n{x}{y}")
    rows = matches.where(F.col(home).isNotNull() & F.col(away).isNotNull()).join(latest, by).withColumn("w", w)
    return rows.groupBy(by, "home", "away").agg(F.sum("w").alias("w"), F.sum(F.col(home) * F.col("w")).alias("gh"), F.sum(F.col(away) * F.col("w")).alias("ga"), cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))


class PairLikelihood:
    """Weighted log-likelihood of goals from sums by pair of teams, with the low-score factor inside.

    Parameters: attacks, defences but the last (defences sum to zero), home advantage, low-score parameter.
    """

    def __init__(self, stats: pd.DataFrame):
        self.teams = np.array(sorted(set(stats["home"]) | set(stats["away"])))
        self.h, self.a = np.searchsorted(self.teams, stats["home"]), np.searchsorted(self.teams, stats["away"])
        self.w, self.gh, self.ga, self.n00, self.n01, self.n10, self.n11 = (stats[c].to_numpy(float) for c in ("w", "gh", "ga", "n00", "n01", "n10", "n11"))

    def unpacked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        n = len(self.teams)
        return x[:n], np.r_[x[n : 2 * n - 1], -x[n : 2 * n - 1].sum()], x[-2], x[-1]

    def loss(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative log-likelihood (without factorials) and its gradient."""
        att, dfn, adv, rho = self.unpacked(x)
        log_h, log_a = att[self.h] - dfn[self.a] + adv, att[self.a] - dfn[self.h]
        lh, la = np.exp(log_h), np.exp(log_a)
        cells = ((self.n00, -lh * la, 1, 1), (self.n01, lh, 1, 0), (self.n10, la, 0, 1), (self.n11, -np.ones_like(lh), 0, 0))  # factor 1 + rho * slope
        value = (self.gh * log_h - self.w * lh + self.ga * log_a - self.w * la).sum()
        d_h, d_a, d_rho = self.gh - self.w * lh, self.ga - self.w * la, 0.0
        for count, slope, of_h, of_a in cells:
            factor = np.maximum(1 + rho * slope, LEAST_FACTOR)
            value += (count * np.log(factor)).sum()
            part = np.where(1 + rho * slope > LEAST_FACTOR, count * slope / factor, 0.0)
            d_rho += part.sum()
            d_h, d_a = d_h + of_h * rho * part, d_a + of_a * rho * part
        n = len(self.teams)
        total = lambda i, v: np.bincount(i, weights=v, minlength=n)
        g_att, g_dfn = total(self.h, d_h) + total(self.a, d_a), -total(self.a, d_h) - total(self.h, d_a)
        return -value, -np.r_[g_att, g_dfn[:-1] - g_dfn[-1], d_h.sum(), d_rho]

    def fitted(self, rho: tuple[float, float] = RHO) -> tuple[np.ndarray, float]:
        """Parameters of greatest likelihood within their bounds, and the negative log-likelihood."""
        n = len(self.teams)
        low = np.r_[np.full(2 * n - 1, -STRENGTH_LIMIT), ADVANTAGE[0], rho[0]]
        high = np.r_[np.full(2 * n - 1, STRENGTH_LIMIT), ADVANTAGE[1], rho[1]]
        return bounded_minimum(self.loss, np.r_[np.zeros(2 * n - 1), ADVANTAGE_START, RHO_START], low, high)


def _fit(stats: pd.DataFrame, rho: tuple[float, float]) -> pd.DataFrame:
    """Strengths, home advantage and low-score parameter of one competition, all at once, by greatest likelihood."""
    like = PairLikelihood(stats)
    x, _ = like.fitted(rho)
    att, dfn, adv, low = like.unpacked(x)
    n = np.bincount(like.h, weights=like.w, minlength=len(like.teams)) + np.bincount(like.a, weights=like.w, minlength=len(like.teams))
    return pd.DataFrame({"comp": stats["comp"].iloc[0], "team": like.teams, "att": att, "def": dfn, "advantage": adv, "rho": low, "n": n})


def fit_group(stats: pd.DataFrame) -> pd.DataFrame:
    return _fit(stats, RHO)


def fit_strengths(matches: DataFrame, decay: float = DECAY) -> DataFrame:
    """Attack, defence, home advantage and low-score parameter by competition."""
    return pair_statistics(matches, "fthg", "ftag", "comp", decay).groupBy("comp").applyInPandas(fit_group, FIT)


def fit_counts(matches: DataFrame) -> DataFrame:
    """The same log-linear fit for corner counts, unweighted and without low-score factors."""
    return pair_statistics(matches, "hc", "ac", "comp", 0.0).groupBy("comp").applyInPandas(lambda stats: _fit(stats, (0.0, 0.0)), FIT)


COUNTS = "comp string, home int, away int, rate_home double, rate_away double, dispersion double"


def log_linear(h: np.ndarray, a: np.ndarray, w: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """Fitted means by pair of a Poisson model on the factors home and away side, from sums ``y`` over ``w`` matches.

    Iteratively reweighted least squares; a side without any count gets means that tend to zero.
    """
    n_h, n_a = h.max() + 1, a.max() + 1
    x = np.zeros((len(h), n_h + n_a - 1))
    x[np.arange(len(h)), h] = 1.0
    later = a > 0  # the first away side is the base
    x[np.flatnonzero(later), n_h + a[later] - 1] = 1.0
    eta = np.log(np.maximum(y / w, 0.1))
    for _ in range(steps):
        mu = np.exp(np.clip(eta, -30.0, 30.0))
        weight = w * mu
        z = eta + (y - weight) / np.maximum(weight, 1e-12)
        beta = np.linalg.lstsq(x * np.sqrt(weight)[:, None], z * np.sqrt(weight), rcond=1e-12)[0]
        new = np.clip(x @ beta, -30.0, 30.0)
        moved, eta = np.abs(new - eta).max(), new
        if moved < 1e-10:
            break
    return np.exp(eta)


def count_group(stats: pd.DataFrame) -> pd.DataFrame:
    """Rates by pair from one model for each side's counts, and the dispersion of totals around the fitted ones."""
    homes, h = np.unique(stats["home"], return_inverse=True)
    aways, a = np.unique(stats["away"], return_inverse=True)
    w, yh, ya, squares = (stats[c].to_numpy(float) for c in ("w", "gh", "ga", "squares"))
    home, away = log_linear(h, a, w, yh), log_linear(h, a, w, ya)
    mu, total = home + away, yh + ya
    excess = (squares - 2 * mu * total + w * mu**2 - w * mu).sum()
    alpha = float(np.clip(excess / (w * mu**2).sum(), 0.0, 1.0)) if w.sum() >= 2 else 0.0
    return pd.DataFrame({"comp": stats["comp"].iloc[0], "home": homes[h], "away": aways[a], "rate_home": home, "rate_away": away, "dispersion": alpha})


def count_rates(matches: DataFrame, home: str = "hc", away: str = "ac") -> DataFrame:
    """Poisson rates of both sides' counts by competition and pair, with the negative-binomial dispersion of their total."""
    rows = matches.where(F.col(home).isNotNull() & F.col(away).isNotNull())
    sums = rows.groupBy("comp", "home", "away").agg(F.count("*").alias("w"), F.sum(home).alias("gh"), F.sum(away).alias("ga"), F.sum(F.pow(F.col(home) + F.col(away), 2)).alias("squares"))
    return sums.groupBy("comp").applyInPandas(count_group, COUNTS)


def dispersion(matches: DataFrame, column: str, by: str) -> DataFrame:
    """Negative-binomial dispersion by moments, clipped to [0, 1]."""
    m, v = F.avg(column), F.var_samp(column)
    return matches.groupBy(by).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v - m, m * m))).alias("dispersion"))


def platt(rows: DataFrame, p: str, y: str):
    """Logistic calibration on the logit; None without enough rows of both classes."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-4)), F.lit(1 - 1e-4))
    ok = rows.where(F.col(p).isNotNull()).select(F.ln(q / (1 - q)).alias("logit"), F.col(y).cast("double").alias("label"))
    n = ok.agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if n["n"] < MIN_CALIBRATION or n["lo"] == n["hi"]:
        return None
    return Pipeline(stages=[VectorAssembler(inputCols=["logit"], outputCol="features"), LogisticRegression(maxIter=50)]).fit(ok)


def isotonic(rows: DataFrame, p: str, y: str):
    """Isotonic calibration under the same conditions."""
    ok = rows.where(F.col(p).isNotNull()).select(F.col(p).alias("features"), F.col(y).cast("double").alias("label"))
    n = ok.agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    return None if n["n"] < MIN_CALIBRATION or n["lo"] == n["hi"] else IsotonicRegression().fit(ok)


def outcome_classifier(rows: DataFrame, features: list[str], label: str):
    """Multinomial logistic model of the result with mean-imputed features."""
    ok = rows.select(*(F.col(c).cast("double").alias(c) for c in features), F.when(F.col(label) == "H", 0.0).when(F.col(label) == "D", 1.0).otherwise(2.0).alias("label"))
    filled = [f"{c}_filled" for c in features]
    stages = [Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), LogisticRegression(maxIter=30, family="multinomial")]
    return Pipeline(stages=stages).fit(ok)


#: Classes of a result by label, and the share of days, oldest first, on which trees are grown; the rest calibrates them.
OUTCOMES = ("H", "D", "A")
GROWN_SHARE = 0.75
TREES, DEPTH = 20, 3


class BoostedOutcomes:
    """One boosted model a class, each calibrated on later days than it was grown on, normalised to one."""

    def __init__(self, split, features: list[str], imputer, trees: list, calibrators: list):
        self.split, self.features, self.imputer, self.trees, self.calibrators = split, features, imputer, trees, calibrators

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``ph, pd, pa``."""
        kept = rows.columns
        out = self.imputer.transform(rows.select("*", *(F.col(c).cast("double").alias(f"boosted_{c}") for c in self.features)))
        for k, (grown, calibrator) in enumerate(zip(self.trees, self.calibrators)):
            margin = _margin(grown, out, f"boosted_margin_{k}")
            out = calibrator.setProbabilityCol(f"boosted_p_{k}").setRawPredictionCol(f"boosted_raw_{k}").setPredictionCol(f"boosted_y_{k}").setFeaturesCol(f"boosted_margin_{k}").transform(margin)
        p = [vector_to_array(f"boosted_p_{k}")[1] for k in range(len(OUTCOMES))]
        total = sum(p[1:], p[0])
        return out.select(*kept, *((x / total).alias(n) for x, n in zip(p, ("ph", "pd", "pa"))))

    def importances(self, spark) -> DataFrame:
        """``outcome, feature, importance``, the weights of each class's model, which sum to one."""
        rows = [(o, f, float(v)) for o, grown in zip(OUTCOMES, self.trees) for f, v in zip(self.features, grown.featureImportances.toArray())]
        return spark.createDataFrame(rows, "outcome string, feature string, importance double")


def _margin(grown, rows: DataFrame, name: str) -> DataFrame:
    """A boosted model's margin for its class, as a vector of one."""
    raw = grown.setRawPredictionCol("boosted_raw").setPredictionCol("boosted_y").setProbabilityCol("boosted_p").transform(rows)
    return raw.withColumn(name, array_to_vector(F.array(vector_to_array("boosted_raw")[1]))).drop("boosted_raw", "boosted_y", "boosted_p")


def boosted_outcomes(rows: DataFrame, features: list[str], label: str = "ftr", day: str = "match_date", share: float = GROWN_SHARE, trees: int = TREES, depth: int = DEPTH) -> BoostedOutcomes:
    """Boosted trees for each outcome against the others, grown on the oldest ``share`` of rows by day; sigmoids of their margins
    fitted on the later days.  Missing features take the mean of the grown days.  ``ValueError`` if either slice lacks an outcome.
    """
    known = rows.where(F.col(label).isin(*OUTCOMES)).select(F.datediff(day, F.lit("1970-01-01")).alias("boosted_day"), F.col(label).alias("boosted_label"), *(F.col(c).cast("double").alias(f"boosted_{c}") for c in features))
    folder = shared_folder(known.sparkSession, "boosted")  # every tree reads these rows; their windows are not run again for each
    known.write.parquet(folder)
    known = known.sparkSession.read.schema(known.schema).parquet(folder)
    split = known.agg(F.percentile_approx("boosted_day", share, 10_000)).first()[0]
    early = known.where(F.col("boosted_day") <= F.lit(split))
    late = known.where(F.col("boosted_day") > F.lit(split))
    for part in (early, late):
        if {r[0] for r in part.select("boosted_label").distinct().collect()} != set(OUTCOMES):  # three values
            raise ValueError("each slice must hold every outcome")
    names = [f"boosted_{c}" for c in features]
    stages = [Imputer(inputCols=names, outputCols=[f"{n}_filled" for n in names]), VectorAssembler(inputCols=[f"{n}_filled" for n in names], outputCol="boosted_features")]
    imputer = Pipeline(stages=stages).fit(early)
    filled, after = (imputer.transform(x).select("boosted_features", "boosted_label") for x in (early, late))
    grown, sigmoids = [], []
    for outcome in OUTCOMES:
        target = (F.col("boosted_label") == outcome).cast("double").alias("boosted_target")
        model = GBTClassifier(featuresCol="boosted_features", labelCol="boosted_target", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=42).fit(filled.select("boosted_features", target))
        margins = _margin(model, after.select("boosted_features", target), "boosted_margin")
        grown.append(model)
        sigmoids.append(LogisticRegression(featuresCol="boosted_margin", labelCol="boosted_target", maxIter=50).fit(margins))
    return BoostedOutcomes(split, features, imputer, grown, sigmoids)
