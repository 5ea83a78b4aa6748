"""Evaluation metrics as aggregations: Brier score, log-loss, calibration error, reliability, multiclass scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10
#: Edges of ten equal bins as the running sums of a tenth give them.
EDGES = tuple(float(i) * 0.1 for i in range(BINS)) + (1.0,)
CLIP = 1e-15


def bin_of(p: Column) -> Column:
    """Bin number by exact edges: half-open, the last one closed."""
    out = F.lit(None).cast("int")
    for b in range(BINS):
        inside = (p >= EDGES[b]) & ((p <= EDGES[b + 1]) if b == BINS - 1 else (p < EDGES[b + 1]))
        out = F.when(inside, b).otherwise(out)
    return out


def log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def reliability(rows: DataFrame, p: str, y: str) -> DataFrame:
    """``bin, n, mean_p, mean_y`` of all bins, empty ones too."""
    bins = rows.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    found = rows.where(F.col(p).isNotNull()).groupBy(bin_of(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    return bins.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def binary_metrics(rows: DataFrame, p: str, y: str, by: str) -> DataFrame:
    """``n, brier, log_loss, ece`` by group in one pass: bins are summed first, groups from bins."""
    ok = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    bins = ok.groupBy(by, bin_of(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("sq"), F.sum(log_loss(F.col(p), F.col(y))).alias("sl"))
    total = F.sum("n")
    return bins.groupBy(by).agg(total.alias("n"), (F.sum("sq") / total).alias("brier"), (F.sum("sl") / total).alias("log_loss"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / total).alias("ece"))


def multiclass(rows: DataFrame, classes: dict[str, str], label: str) -> DataFrame:
    """Brier score summed over classes and log-loss; labels outside the classes are skipped."""
    known = rows.where(F.col(label).isin(*classes))
    hit = lambda k: F.when(F.col(label) == k, 1.0).otherwise(0.0)
    brier = sum((F.pow(F.col(c) - hit(k), 2) for k, c in classes.items()), F.lit(0.0))
    own = sum((F.col(c) * hit(k) for k, c in classes.items()), F.lit(0.0))
    return known.agg(F.count("*").alias("n"), F.avg(brier).alias("brier"), F.avg(-F.ln(F.greatest(own, F.lit(CLIP)))).alias("log_loss"))
