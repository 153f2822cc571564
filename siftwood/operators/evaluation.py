"""Offline evaluation: probes cut from the corpus, rank metrics, calibration, threshold sweeps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.functions import text as T


def probes(docs: DataFrame, n: int = 150, low: int = 6, high: int = 10, least: int = 14) -> DataFrame:
    """query_id (the source document), text: runs of 6 to 10 tokens from documents that have enough, chosen by a hash."""
    tokens = T.tokenize(F.col("text"))
    rows = docs.select("docid", tokens.alias("t")).where(F.size("t") >= least)
    # one digest that any engine has; the digits that choose say nothing of those that place
    digits = lambda a, n: F.conv(F.substring("digest", a, n), 16, 10).cast("long")
    cut = rows.withColumn("digest", F.md5(F.col("docid").cast("string"))).withColumn("h", digits(1, 8))
    cut = cut.withColumn("size", (low + digits(9, 6) % (high - low + 1)).cast("int")).withColumn("start", (digits(15, 8) % (F.size("t") - F.col("size") + 1)).cast("int"))
    chosen = cut.orderBy("h", "docid").limit(n)  # the feature: a report over n probes
    return chosen.select(F.col("docid").alias("query_id"), F.array_join(F.slice("t", F.col("start") + 1, F.col("size")), " ").alias("text"))


def rank_metrics(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row: n, r_at_1, r_at_5, r_at_10, mrr, ndcg_at_10. A miss has rank 99.

    gold: (query_id, docid); ranked: (query_id, docid, rank from 0).
    """
    place = gold.join(ranked.select("query_id", "docid", (F.col("rank") + 1).alias("r")), ["query_id", "docid"], "left").withColumn("r", F.coalesce("r", F.lit(99)))
    at = lambda k: F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"r_at_{k}")
    gain = F.when(F.col("r") <= 10, 1 / F.log2(F.col("r") + 1)).otherwise(0.0)
    return place.agg(F.count("*").alias("n"), at(1), at(5), at(10), F.avg(1 / F.col("r")).alias("mrr"), F.avg(gain).alias("ndcg_at_10"))


def sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 of (score, right): one pass with conditional sums."""
    row = scored.select(F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"), "score", "right")
    said = F.col("score") >= F.col("threshold")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = row.groupBy("threshold").agg(one(said & F.col("right")).alias("tp"), one(said & ~F.col("right")).alias("fp"), one(~said & F.col("right")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = sums.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def pick_threshold(swept: DataFrame, precision: float = 0.97) -> DataFrame:
    """The row with the largest recall among those precise enough; the lowest threshold wins ties."""
    fine = swept.where(F.col("precision") >= precision)
    return fine.orderBy(F.desc("recall"), F.asc("threshold")).limit(1)


def confusion(pairs: DataFrame, n: int = 10) -> DataFrame:
    """gold, pred, n of the commonest mistakes in (gold, pred)."""
    wrong = pairs.where(~F.col("gold").eqNullSafe(F.col("pred")))
    return wrong.groupBy("gold", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("gold"), F.asc("pred")).limit(n)


def percentiles(rows: DataFrame, value: Column, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    return rows.agg(*(F.percentile(value, F.lit(p)).alias(f"p{round(100 * p)}") for p in shares))


def pairwise_accuracy(shown: DataFrame) -> DataFrame:
    """One row: the share of events (seq, docid, score, picked) whose best shown document is the picked one."""
    best = shown.groupBy("seq", "picked").agg(F.max_by("docid", F.struct("score", -F.col("docid"))).alias("best"))
    return best.agg(F.avg((F.col("best") == F.col("picked")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def fit_logistic(raw: np.ndarray, label: np.ndarray, steps: int = 2000, rate: float = 5.0) -> tuple[float, float]:
    """a, b of sigmoid(a * raw + b) by gradient descent on a few thousand pairs. Constant input gives a flat curve at the mean."""
    raw, label = np.asarray(raw, float), np.asarray(label, float)
    if not len(raw) or np.ptp(raw) < 1e-12:
        mean = min(1 - 1e-6, max(1e-6, float(label.mean()) if len(label) else 0.5))
        return 0.0, float(np.log(mean / (1 - mean)))
    a = b = 0.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30))) - label
        a, b = a - rate * float((error * raw).mean()), b - rate * float(error.mean())
    return a, b
