"""Arithmetic of scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def calibrated(raw: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(a * raw + b)))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def sif(count: Column, total: Column, a: float = 1e-3) -> Column:
    """Weight of a term by its share of the corpus; 1 for a term that was never seen."""
    share = F.coalesce(count, F.lit(0)) / total
    return F.when(share > 0, a / (a + share)).otherwise(F.lit(1.0))


def rrf(rank: Column) -> Column:
    """A list's contribution for its entry at a rank counted from 0."""
    return 1 / (RRF_K + rank + 1)


def zone(conf: Column, margin: Column, low: float = 0.35, mid: float = 0.75, delta: float = 0.02) -> Column:
    return F.when(conf.isNull() | (conf < low), "unknown").when(conf < mid, "unsure").when(margin < delta, "ambiguous").otherwise("confident")
