"""Rank fusion, calibrated confidence, zones, rerank features and scores, user corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.functions import numeric as N
from siftwood.functions import text as T

# The rerank features and their weights before any learning.
FEATURES = ("bm25", "bm25_head", "dense", "dense_nbr", "coverage", "len_norm", "rare_hit", "dan")
DEFAULT_WEIGHTS = (1.0, 0.6, 1.0, 0.5, 0.8, 0.3, 0.4, 0.4)


def rrf(lists: DataFrame, pool: int = 30) -> DataFrame:
    """query_id, docid, score, rank of the first ``pool`` by summed reciprocal ranks.

    lists: (query_id, list_no, docid, rank from 0). Equal sums stand in the order of first sight.
    """
    fused = lists.groupBy("query_id", "docid").agg(F.round(F.sum(N.rrf(F.col("rank"))), 12).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("seen.list_no"), F.asc("seen.rank"), F.asc("docid"))
    return fused.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < pool).select("query_id", "docid", "score", "rank")


def normalised(hits: DataFrame) -> DataFrame:
    """hits with norm: the score over the query's largest."""
    most = F.max("score").over(W.partitionBy("query_id"))
    return hits.withColumn("norm", F.when(most > 0, F.col("score") / most).otherwise(F.lit(0.0)))


def confidence(raw: Column, norm: Column, in_sparse: Column, a: float = 38.7, b: float = -28.0, a2: float = 4.0, b2: float = -2.0) -> Column:
    """From the cosine where there is one, at least 0.5 if lexical search agrees; else from the lexical score."""
    dense = N.calibrated(raw, a, b)
    return F.when(raw.isNull(), N.calibrated(F.coalesce(norm, F.lit(0.0)), a2, b2)).when(in_sparse, F.greatest(dense, F.lit(0.5))).otherwise(dense)


def features(pool: DataFrame) -> DataFrame:
    """Adds the eight features to pool.

    pool: query_terms and doc_terms (distinct), heading, bm25_raw, dense_raw, nbr_raw, dl, avgdl, rare (bool), dan.
    """
    n = F.greatest(F.lit(1), F.size("query_terms"))
    head = F.array_distinct(T.norm_terms(F.col("heading")))
    hit = F.size(F.array_intersect("query_terms", head)) / F.sqrt(n)
    bm = F.coalesce("bm25_raw", F.lit(0.0))
    return pool.withColumns(
        {
            "bm25": bm / (bm + 5.0),
            "bm25_head": hit / (hit + 2.0),
            "dense": F.greatest(F.lit(0.0), F.coalesce("dense_raw", F.lit(0.0))),
            "dense_nbr": F.greatest(F.lit(0.0), F.coalesce("nbr_raw", F.lit(0.0))),
            "coverage": F.size(F.array_intersect("query_terms", "doc_terms")) / n,
            "len_norm": 1.0 / (1.0 + F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl"))),
            "rare_hit": F.col("rare").cast("double"),
            "dan": F.coalesce(F.col("dan").cast("double"), F.lit(0.0)),
        }
    )


def linear(weights: tuple[float, ...] = DEFAULT_WEIGHTS) -> Column:
    out = F.lit(0.0)
    for name, w in zip(FEATURES, weights, strict=True):
        out = out + F.lit(float(w)) * F.col(name)
    return out


def rerank(pool: DataFrame, weights: tuple[float, ...] = DEFAULT_WEIGHTS, corrections: DataFrame | None = None, k: int = 3) -> DataFrame:
    """pool with ltr and place: the k best of each query; equal scores keep their fused rank.

    corrections: (query_id, docid, place from 0) lifts the first four by 2, 1.5, 1 and 0.5.
    """
    scored = pool.withColumn("ltr", linear(weights))
    if corrections is not None:
        lifted = corrections.where("place < 4").select("query_id", "docid", (2.0 - 0.5 * F.col("place")).alias("bonus"))
        scored = scored.join(lifted, ["query_id", "docid"], "left").withColumn("ltr", F.col("ltr") + F.coalesce("bonus", F.lit(0.0))).drop("bonus")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("ltr", 9)), F.asc("rank"))
    return scored.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)


def verdicts(ranked: DataFrame) -> DataFrame:
    """query_id, margin, zone from ranked (query_id, place, raw_cos, conf).

    The margin is the first's cosine less the second's, so it may be negative; 1 for a single candidate.
    """
    after = F.lead("raw_cos").over(W.partitionBy("query_id").orderBy("place"))
    first = ranked.withColumn("margin", F.coalesce(F.col("raw_cos") - after, F.lit(1.0))).where("place = 0")
    return first.select("query_id", "margin", N.zone(F.col("conf"), F.col("margin")).alias("zone"))


def neighbours(docs: DataFrame) -> DataFrame:
    """docid, nbr: the documents next to each in number that have the same source; two null sources are alike."""
    pairs = docs.select("docid", "source").withColumn("near", F.explode(F.array(F.col("docid") - 1, F.col("docid") + 1)))
    other = docs.select(F.col("docid").alias("nbr"), F.col("source").alias("of"))
    return pairs.join(other, (F.col("near") == F.col("nbr")) & F.col("source").eqNullSafe(F.col("of"))).select("docid", "nbr")
