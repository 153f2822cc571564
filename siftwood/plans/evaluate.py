"""Offline jobs over a built index: retrieval quality, calibration, memory capacity."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.operators import dense, evaluation, feedback, fusion, lexical
from siftwood.operators.index import Index
from siftwood.plans import search as plans
from siftwood.scratch import materialise


def eval_rank(queries: DataFrame, gold: DataFrame, index: Index, vectors: DataFrame, query_vectors: DataFrame, k: int = 50) -> DataFrame:
    """channel (bm25, dense, fused), n, r_at_1, r_at_5, r_at_10, mrr, ndcg_at_10."""
    sparse = materialise(lexical.bm25(lexical.query_terms(queries), index, k), "bm25")
    near = materialise(dense.topk(query_vectors, vectors, k), "near")
    lists = near.select("query_id", F.lit(0).alias("list_no"), "docid", "rank").unionByName(sparse.select("query_id", F.lit(1).alias("list_no"), "docid", "rank"))
    out = None
    for name, ranked in (("bm25", sparse), ("dense", near), ("fused", fusion.rrf(lists))):
        row = evaluation.rank_metrics(gold, ranked.where("rank < 10")).select(F.lit(name).alias("channel"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def calibrate(gold: DataFrame, near: DataFrame, sparse: DataFrame) -> dict[str, float]:
    """Curves for both channels: the first hit's raw score against whether it is right. Each is fitted on its own labels.

    gold: (query_id, docid), a few hundred probes; near and sparse: (query_id, docid, rank, score).
    """
    out = {}
    for a, b, hits in (("calib_a", "calib_b", near), ("calib_a2", "calib_b2", fusion.normalised(sparse).withColumn("score", F.col("norm")))):
        first = hits.where("rank = 0").join(gold.select("query_id", F.col("docid").alias("want")), "query_id").select("score", (F.col("docid") == F.col("want")).cast("int").alias("right")).toPandas()
        out[a], out[b] = evaluation.fit_logistic(first["score"].to_numpy(), first["right"].to_numpy())
    return out


def calibration_table(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    """name, value: what a store keeps of a calibration (``store.save(calibration=...)``)."""
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(values.items())], "name string, value double")


INVENTED = [a + b for a in ("квал", "мерт", "сю", "дрок", "торб", "аль", "прим", "хав") for b in ("андор", "ивен", "сель", "овин")]
WONDERS = ("о чём говорится в {} и при чём тут {}", "кто такой {} и чем занят {}", "расскажи про {} и {}", "как {} повлиял на {}")


def novel_questions(spark: SparkSession, n: int = 60, seed: int = 0) -> DataFrame:
    """query_id (below 0), text: questions about invented words, which no corpus can answer."""
    rng = np.random.default_rng(seed)
    pairs = [rng.choice(len(INVENTED), 2, replace=False) for _ in range(n)]
    return spark.createDataFrame([(-i - 1, WONDERS[i % len(WONDERS)].format(INVENTED[a], INVENTED[b])) for i, (a, b) in enumerate(pairs)], "query_id long, text string")


def recogniser_rows(photos: DataFrame, vectors: DataFrame, k: int = 40) -> DataFrame:
    """query_id, gold, other: the best cosine of a photo's own species and of any other among its k nearest, 0 without one.

    photos: (query_id, vec, species), held out; vectors: (docid, vec, species) of the stored photos.
    """
    near = dense.topk(photos, vectors, k).join(vectors.select("docid", F.col("species").alias("found")), "docid").join(photos.select("query_id", "species"), "query_id")
    own = F.col("found") == F.col("species")
    best = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(c, F.col("score"))), F.lit(0.0)))
    return near.groupBy("query_id").agg(best(own).alias("gold"), best(~own).alias("other"))


def recogniser_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall of rows (gold, other): a photo is right above the threshold, and wrong where another species is, or wins."""
    each = rows.select(F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"), "gold", "other")
    over = F.col("gold") >= F.col("threshold")
    wrong = ((F.col("other") >= F.col("threshold")) & ~over) | (over & (F.col("gold") < F.col("other")))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = each.groupBy("threshold").agg(one(over).alias("tp"), one(wrong).alias("fp"), one(~over).alias("fn"))
    ratio = lambda a, b: a / F.greatest(F.lit(1), b)
    return sums.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def journal_accuracy(journal: DataFrame, features: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """One row: how often the picked document has the best rerank score of those shown. features: (seq, docid, f)."""
    score = F.aggregate(F.zip_with("f", F.array(*(F.lit(float(w)) for w in weights)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    confirmed = journal.where("sign > 0").select("seq", "picked", F.explode("shown").alias("docid"))
    return evaluation.pairwise_accuracy(confirmed.join(features.select("seq", "docid", score.alias("score")), ["seq", "docid"]))


def scale(spark: SparkSession, n: int = 30_000, asked: int = 150) -> dict[str, float]:
    """Seconds to index and embed n facts and to search them, and recall at 1 and 10 of quotations of the facts."""
    import time

    rows = materialise(facts(spark, n).select("docid", "text"), "facts")
    began = time.perf_counter()
    index, (model, vectors) = Index.build(rows).stored(), dense.fit_and_embed(rows)
    vectors = materialise(vectors, "vectors")
    built = time.perf_counter()
    quoted = F.array_join(F.slice(F.split("text", " "), 3, 7), " ")
    queries = materialise(rows.orderBy(F.xxhash64("docid"), "docid").limit(asked).select(F.col("docid").alias("query_id"), quoted.alias("text")), "quoted")  # the feature: a report over so many probes
    found = materialise(plans.search(queries, index, vectors, model.embed(queries).select("query_id", "vec"), plans.Config(k=10)), "found")
    searched = time.perf_counter()
    place = found.where("docid = query_id").agg(F.coalesce(F.sum(F.when(F.col("place") == 0, 1).otherwise(0)), F.lit(0)).alias("first"), F.count("*").alias("ten")).first()
    total = max(1, queries.count())
    return {"stored": rows.count(), "build_s": built - began, "search_s": searched - built, "r_at_1": place["first"] / total, "r_at_10": place["ten"] / total}


NAMES = [f"Имя{i}" for i in range(30)]
ROLES = [f"роль{i}" for i in range(8)]
LABS = [f"лаборатория{i}" for i in range(12)]
PROJECTS = [f"проект{i}" for i in range(12)]


def facts(spark: SparkSession, n: int) -> DataFrame:
    """docid, text, question: the first n of the combinations of name, role, laboratory and project, in a hash's order."""
    rows = itertools.product(NAMES, ROLES, LABS, PROJECTS)
    made = [(f"{a}, {b}, работает в {c} над {d}.", f"Кто такой {a}, {b}, из {c}, и как идёт {d}?") for a, b, c, d in rows]
    order = np.random.default_rng(0).permutation(len(made))[:n]
    return spark.createDataFrame([(i, *made[k]) for i, k in enumerate(order.tolist())], "docid long, text string, question string")


def capacity(spark: SparkSession, sizes: list[int], asked: int = 300, conf: tuple[float, float] = (38.7, -28.0)) -> DataFrame:
    """stored, acc_at_1, false_confident, familiarity_known, familiarity_novel for growing numbers of facts.

    The first ``asked`` facts are asked for, which a hash has put there, or all where fewer are stored.
    """
    from siftwood.functions.numeric import calibrated

    out = None
    for m in sizes:
        rows = facts(spark, m)
        model = dense.Embedder({})
        stored = materialise(feedback.codes(model.embed(rows)), "facts")
        wanted = model.embed(rows.where(F.col("docid") < asked).select(F.col("docid").alias("query_id"), F.col("question").alias("text")))
        wanted = materialise(feedback.codes(wanted.select("query_id", "vec")), "asked")
        first = dense.topk(wanted, stored, 1).withColumn("conf", calibrated(F.col("score"), *conf))
        novel = model.embed(novel_questions(spark, asked))
        novel = feedback.codes(novel.select("query_id", "vec"))
        learned = materialise(feedback.trace(stored.select((F.col("docid") + 1).alias("ordinal"), "vec", "cells", F.lit(1.0).alias("amount")), decay=0.0), "trace")
        known = feedback.familiarity(wanted.unionByName(novel), learned)
        right = F.col("docid") == F.col("query_id")
        row = first.agg(F.lit(m).alias("stored"), F.avg(right.cast("double")).alias("acc_at_1"), F.avg((~right & (F.col("conf") >= 0.75)).cast("double")).alias("false_confident"))
        fam = known.agg(F.percentile(F.when(F.col("query_id") >= 0, F.col("familiarity")), F.lit(0.5)).alias("familiarity_known"), F.percentile(F.when(F.col("query_id") < 0, F.col("familiarity")), F.lit(0.5)).alias("familiarity_novel"))
        both = row.crossJoin(F.broadcast(fam))  # one row each
        out = both if out is None else out.unionByName(both)
    return out
