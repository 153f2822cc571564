"""Linear probes on vectors: a binary and a multinomial logistic regression with a held-out share."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.scratch import fresh_path


def split(rows: DataFrame, label: Column, held: float = 0.2) -> DataFrame:
    """rows (docid, vec) with label (double), features, and held_out by a hash of docid, so each class is split alike."""
    h = F.pmod(F.xxhash64(F.lit("probe"), "docid"), F.lit(1 << 20)) / (1 << 20)
    return rows.select("docid", array_to_vector(F.col("vec").cast("array<double>")).alias("features"), label.cast("double").alias("label"), (h < held).alias("held_out"))


def probe(rows: DataFrame, ridge: float = 1e-3, rounds: int = 100):
    """The fitted model of split() rows and its predictions on the held-out ones (docid, label, prediction).

    The model is stored and read back, which leaves out its training summary: that of two classes holds the session, and
    once the session has observed a query, neither can be sent to the executors.
    """
    family = "auto"
    path = fresh_path(rows.sparkSession, "probe")
    LogisticRegression(regParam=ridge, maxIter=rounds, family=family).fit(rows.where(~F.col("held_out"))).save(path)
    model = LogisticRegressionModel.load(path)
    return model, model.transform(rows.where("held_out")).select("docid", "label", "prediction")


def weights(model) -> DataFrame:
    """class, intercept, coefficients of a fitted probe: what a store keeps of it. A binary probe has the row of class 1 only."""
    from pyspark.sql import SparkSession

    table, shift = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = [(i if len(table) > 1 else 1, float(b), [float(x) for x in row]) for i, (row, b) in enumerate(zip(table, shift, strict=True))]
    return SparkSession.active().createDataFrame(rows, "class int, intercept double, coefficients array<double>")


def predicted(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """docid, prediction of rows (docid, vec) by stored weights: the class with the largest sum, or for a binary probe whether it is above 0."""
    dot = F.aggregate(F.zip_with("vec", "coefficients", lambda a, b: a.cast("double") * b), F.col("intercept"), lambda s, x: s + x)
    each = rows.select("docid", "vec").crossJoin(F.broadcast(stored)).select("docid", "class", dot.alias("s"))  # one row a class
    best = each.groupBy("docid").agg(F.max_by("class", F.struct("s", -F.col("class"))).alias("c"), F.max("s").alias("s"), F.count("*").alias("n"))
    return best.select("docid", F.when(F.col("n") > 1, F.col("c")).otherwise((F.col("s") > 0).cast("int")).cast("double").alias("prediction"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """One row: n, accuracy, and for two classes precision and recall of class 1."""
    right, said, true = F.col("label") == F.col("prediction"), F.col("prediction") == 1, F.col("label") == 1
    one = lambda c: F.sum(c.cast("int"))
    return predicted.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.try_divide(one(said & true), one(said)).alias("precision"), F.try_divide(one(said & true), one(true)).alias("recall"))


def nearest_label(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """docid, label, prediction: the label of each query's nearest other vector. queries, rows: (docid, vec, label)."""
    from siftwood.operators.dense import topk

    near = topk(queries.select(F.col("docid").alias("query_id"), "vec"), rows, 2).where("query_id <> docid")
    best = near.groupBy("query_id").agg(F.min_by("docid", "rank").alias("docid"))
    named = best.join(rows.select("docid", F.col("label").alias("prediction")), "docid").select(F.col("query_id").alias("docid"), "prediction")
    return named.join(queries.select("docid", "label"), "docid").select("docid", "label", "prediction")
