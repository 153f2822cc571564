"""Feedback: views over the append-only journal, the learned ranker, the associative trace, consolidation.

journal: (seq, q, shown array, picked, sign). Everything else derives from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.functions import text as X
from siftwood.functions.vectors import SparseCoder, unit
from siftwood.operators.fusion import DEFAULT_WEIGHTS


def signature(text):
    """What a correction is remembered by: the query's distinct terms in order."""
    return F.array_join(F.array_sort(F.array_distinct(X.norm_terms(text))), " ")


def shown_counts(journal: DataFrame) -> DataFrame:
    return journal.select(F.explode("shown").alias("docid")).groupBy("docid").agg(F.count("*").alias("shown"))


def doc_feedback(journal: DataFrame) -> DataFrame:
    return journal.where(F.col("picked").isNotNull()).groupBy(F.col("picked").alias("docid")).agg(F.sum("sign").alias("feedback"))


def corrections(journal: DataFrame) -> DataFrame:
    """sig, docid, place: documents last confirmed for a query, the latest first; a rejection removes one.

    journal has sig beside the usual columns. Each event moves its document to the front or takes it out,
    so the last event of a pair decides.
    """
    last = journal.where(F.col("picked").isNotNull()).groupBy("sig", F.col("picked").alias("docid")).agg(F.max_by("sign", "seq").alias("sign"), F.max("seq").alias("seq"))
    order = W.partitionBy("sig").orderBy(F.desc("seq"))
    return last.where("sign > 0").withColumn("place", F.row_number().over(order) - 1).select("sig", "docid", "place")


def doc_state(journal: DataFrame, forget: int = -2) -> DataFrame:
    """docid, active, deleted: the last sign decides whether a document is active; a sum of ``forget`` deletes it."""
    last = journal.where(F.col("picked").isNotNull()).groupBy(F.col("picked").alias("docid")).agg(F.max_by("sign", "seq").alias("sign"), F.sum("sign").alias("total"))
    return last.select("docid", ((F.col("sign") > 0) & (F.col("total") > forget)).alias("active"), (F.col("total") <= forget).alias("deleted"))


@dataclass
class Ranker:
    """Pairwise logistic learning, one event at a time: the order of events matters, so it runs on the driver.

    A feature's weight moves only after min_pairs pairs differed in it.
    """

    w: np.ndarray = field(default_factory=lambda: np.array(DEFAULT_WEIGHTS))
    pair_count: np.ndarray = field(default_factory=lambda: np.zeros(len(DEFAULT_WEIGHTS), np.int64))
    n_pairs: int = 0
    min_pairs: int = 20

    def learn(self, differences: np.ndarray, rate: float = 0.05, decay: float = 1e-4, epochs: int = 3) -> None:
        """differences: one row of features per pair, winner less loser, in order."""
        for d in [row for _ in range(epochs) for row in differences]:
            push = 1 - 1 / (1 + np.exp(-np.clip(self.w @ d, -30, 30)))
            ready = self.pair_count >= self.min_pairs
            self.pair_count = self.pair_count + (np.abs(d) > 1e-9)
            self.w = self.w + rate * (push * d - decay * self.w) * ready
            self.n_pairs += 1


def training_pairs(journal: DataFrame, features: DataFrame, sign_aware: bool = True) -> DataFrame:
    """seq, winner, loser (feature arrays) for every shown document besides the picked one.

    features: (seq, docid, f array). With sign_aware a rejected document is the loser; otherwise the picked
    one always wins.
    """
    others = journal.select("seq", "picked", "sign", F.explode("shown").alias("docid")).where("docid <> picked")
    own = features.select("seq", F.col("docid").alias("picked"), F.col("f").alias("own"))
    both = others.join(features, ["seq", "docid"]).join(own, ["seq", "picked"])
    swap = F.lit(sign_aware) & (F.col("sign") < 0)
    return both.select("seq", "docid", F.when(swap, F.col("f")).otherwise(F.col("own")).alias("winner"), F.when(swap, F.col("own")).otherwise(F.col("f")).alias("loser"))


# --- associative trace -----------------------------------------------------------------------------

LR = 0.3


def codes(vectors: DataFrame, coder: SparseCoder | None = None) -> DataFrame:
    """vectors (vec) with cells: the active cells of each vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(coder or SparseCoder())

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def active(vecs: pd.Series) -> pd.Series:
        return pd.Series([c.astype(np.int32) for c in sent.value.codes(np.stack(vecs.to_numpy()))]) if len(vecs) else pd.Series([], dtype=object)

    return vectors.withColumn("cells", active("vec"))


def decay_factor(ordinal, total: int, decay: float):
    """What is left of the ordinal-th (from 1) of ``total`` updates: lazy decay that is made real below one half.

    A fresh update is not scaled by the decay already pending, so its factor depends on its epoch only.
    """
    if decay == 0:
        return F.lit(1.0)
    keep = 1 - decay
    epoch = 1
    while keep**epoch >= 0.5:
        epoch += 1
    epochs = total // epoch
    return F.pow(F.lit(keep**epoch), epochs - F.floor(ordinal / epoch)) * keep ** (total - epochs * epoch)


def trace(events: DataFrame, decay: float = 0.0005) -> DataFrame:
    """cell, w: what a series of updates leaves on each cell.

    events: (ordinal from 1, vec, cells, amount). The updates commute once decay is in closed form, so the
    trace is one grouped sum.
    """
    total = events.count()
    scaled = events.withColumn("amount", LR * F.col("amount") * decay_factor(F.col("ordinal"), total, decay))
    each = scaled.select(F.explode("cells").alias("cell"), "amount", F.col("vec").alias("v")).select("cell", "amount", F.posexplode("v").alias("d", "x"))
    sums = each.groupBy("cell", "d").agg(F.sum(F.col("amount") * F.col("x")).alias("w"))
    return sums.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "w"))), lambda p: p["w"]).alias("w"))


def familiarity(queries: DataFrame, learned: DataFrame, active: int = 100) -> DataFrame:
    """query_id, familiarity of (query_id, vec, cells): cosine with what the cells recall, times its strength."""
    recalled = queries.select("query_id", F.explode("cells").alias("cell")).join(learned, "cell").select("query_id", F.posexplode("w").alias("d", "x")).groupBy("query_id", "d").agg(F.sum("x").alias("out"))
    own = queries.select("query_id", F.posexplode("vec").alias("d", "v"))
    sums = own.join(recalled, ["query_id", "d"], "left").groupBy("query_id").agg(F.sum(F.col("v") * F.coalesce("out", F.lit(0.0))).alias("vo"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nv"), F.sqrt(F.sum(F.coalesce("out", F.lit(0.0)) ** 2)).alias("no"))
    cosine = F.when((F.col("nv") > 0) & (F.col("no") > 0), F.col("vo") / (F.col("nv") * F.col("no"))).otherwise(0.0)
    return sums.select("query_id", (cosine * F.least(F.lit(1.0), F.col("no") / (LR * active))).alias("familiarity"))


def consolidation(journal: DataFrame, known: DataFrame, min_shown: int = 2, low: float = 0.3, forget: int = -2) -> DataFrame:
    """docid, action: ``relearn`` where often shown but unfamiliar, ``forget`` where feedback is too low.

    known: (docid, familiarity).
    """
    rows = known.join(shown_counts(journal), "docid", "left").join(doc_feedback(journal), "docid", "left")
    action = F.when(F.coalesce("feedback", F.lit(0)) <= forget, "forget").when((F.coalesce("shown", F.lit(0)) >= min_shown) & (F.col("familiarity") < low), "relearn")
    return rows.select("docid", action.alias("action")).where(F.col("action").isNotNull())


def blended(recent: list[np.ndarray], now: np.ndarray, weight: float = 0.3) -> np.ndarray:
    """A query's vector mixed with the mean of the session's last three."""
    return unit(weight * np.mean(recent[-3:], axis=0) + (1 - weight) * now) if recent else now


def session_tail(session: DataFrame, n: int = 8) -> DataFrame:
    """The last n queries of each session (session_id, seq, q)."""
    order = W.partitionBy("session_id").orderBy(F.desc("seq"))
    return session.withColumn("back", F.row_number().over(order) - 1).where(F.col("back") < n)
