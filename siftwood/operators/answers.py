"""Extractive answers: sentences weighted by rank and overlap, entities of the kind a question asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.functions import text as T

# Capitalised words that are no names, and words that open sentences.
NOT_NAMES = (
    "он она они его ее их это та тот все всё она этот эта эти свой своя "
    "есть как что да нет ну вот так уже еще ещё очень теперь здесь там сейчас "
    "просто конечно хорошо ладно может нужно можно будто правда впрочем один одна"
).split()
STARTERS = "эксперименты однако вскоре потом затем так там здесь тогда словом итак вместе наконец после перед вечером утром ночью".split()


def weighted_sentences(chunks: DataFrame, top: int = 3) -> DataFrame:
    """query_id, sentence, w, rank, at: the sentences of each query's first chunks that share a term with it.

    chunks: (query_id, query, rank from 0, text). Equal sentences count once, with their largest weight.
    """
    wanted = F.array_distinct(T.norm_terms(F.col("query")))
    each = chunks.where(F.col("rank") < top).select("query_id", "query", "rank", wanted.alias("wanted"), F.posexplode(T.long_sentences(F.col("text"))).alias("at", "sentence"))
    overlap = F.size(F.array_intersect(F.array_distinct(T.norm_terms(F.col("sentence"))), "wanted"))
    rated = each.withColumn("ov", overlap).where("ov > 0").withColumn("w", 1.0 / (F.col("rank") + 1) * F.col("ov") * (1.0 + 0.1 * F.col("ov")))
    best = F.struct("w", (-F.col("rank")).alias("r"), (-F.col("at")).alias("a"))
    return rated.groupBy("query_id", "query", "sentence").agg(F.max("w").alias("w"), F.max_by("rank", best).alias("rank"), F.min(F.struct("rank", "at")).alias("seen"))


# What a question of a kind is answered by: pattern, group, whether words that are no names go, and its turn.
_SOUGHT = (("place", T.PLACE, 1, False, 0), ("place", T.NAME, 0, True, 1), ("name", T.NAME, 0, True, 0), ("year", T.YEAR, 1, False, 0), ("number", T.NUMBER, 0, False, 0))


def _entities(sentences: DataFrame) -> DataFrame:
    """query_id, type, value, score, seen of the entities a question asks for; a value in the query is no answer.

    A pattern of a later turn counts only where those before have found nothing for the query.
    """
    none = F.array().cast("array<string>")
    tried = F.array(*(F.struct(F.lit(turn).alias("turn"), F.lit(names).alias("names"), F.when(F.col("type") == kind, T.entities(F.col("sentence"), pattern, group)).otherwise(none).alias("values")) for kind, pattern, group, names, turn in _SOUGHT))
    each = sentences.select("query_id", "query", "type", "w", "rank", "seen", "sentence", F.explode(tried).alias("t"))
    each = each.select("*", "t.turn", "t.names", F.explode("t.values").alias("value"))
    low = F.lower("value")
    known = F.lower("query").contains(low)
    opens = F.col("sentence").startswith(F.col("value")) & low.isin(*STARTERS)
    kept = each.where((F.length("value") > 2) & ~known & ~opens & ~(F.col("names") & low.isin(*NOT_NAMES)))
    kept = kept.withColumn("first", F.min("turn").over(W.partitionBy("query_id"))).where("turn = first")
    far = F.max("rank") - F.min("rank") >= 2
    return kept.groupBy("query_id", "type", "value").agg((F.sum("w") * F.when(far, 1.5).otherwise(1.0)).alias("score"), F.min("seen").alias("seen"))


def extract(chunks: DataFrame, top: int = 3) -> DataFrame:
    """query_id, type, answer, evidence, conf for the queries that have an answer.

    Names, places, years and numbers are answered by the heaviest entity, others (and those without an
    entity) by the heaviest sentence if it weighs more than 1. Ties go to what stands first.
    """
    sentences = weighted_sentences(chunks, top).withColumn("type", T.question_type(F.col("query")))
    found = _entities(sentences)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("seen"), F.asc("value"))
    best = found.withColumn("place", F.row_number().over(order)).where("place = 1").select("query_id", F.col("value").alias("answer"), "score")
    proof = sentences.join(best, "query_id").where(F.contains("sentence", "answer")).groupBy("query_id").agg(F.min_by("sentence", "seen").alias("evidence"))
    entity = best.join(proof, "query_id", "left").select("query_id", "answer", F.coalesce("evidence", F.lit("")).alias("evidence"), F.round(F.least(F.lit(0.95), 0.45 + 0.18 * F.col("score")), 2).alias("conf"))
    heaviest = sentences.groupBy("query_id", "type").agg(F.max_by(F.struct("sentence", "w"), F.struct("w", (-F.col("seen.rank")).alias("r"), (-F.col("seen.at")).alias("a"))).alias("s"))
    whole = F.when(F.col("s.w") > 1, F.col("s.sentence"))
    both = heaviest.join(entity, "query_id", "left").withColumn("by_entity", F.col("conf").isNotNull())
    pick = lambda a, b: F.when(F.col("by_entity"), a).otherwise(b)
    rows = both.select("query_id", "type", pick(F.col("answer"), whole).alias("answer"), pick(F.col("evidence"), whole).alias("evidence"), pick(F.col("conf"), F.lit(0.5)).alias("conf"))
    return rows.where(F.col("answer").isNotNull())


# How an answer is worded in each zone.
PHRASES = {
    "confident": "{text}",
    "unsure": "Кажется: {text}",
    "ambiguous": "Неоднозначно: {text}",
    "unknown": "Не помню.",
}


def phrased(verdicts: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """(query_id, zone, text) with reply: the template of the zone, filled in."""
    out = F.lit(None).cast("string")
    for zone, template in (phrases or PHRASES).items():
        out = F.when(F.col("zone") == zone, F.replace(F.lit(template), F.lit("{text}"), F.coalesce("text", F.lit("")))).otherwise(out)
    return verdicts.withColumn("reply", out)
