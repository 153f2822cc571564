"""The composite plans: hybrid search, dense recall, and answering, each for a batch of queries.

A batch is (query_id, text). State is read from an Index, document vectors and small tables; every step is a
DataFrame keyed by query_id, so one query and a million take the same plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.functions import text as T
from siftwood.functions.numeric import calibrated, dot
from siftwood.operators import dense, fusion, lexical
from siftwood.operators.answers import extract
from siftwood.operators.index import Index
from siftwood.scratch import materialise


@dataclass(frozen=True)
class Config:
    """Parameters of retrieval; the defaults suit the hashed embedder."""

    k: int = 3
    pool: int = 30
    channel: int = 50
    expand: bool = True
    expand_terms: int = 8
    expand_weight: float = 0.4
    session_weight: float = 0.3
    calib: tuple[float, float] = (38.7, -28.0)
    calib_sparse: tuple[float, float] = (4.0, -2.0)
    weights: tuple[float, ...] = fusion.DEFAULT_WEIGHTS
    repair: bool = True
    probes: int = 16
    wide: int = 48
    least: float = 0.35


@dataclass
class Parsed:
    """One query's operators; words holds what is left."""

    words: str = ""
    source: str | None = None
    heading: str | None = None
    excluded: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)


def parse(query: str) -> Parsed:
    """source:x, heading:x and -x by white space first, then "phrases" in what is left."""
    out, kept = Parsed(), []
    for word in query.split():
        name, _, value = word.partition(":")
        if name.lower() in ("source", "heading") and value:
            setattr(out, name.lower(), value)
        elif word.startswith("-") and len(word) > 1:
            out.excluded.append(word[1:])
        else:
            kept.append(word)
    line = " ".join(kept)
    out.phrases = re.findall(r'"([^"]+)"', line)
    out.words = re.sub(r'"[^"]*"', " ", line)
    return out


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, text) with words, source, heading, excluded, phrases: parse() for a batch, as expressions."""
    tokens = F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    named = lambda w, name: w.rlike(f"(?i)^{name}:.")
    drop = lambda w: named(w, "source") | named(w, "heading") | w.rlike("^-.")
    value = lambda name: F.regexp_extract(F.element_at(F.filter(tokens, lambda w: named(w, name)), -1), "^[^:]+:(.*)$", 1)
    line = F.array_join(F.filter(tokens, lambda w: ~drop(w)), " ")
    has = lambda name: F.exists(tokens, lambda w: named(w, name))
    return queries.withColumns(
        {
            "source": F.when(has("source"), value("source")),
            "heading": F.when(has("heading"), value("heading")),
            "excluded": F.transform(F.filter(tokens, lambda w: w.rlike("^-.") & ~named(w, "source") & ~named(w, "heading")), lambda w: F.substring(w, 2, 1 << 20)),
            "phrases": F.regexp_extract_all(line, F.lit('"([^"]+)"'), F.lit(1)),
            "words": F.regexp_replace(line, '"[^"]*"', " "),
        }
    )


def query_words(queries: DataFrame, index: Index, config: Config) -> DataFrame:
    """query_id, term of what a query says beside its operators, with typos and layouts repaired if the settings say so."""
    said = parsed(queries).select("query_id", F.col("words").alias("text"))
    return materialise(lexical.repaired_query_terms(said, index) if config.repair else lexical.query_terms(said), "words")


def pool(queries: DataFrame, index: Index, vectors: DataFrame, query_vectors: DataFrame, config: Config = Config(), tombstones: DataFrame | None = None, context: DataFrame | None = None, ivf: dense.InvertedFile | None = None, words: DataFrame | None = None) -> DataFrame:
    """query_id, docid, rank, raw_cos, bm25_raw, norm, conf: the fused candidates after filters.

    Sources filter before the top k of both channels, so a filter never costs results. context: (query_id,
    term) of each session's last query, searched with a lower weight in the same source. ivf: vectors have the
    list_id it has assigned; queries without a source then search the nearest lists only, and more of them
    where these give too little. words: query_words() of the queries, if they are at hand.
    """
    asked = parsed(queries)
    terms = query_words(queries, index, config) if words is None else words
    wanted_phrases = asked.select("query_id", F.posexplode("phrases").alias("phrase_id", "p")).select("query_id", "phrase_id", T.norm_terms(F.col("p")).alias("terms")).where(F.size("terms") > 0)

    bonus = lexical.phrase_bonus(wanted_phrases, index)
    allowed = asked.select("query_id", "source", "heading")
    docs = index.docs if "source" in index.docs.columns else index.docs.withColumn("source", F.lit(None).cast("string"))
    docs = docs if "heading" in docs.columns else docs.withColumn("heading", F.lit(None).cast("string"))
    facts = docs.select("docid", "source", "heading")

    sources = None if allowed.where("source is not null").isEmpty() else allowed

    def scored(wanted: DataFrame, k: int, extra: DataFrame | None = None) -> DataFrame:
        return lexical.bm25(wanted, index, k, extra, sources, tombstones)

    first = materialise(scored(terms, config.channel, bonus), "hits")  # three later steps read it
    lists = [first.select("query_id", F.lit(1).alias("list_no"), "docid", "rank")]
    if config.expand:
        asking = asked.where(T.is_question(F.col("words"))).select("query_id")
        enough = first.groupBy("query_id").count().where("count >= 3").join(asking, "query_id").select("query_id")
        more = lexical.expansion(first.join(enough, "query_id"), terms, index, n=config.expand_terms)
        both = terms.join(more.select("query_id").distinct(), "query_id").select("query_id", "term", F.lit(1.0).alias("weight")).unionByName(more.select("query_id", "term", F.lit(config.expand_weight).alias("weight")))
        lists.append(scored(both, config.channel).select("query_id", F.lit(2).alias("list_no"), "docid", "rank"))
    if context is not None:
        extra = context.join(index.lexicon.where("df >= 2").select("term"), "term").join(terms, ["query_id", "term"], "left_anti")
        lists.append(scored(extra.select("query_id", "term", F.lit(config.session_weight).alias("weight")), 30).select("query_id", F.lit(3).alias("list_no"), "docid", "rank"))

    alive = vectors if tombstones is None else vectors.join(tombstones, "docid", "left_anti")
    spoken = materialise(query_vectors.join(asked.where(F.trim("words") != "").select("query_id", "source"), "query_id"), "spoken")
    if ivf is not None:
        near = ivf.topk_widening(spoken.where("source is null"), alive, config.channel, config.probes, max(config.probes, config.wide), config.least)
    else:
        near = dense.topk(spoken.where("source is null"), alive, config.channel)
    bound = spoken.where("source is not null")
    if not bound.isEmpty():  # one scan for all sources asked for
        near = near.unionByName(dense.topk(bound, alive.join(facts.select("docid", "source"), "docid"), config.channel, by_source=True))
    near = materialise(near, "near")
    lists.append(near.select("query_id", F.lit(0).alias("list_no"), "docid", "rank"))

    every = lists[0]
    for part in lists[1:]:
        every = every.unionByName(part)
    fused = fusion.rrf(every, config.pool)
    gone = lexical.excluded(asked.select("query_id", F.array_join("excluded", " ").alias("text")), index)
    fused = fused.join(gone, ["query_id", "docid"], "left_anti")
    sparse = every.where("list_no > 0").select("query_id", "docid").distinct().withColumn("in_sparse", F.lit(True))
    lexed = fusion.normalised(first).select("query_id", "docid", F.col("score").alias("bm25_raw"), "norm")
    cand = fused.join(near.select("query_id", "docid", F.col("score").alias("raw")), ["query_id", "docid"], "left").join(lexed, ["query_id", "docid"], "left").join(sparse, ["query_id", "docid"], "left")
    headed = lexical.under_heading(cand, allowed, facts)
    conf = fusion.confidence(F.col("raw"), F.col("norm"), F.coalesce("in_sparse", F.lit(False)), *config.calib, *config.calib_sparse)
    return headed.select("query_id", "docid", "rank", "heading", F.col("raw").alias("raw_cos"), "bm25_raw", "norm", conf.alias("conf"))


def search(queries: DataFrame, index: Index, vectors: DataFrame, query_vectors: DataFrame, config: Config = Config(), feedback: DataFrame | None = None, corrections: DataFrame | None = None, tombstones: DataFrame | None = None, context: DataFrame | None = None, ivf: dense.InvertedFile | None = None) -> DataFrame:
    """query_id, place, docid, text, raw_cos, conf, ltr, margin, zone of the best k candidates."""
    words = query_words(queries, index, config)
    found = materialise(pool(queries, index, vectors, query_vectors, config, tombstones, context, ivf, words), "pool")
    rows = featured(found, words, index, vectors, query_vectors, feedback)
    ranked = fusion.rerank(rows, config.weights, corrections, config.k)
    ranked = ranked.withColumn("raw_cos", F.coalesce("raw_cos", F.lit(0.0)))
    return ranked.join(fusion.verdicts(ranked), "query_id").select("query_id", "place", "docid", "text", "raw_cos", "conf", "ltr", "margin", "zone")


def featured(found: DataFrame, words: DataFrame, index: Index, vectors: DataFrame, query_vectors: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """found (query_id, docid, heading, raw_cos, bm25_raw, ...) with the rerank features, and the document's text."""
    asked = words.groupBy("query_id").agg(F.collect_set("term").alias("query_terms"))
    rare = index.lexicon.where("df = 1").select("term").join(words, "term").groupBy("query_id").agg(F.collect_set("term").alias("rare_terms"))
    docs = index.docs
    # only the candidates' texts are cut into terms
    met = docs.join(materialise(found.select("docid").distinct(), "met"), "docid", "left_semi").select("docid", "text", T.norm_terms(F.col("text")).alias("t"))
    texts = met.select("docid", "text", F.array_distinct("t").alias("doc_terms"), F.size("t").cast("long").alias("dl"))
    nbr = found.select("query_id", "docid").withColumn("nbr", F.explode(F.array(F.col("docid") - 1, F.col("docid") + 1)))
    if "source" in docs.columns:
        own = docs.select("docid", "source")
        nbr = nbr.join(own, "docid").join(own.select(F.col("docid").alias("nbr"), F.col("source").alias("of")), "nbr").where(F.col("source").eqNullSafe(F.col("of")))
    nbr = materialise(nbr.select("query_id", "docid", "nbr"), "nbr")
    close = nbr.join(vectors.select(F.col("docid").alias("nbr"), "vec"), "nbr").join(query_vectors.select("query_id", F.col("vec").alias("qvec")), "query_id")
    near = close.groupBy("query_id", "docid").agg(F.max(dot(F.col("vec"), F.col("qvec"))).alias("nbr_raw"))
    rows = found.join(asked, "query_id", "left").join(rare, "query_id", "left").join(texts, "docid").join(near, ["query_id", "docid"], "left").crossJoin(F.broadcast(index.corpus_stats.select("avgdl")))
    rows = rows.withColumn("query_terms", F.coalesce("query_terms", F.array().cast("array<string>")))
    rows = rows.withColumn("rare", F.coalesce(F.arrays_overlap("rare_terms", "doc_terms"), F.lit(False))).withColumn("dense_raw", F.col("raw_cos"))
    rows = rows.join(feedback.select("docid", F.col("feedback").alias("dan")), "docid", "left") if feedback is not None else rows.withColumn("dan", F.lit(0.0))
    return fusion.features(rows)


def event_features(events: DataFrame, index: Index, vectors: DataFrame, query_vectors: DataFrame, config: Config = Config(), feedback: DataFrame | None = None) -> DataFrame:
    """seq, docid, f: the rerank features of every document shown in events (seq, q, shown) of the journal.

    Scores come from the first ``channel`` hits of either kind; what lies beyond them has none.
    """
    queries = events.select(F.col("seq").alias("query_id"), F.col("q").alias("text"))
    words = query_words(queries, index, config)
    sparse = lexical.bm25(words, index, config.channel).select("query_id", "docid", F.col("score").alias("bm25_raw"))
    near = dense.topk(query_vectors, vectors, config.channel).select("query_id", "docid", F.col("score").alias("raw_cos"))
    shown = events.select(F.col("seq").alias("query_id"), F.explode(F.array_distinct(F.concat("shown", F.array("picked")))).alias("docid"))
    heads = index.docs.select("docid", F.col("heading") if "heading" in index.docs.columns else F.lit(None).cast("string").alias("heading"))
    found = shown.join(sparse, ["query_id", "docid"], "left").join(near, ["query_id", "docid"], "left").join(heads, "docid")
    rows = featured(found, words, index, vectors, query_vectors, feedback)
    return rows.select(F.col("query_id").alias("seq"), "docid", F.array(*(F.col(c).cast("double") for c in fusion.FEATURES)).alias("f"))


def ask(query_vectors: DataFrame, vectors: DataFrame, docs: DataFrame, config: Config = Config(), inactive: DataFrame | None = None) -> DataFrame:
    """Dense recall only: query_id, place, docid, text, raw_cos, conf, margin, zone. Inactive documents are passed over."""
    alive = vectors if inactive is None else vectors.join(inactive, "docid", "left_anti")
    near = dense.topk(query_vectors, alive, config.k).select("query_id", F.col("rank").alias("place"), "docid", F.col("score").alias("raw_cos"))
    rows = near.withColumn("conf", calibrated(F.col("raw_cos"), *config.calib))
    return rows.join(fusion.verdicts(rows), "query_id").join(docs.select("docid", "text"), "docid").select("query_id", "place", "docid", "text", "raw_cos", "conf", "margin", "zone")


def answer(queries: DataFrame, query_vectors: DataFrame, vectors: DataFrame, docs: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, zone, text, type, answer, evidence: the first chunk, and an extracted answer to questions it is sure enough of."""
    recalled = ask(query_vectors, vectors, docs, config)
    first = recalled.where("place = 0").select("query_id", "zone", "text")
    asking = queries.where(T.is_question(F.col("text"))).join(first.where("zone in ('confident', 'unsure')").select("query_id"), "query_id").select("query_id", F.col("text").alias("query"))
    found = extract(recalled.select("query_id", F.col("place").alias("rank"), "text").join(asking, "query_id")).where("conf >= 0.5")
    return first.join(found.select("query_id", "type", "answer", "evidence"), "query_id", "left")
