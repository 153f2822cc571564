"""Registered queries over the driver's tables, each with the SQL that checks it where SQL can.

documents stand for chunks (doc_id is docid), benchmark for the batch of queries, embeddings for dense
vectors with label as species, events for the feedback journal, conversations for sessions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.functions import numeric as N
from siftwood.functions import text as T
from siftwood.functions import vectors as V
from siftwood.operators import answers, dense, evaluation, feedback, fusion, ingest, lexical
from siftwood.operators.index import Index, surface
from siftwood.operators.index import spelling as spelling_keys
from siftwood.plans import search as plans
from siftwood.scratch import fresh_path, materialise
from siftwood.sources import files, store, taxonomy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docid"), "text", "source", "lang")


def benchmark(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("docid"), F.col("embedding").alias("vec"), "label")


def probes_of(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return rows.where("docid % 100 = 0").select(F.col("docid").alias("query_id"), "vec")


def journal(spark, sf_dir) -> DataFrame:
    """events as a journal: a user is a query, a document one of 50, a purchase-like value above the middle confirms."""
    doc = lambda k: F.pmod(F.col("event_id") * k, F.lit(50))
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("sig"), F.array(doc(7), doc(7) + 1, doc(11) + 60).alias("shown"), doc(7).alias("picked"), F.when(F.col("value") >= 10, 1).otherwise(-1).alias("sign"))


JOURNAL = """j AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS sig,
  [event_id * 7 % 50, event_id * 7 % 50 + 1, event_id * 11 % 50 + 60] AS shown,
  event_id * 7 % 50 AS picked, CASE WHEN value >= 10 THEN 1 ELSE -1 END AS sign FROM events)"""

TOKENS = "regexp_extract_all(replace(lower(coalesce(text, '')), 'ё', 'е'), '[a-zа-я0-9]+')"
STEM = """CASE WHEN length(w) <= 3 OR NOT regexp_matches(w, '^[a-z][a-zа-я]*$') THEN w
 WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, -3) || 'y'
 WHEN w LIKE '%ing' AND length(w) > 5 AND regexp_matches(left(w, -3), '[aeiouy]') THEN
   CASE WHEN length(w) >= 6 AND substr(w, length(w) - 3, 1) = substr(w, length(w) - 4, 1)
          AND NOT regexp_matches(substr(w, length(w) - 3, 1), '[aeiouy]') THEN left(w, -4) ELSE left(w, -3) END
 WHEN w LIKE '%ed' AND length(w) > 4 AND regexp_matches(left(w, -2), '[aeiouy]') THEN left(w, -2)
 WHEN w LIKE '%oes' AND length(w) > 4 THEN left(w, -3) || 'o'
 WHEN regexp_matches(w, '(s|x|ch|sh|z)es$') THEN left(w, -2)
 WHEN w LIKE '%ly' AND length(w) > 4 THEN left(w, -2)
 WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, -1)
 ELSE w END"""
TERMS = f"""tok AS MATERIALIZED (SELECT doc_id, unnest({TOKENS}) AS w, generate_subscripts({TOKENS}, 1) - 1 AS pos FROM documents),
terms AS MATERIALIZED (SELECT doc_id, pos, {STEM} AS term FROM tok),
post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY ALL),
lex AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
ds AS MATERIALIZED (SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS dl FROM documents),
cs AS MATERIALIZED (SELECT count(*) AS n, greatest(1.0, avg(dl)) AS avgdl FROM ds)"""
BATCH = f"""qt AS MATERIALIZED (SELECT DISTINCT query_id, {STEM} AS term FROM
  (SELECT item_id AS query_id, unnest({TOKENS}) AS w FROM benchmark))"""
IDF = "ln(1 + (n - df + 0.5e0) / (df + 0.5e0))"
BM25 = f"{IDF} * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)))"
SCORES = f"""sc AS MATERIALIZED (SELECT query_id, doc_id, round(sum({BM25}), 9) AS score
  FROM qt JOIN lex USING (term) JOIN post USING (term) JOIN ds USING (doc_id), cs GROUP BY ALL),
hits AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM sc)"""
DENSE = """pr AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
dsc AS MATERIALIZED (SELECT query_id, vec_id AS docid, label, round(list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS score
  FROM pr, embeddings),
near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, docid) - 1 AS rank FROM dsc)"""

# --- text functions --------------------------------------------------------------------------------


@query(f"SELECT doc_id AS docid, CAST(len({TOKENS}) AS BIGINT) AS n, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def t1_tokenize(spark, sf_dir):
    t = T.tokenize(F.col("text"))
    return documents(spark, sf_dir).select("docid", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"SELECT DISTINCT w AS token, {STEM} AS stem FROM (SELECT unnest({TOKENS}) AS w FROM documents)")
def t2_stem(spark, sf_dir):
    return surface(documents(spark, sf_dir)).select("token", T.stem(F.col("token")).alias("stem"))


@query(f"WITH {TERMS} SELECT doc_id AS docid, md5(string_agg(term, ' ' ORDER BY pos)) AS digest FROM terms GROUP BY doc_id")
def t5_norm_terms(spark, sf_dir):
    rows = documents(spark, sf_dir).select("docid", T.norm_terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    return rows.select("docid", F.md5(F.array_join("t", " ")).alias("digest"))


@query("""SELECT DISTINCT w AS token, translate(w, 'qwertyuiopasdfghjklzxcvbnm', 'йцукенгшщзфывапролдячсмить') AS keys FROM
  (SELECT unnest(""" + TOKENS + """) AS w FROM benchmark)""")
def t6_layout(spark, sf_dir):
    return benchmark(spark, sf_dir).select(F.explode(T.tokenize(F.col("text"))).alias("token")).distinct().select("token", T.to_cyrillic_keys(F.col("token")).alias("keys"))


@query(f"""WITH t AS (SELECT DISTINCT unnest({TOKENS}) AS w FROM benchmark),
d1 AS (SELECT w, substr(w, 1, i - 1) || substr(w, i + 1) AS d FROM t, range(1, 60) r(i) WHERE i <= length(w)),
d2 AS (SELECT w, substr(d, 1, i - 1) || substr(d, i + 1) AS d FROM d1, range(1, 60) r(i) WHERE i <= length(d))
SELECT DISTINCT w AS token, d AS delete_key FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2)""")
def t7_deletes(spark, sf_dir):
    tokens = benchmark(spark, sf_dir).select(F.explode(T.tokenize(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", F.explode(T.deletes(F.col("token"))).alias("delete_key"))


def deletes_sql(name: str, source: str, more: str = "") -> str:
    """Tables of the strings d left of w after one or two deletions, ending in ``name``. more: further columns."""
    each = "LATERAL (SELECT unnest(range(1, length({})+ 1)) AS i)"
    once = f"{name}1 AS (SELECT w{more}, substr(w, 1, i - 1) || substr(w, i + 1) AS d FROM {source}, {each.format('w')})"
    twice = f"{name}2 AS (SELECT w{more}, substr(d, 1, i - 1) || substr(d, i + 1) AS d FROM {name}1, {each.format('d')})"
    return f"{once}, {twice}, {name} AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT * FROM {name}1 UNION ALL SELECT * FROM {name}2))"


def osa_sql(pairs: str) -> str:
    """Tables that end in ``osa`` (token, other, edit): the distance of the pairs by rows of its table, a swap of neighbours counting one."""
    cell = "least(cur[e[1] + 1] + 1, acc[e[1]] + 1, cur[e[1]] + cost, CASE WHEN i >= 1 AND e[1] >= 2 AND token[i + 1] = other[e[1] - 1] AND token[i] = other[e[1]] THEN prev[e[1] - 1] + cost END)"
    cell = cell.replace("cost", "CASE WHEN token[i + 1] = other[e[1]] THEN 0 ELSE 1 END")
    return f"""dp AS (SELECT token, other, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS prev, range(0, length(other) + 1) AS cur FROM {pairs}
  UNION ALL SELECT token, other, i + 1, cur, list_reduce(list_transform(range(1, length(other) + 1), lambda j: [j]), lambda acc, e: list_append(acc, {cell}), [i + 1]) FROM dp WHERE i < length(token)),
osa AS MATERIALIZED (SELECT token, other, CAST(least(3, cur[length(other) + 1]) AS INTEGER) AS edit FROM dp WHERE i = length(token))"""


@query(f"""WITH RECURSIVE t AS MATERIALIZED (SELECT DISTINCT w FROM (SELECT unnest({TOKENS}) AS w FROM benchmark) WHERE length(w) >= 4),
{deletes_sql('k', 't')},
pairs AS MATERIALIZED (SELECT DISTINCT a.w AS token, b.w AS other FROM k a JOIN k b USING (d) WHERE a.w < b.w),
{osa_sql('pairs')} SELECT * FROM osa""")
def t8_edit_distance(spark, sf_dir):
    tokens = benchmark(spark, sf_dir).select(F.explode(T.tokenize(F.col("text"))).alias("token")).where(F.length("token") >= 4).distinct()
    pairs = tokens.select("token", F.explode(T.deletes(F.col("token"))).alias("key"))
    both = pairs.join(pairs.withColumnRenamed("token", "other"), "key").where("token < other").select("token", "other").distinct()
    return both.withColumn("edit", V.osa_distance("token", "other"))


CLEAN = "trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))"
SENTENCES = f"list_filter(string_split(regexp_replace({CLEAN}, '([.!?…]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(f"SELECT doc_id AS docid, md5({CLEAN}) AS digest FROM documents")
def t12_clean(spark, sf_dir):
    return documents(spark, sf_dir).select("docid", F.md5(T.clean(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id AS docid, CAST(len({SENTENCES}) AS BIGINT) AS n, md5(array_to_string({SENTENCES}, '|')) AS digest FROM documents")
def t9_sentences(spark, sf_dir):
    s = T.split_sentences(F.col("text"))
    return documents(spark, sf_dir).select("docid", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


CHUNKS = f"""s AS MATERIALIZED (SELECT doc_id, {SENTENCES} AS s FROM documents),
chunks AS MATERIALIZED (SELECT doc_id, i AS chunk, array_to_string(s[i + 1 : i + 2], ' ') AS text
  FROM s, range(0, 100000) r(i) WHERE len(s) > 0 AND i <= greatest(0, len(s) - 2))"""


@query(f"WITH {CHUNKS} SELECT doc_id AS docid, chunk, md5(text) AS digest FROM chunks")
def t10_chunks(spark, sf_dir):
    rows = documents(spark, sf_dir).select("docid", F.posexplode(T.windows(T.split_sentences(F.col("text")))).alias("chunk", "c"))
    return rows.select("docid", F.col("chunk").cast("long").alias("chunk"), F.md5("c").alias("digest"))


@query(f"""WITH md AS (SELECT doc_id, source, text FROM documents),
s AS (SELECT doc_id, source, {SENTENCES} AS s FROM md)
SELECT doc_id AS docid, source AS heading, CAST(sum(greatest(0, len(s) - 2) + 1) AS BIGINT) AS n FROM s WHERE len(s) > 0 GROUP BY ALL""")
def t11_headed_chunks(spark, sf_dir):
    """Each text under a heading made of its source; what looks like a heading in the text itself is escaped."""
    body = F.regexp_replace("text", r"(?m)^(\s*)#", r"$1\\#")
    headed = F.concat(F.coalesce(F.concat(F.lit("# "), "source", F.lit("\n")), F.lit("")), body)
    docs = documents(spark, sf_dir).where(T.clean(F.col("text")) != "").select("docid", headed.alias("text"))
    return ingest.chunks(docs).groupBy("docid", "heading").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, trim(text) LIKE '%?' AS question FROM conversations")
def t14_is_question(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_question(F.col("text")).alias("question"))


ASKED = ("В каком году это было?", "Когда жил %?", "Сколько стоит %?", "Как звали %?", "Кто такой %?", "Где живёт %?", "Почему % молчит?", "Зачем %?", "Что делает %?", "Расскажи про %", "Просто %")
KINDS = ("year", "year", "number", "name", "name", "place", "reason", "reason", "thing", "thing", None)


@query(f"""SELECT conv_id, turn, ({[k or "" for k in KINDS]})[CAST((conv_id + turn) % {len(KINDS)} AS INTEGER) + 1] AS kind,
  ({[not a.startswith(("Расскажи", "Просто")) for a in ASKED]})[CAST((conv_id + turn) % {len(KINDS)} AS INTEGER) + 1] AS question FROM conversations""")
def t15_question_type(spark, sf_dir):
    """Each turn's role put into one of the questions."""
    asked = F.replace(F.get(F.array(*(F.lit(a) for a in ASKED)), ((F.col("conv_id") + F.col("turn")) % len(ASKED)).cast("int")), F.lit("%"), F.col("role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("text"))
    return rows.select("conv_id", "turn", F.coalesce(T.question_type(F.col("text")), F.lit("")).alias("kind"), T.is_question(F.col("text")).alias("question"))


@query("""SELECT doc_id AS docid, concat_ws(' · ', source, 'heading ' || lang, 'line ' || CAST(n_chars AS VARCHAR)) AS citation FROM documents""")
def t18_citation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("docid"), T.citation(F.col("source"), heading=F.col("lang"), page=F.lit(None), line=F.col("n_chars")).alias("citation"))


DATED = "text || ' In ' || CAST(1000 + doc_id % 1500 AS VARCHAR) || ',' || CAST(1900 + doc_id % 300 AS VARCHAR) || ' and é1999 or 1' || CAST(doc_id AS VARCHAR)"


@query(rf"""SELECT doc_id AS docid, unnest(regexp_extract_all(regexp_replace({DATED}, '([^\p{{L}}\p{{M}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(1[0-9]{{3}}|20[0-9]{{2}})(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])', 1)) AS year FROM documents""")
def t20_years(spark, sf_dir):
    """Every text with some numbers at its end, some of which are years."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docid"), F.expr(DATED.replace("VARCHAR", "STRING")).alias("text"))
    return docs.select("docid", F.explode(T.entities(F.col("text"), T.YEAR, 1)).alias("year"))


# --- index -----------------------------------------------------------------------------------------


@query(f"WITH {TERMS} SELECT term, doc_id AS docid, count(*) AS tf, md5(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos)) AS positions FROM terms GROUP BY ALL")
def a1_postings(spark, sf_dir):
    rows = Index.build(documents(spark, sf_dir)).postings
    return rows.select("term", "docid", "tf", F.md5(F.array_join(F.col("positions").cast("array<string>"), ",")).alias("positions"))


@query(f"WITH {TERMS} SELECT term, df FROM lex")
def a2_lexicon(spark, sf_dir):
    return Index.build(documents(spark, sf_dir)).lexicon


@query(f"WITH {TERMS} SELECT n, round(avgdl, 6) AS avgdl, CAST((SELECT sum(dl) FROM ds) AS BIGINT) AS total FROM cs")
def a3_corpus_stats(spark, sf_dir):
    index = Index.build(documents(spark, sf_dir))
    return index.corpus_stats.crossJoin(F.broadcast(index.doc_stats.agg(F.sum("dl").alias("total")))).select("n", F.round("avgdl", 6).alias("avgdl"), "total")


@query(f"""WITH {TERMS}, c AS (SELECT term, count(*) AS cnt FROM terms GROUP BY term)
SELECT term, cnt, round(1e-3 / (1e-3 + cnt / CAST((SELECT sum(cnt) FROM c) AS DOUBLE)), 9) AS weight FROM c""")
def a4_term_weights(spark, sf_dir):
    from siftwood.operators.index import term_frequencies

    counts = term_frequencies(documents(spark, sf_dir))
    total = counts.agg(F.sum("cnt").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("term", "cnt", F.round(N.sif(F.col("cnt"), F.col("total")), 9).alias("weight"))


@query(f"""WITH {TERMS}, t AS MATERIALIZED (SELECT term AS w, df FROM lex WHERE df >= 2 AND length(term) >= 4),
{deletes_sql('k', 't', ', df')} SELECT d AS delete_key, count(*) AS n, max(df) AS df FROM k GROUP BY d""")
def a6_spelling_keys(spark, sf_dir):
    return spelling_keys(Index.build(documents(spark, sf_dir)).lexicon).groupBy("delete_key").agg(F.count("*").alias("n"), F.max("df").alias("df"))


# --- lexical retrieval -----------------------------------------------------------------------------


def _indexed(spark, sf_dir):
    wanted = lexical.query_terms(benchmark(spark, sf_dir))
    return Index.build(documents(spark, sf_dir), wanted), wanted


@query(f"WITH {TERMS}, {BATCH}, {SCORES} SELECT query_id, doc_id AS docid, rank, round(score, 6) AS score FROM hits WHERE rank < 10")
def a5_bm25_top10(spark, sf_dir):
    index, wanted = _indexed(spark, sf_dir)
    return lexical.bm25(wanted, index, 10).select("query_id", "docid", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH {TERMS}, {BATCH},
sc AS (SELECT query_id, doc_id, round(sum((CASE WHEN length(term) > 4 THEN 1.0e0 ELSE 0.4e0 END) * {BM25}), 9) AS score
  FROM qt JOIN lex USING (term) JOIN post USING (term) JOIN ds USING (doc_id), cs GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM sc)
SELECT query_id, doc_id AS docid, rank, round(score, 6) AS score FROM h WHERE rank < 10""")
def a5_bm25_weighted(spark, sf_dir):
    index, wanted = _indexed(spark, sf_dir)
    weighted = wanted.withColumn("weight", F.when(F.length("term") > 4, 1.0).otherwise(0.4))
    return lexical.bm25(weighted, index, 10).select("query_id", "docid", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


PHRASES = f"""ph AS MATERIALIZED (SELECT query_id, i AS place, {STEM} AS term FROM
  (SELECT item_id AS query_id, ({TOKENS})[1:4] AS a FROM benchmark), LATERAL (SELECT unnest(a) AS w, generate_subscripts(a, 1) - 1 AS i)),
pl AS (SELECT query_id, count(*) AS size FROM ph GROUP BY query_id),
found AS MATERIALIZED (SELECT query_id, doc_id, pos - place AS start FROM ph JOIN terms USING (term) JOIN pl USING (query_id)
  GROUP BY query_id, doc_id, pos - place HAVING count(DISTINCT place) = max(size))"""


def _phrases(spark, sf_dir):
    return benchmark(spark, sf_dir).select("query_id", F.lit(0).alias("phrase_id"), F.transform(F.slice(T.tokenize(F.col("text")), 1, 4), T.stem).alias("terms"))


@query(f"WITH {TERMS}, {PHRASES} SELECT query_id, doc_id AS docid, start FROM found")
def j3_phrases(spark, sf_dir):
    asked = _phrases(spark, sf_dir)
    index = Index.build(documents(spark, sf_dir), asked.select(F.explode("terms").alias("term")))
    return lexical.phrases(asked, index).select("query_id", "docid", F.col("at").cast("long").alias("start"))


@query(f"""WITH {TERMS}, {PHRASES},
worth AS (SELECT query_id, 2 * sum({IDF}) AS b FROM (SELECT DISTINCT query_id, term FROM ph) JOIN lex USING (term), cs GROUP BY query_id)
SELECT query_id, doc_id AS docid, round(b, 6) AS score FROM (SELECT DISTINCT query_id, doc_id FROM found) JOIN worth USING (query_id)""")
def a6_phrase_bonus(spark, sf_dir):
    asked = _phrases(spark, sf_dir)
    index = Index.build(documents(spark, sf_dir), asked.select(F.explode("terms").alias("term")))
    return lexical.phrase_bonus(asked, index).select("query_id", "docid", F.round("score", 6).alias("score"))


@query(f"""WITH {TERMS}, {BATCH}, {SCORES},
x AS (SELECT query_id, {STEM} AS term FROM (SELECT item_id AS query_id, ({TOKENS})[1] AS w FROM benchmark)),
gone AS (SELECT DISTINCT query_id, doc_id FROM x JOIN post USING (term))
SELECT query_id, count(*) AS n, round(max(score), 6) AS best FROM sc ANTI JOIN gone USING (query_id, doc_id) GROUP BY query_id""")
def p4_exclusion(spark, sf_dir):
    """Each query excludes its first word."""
    index, wanted = _indexed(spark, sf_dir)
    first = benchmark(spark, sf_dir).select("query_id", F.get(T.tokenize(F.col("text")), 0).alias("text"))
    return lexical.score_stats(wanted, index, lexical.query_terms(first)).select("query_id", "n", F.round("best", 6).alias("best"))


@query(f"""WITH {TERMS}, {BATCH}, {SCORES},
h AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank
  FROM sc JOIN documents USING (doc_id) WHERE query_id % 3 = 0 OR contains(source, 'src' || CAST(query_id % 3 AS VARCHAR)))
SELECT query_id, doc_id AS docid, rank, round(score, 6) AS score FROM h WHERE rank < 10""")
def p1_source_filter(spark, sf_dir):
    """A third of the queries is free, the others ask for one of two sources."""
    index, wanted = _indexed(spark, sf_dir)
    third = F.col("query_id") % 3
    asked = benchmark(spark, sf_dir).select("query_id", F.when(third > 0, F.concat(F.lit("src"), third.cast("string"))).alias("source"))
    return lexical.bm25(wanted, index, 10, sources=asked).select("query_id", "docid", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH {TERMS}, {BATCH}, {SCORES},
c AS (SELECT query_id, term, CAST(sum(tf) AS BIGINT) AS c FROM hits JOIN post USING (doc_id) WHERE rank < 5 AND (query_id, term) NOT IN (SELECT query_id, term FROM qt) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, term) - 1 AS place FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS rank FROM p WHERE place < 24 AND length(term) >= 4)
SELECT query_id, term, rank FROM e WHERE rank < 8""")
def a8_expansion(spark, sf_dir):
    wanted = lexical.query_terms(benchmark(spark, sf_dir))
    hits = lexical.bm25(wanted, Index.build(documents(spark, sf_dir), wanted), 5)
    first = documents(spark, sf_dir).join(materialise(hits, "hits").select("docid").distinct(), "docid", "left_semi")
    return lexical.expansion(hits, wanted, Index.build(first)).select("query_id", "term", F.col("rank").cast("long").alias("rank"))


MISTYPED = f"""asked AS MATERIALIZED (SELECT DISTINCT query_id, unnest({TOKENS}) AS token FROM (SELECT item_id AS query_id, regexp_replace(text, '^(\\w\\w)\\w', '\\1') AS text FROM benchmark)),
unknown AS MATERIALIZED (SELECT DISTINCT token AS w FROM asked WHERE length(token) BETWEEN 4 AND 28 AND token NOT IN (SELECT w FROM tok)),
known AS MATERIALIZED (SELECT term AS w, df FROM lex WHERE df >= 2 AND length(term) BETWEEN 4 AND 29),
{deletes_sql('u', 'unknown')}, {deletes_sql('k', 'known', ', df')},
pairs AS MATERIALIZED (SELECT DISTINCT u.w AS token, k.w AS other FROM u JOIN k USING (d)),
{osa_sql('pairs')},
best AS (SELECT token, other FROM (SELECT token, other, row_number() OVER (PARTITION BY token ORDER BY edit, df DESC, other) AS r FROM osa JOIN known ON known.w = other WHERE edit <= 2) WHERE r = 1),
repaired AS MATERIALIZED (SELECT DISTINCT query_id, {STEM} AS term FROM (SELECT query_id, coalesce(other, token) AS w FROM asked LEFT JOIN best USING (token)))"""


def _mistyped(spark, sf_dir):
    """Benchmark texts whose first token lacks its third letter."""
    return benchmark(spark, sf_dir).select("query_id", F.regexp_replace("text", r"^(\w\w)\w", "$1").alias("text"))


@query(f"WITH RECURSIVE {TERMS}, {MISTYPED} SELECT query_id, term FROM repaired")
def q4_repaired_terms(spark, sf_dir):
    return lexical.repaired_query_terms(_mistyped(spark, sf_dir), Index.build(documents(spark, sf_dir)).counted())


@query(f"""WITH RECURSIVE {TERMS}, {MISTYPED}, {SCORES.replace("FROM qt JOIN", "FROM repaired JOIN")} SELECT query_id, doc_id AS docid, rank, round(score, 6) AS score FROM hits WHERE rank < 10""")
def q1_mistyped_channel(spark, sf_dir):
    """The lexical channel of the hybrid search for mistyped queries."""
    index = Index.build(documents(spark, sf_dir)).counted()
    words = plans.query_words(_mistyped(spark, sf_dir), index, plans.Config())
    return lexical.bm25(words, index, 10).select("query_id", "docid", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def a9_sources(spark, sf_dir):
    return store.source_counts(documents(spark, sf_dir))


# --- dense retrieval -------------------------------------------------------------------------------


@query(f"WITH {DENSE} SELECT query_id, docid, rank, round(score, 6) AS score FROM near WHERE rank < 10")
def l2_dense_top10(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return dense.topk(probes_of(rows), rows, 10).select("query_id", "docid", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {DENSE} SELECT query_id, docid, rank, round(score, 6) AS score FROM (SELECT query_id, docid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, docid) - 1 AS rank FROM dsc WHERE label % 2 = 0) WHERE rank < 10")
def p2_dense_filtered(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return dense.topk(probes_of(rows), rows, 10, keep=F.col("label") % 2 == 0).select("query_id", "docid", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("""SELECT a.vec_id AS docid, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def n1_cosine(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("docid", "vec")
    after = rows.select((F.col("docid") - 1).alias("docid"), F.col("vec").alias("next"))
    return rows.join(after, "docid").select("docid", F.round(N.cosine(F.col("vec"), F.col("next")), 6).alias("cos"))


@query(f"""WITH {DENSE}, b AS (SELECT query_id, label, greatest(0, max(score)) AS score FROM near WHERE rank < 60 GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, label))
SELECT query_id, label, round(score, 6) AS score, round(coalesce(score - nxt, 1.0), 6) AS margin FROM r WHERE place = 1""")
def a11_best_label(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    near = dense.topk(probes_of(rows), rows, 60).join(rows.select("docid", "label"), "docid")
    return dense.best_per_label(near).select("query_id", "label", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query(f"""WITH {DENSE}, b AS (SELECT query_id, label, greatest(0, max(score)) AS score FROM near WHERE rank < 60 GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, label)),
s AS (SELECT query_id, score >= 0.75 AND coalesce(score - nxt, 1.0) >= 0.01 AS sure, label FROM r WHERE place = 1)
SELECT query_id, CASE WHEN sure THEN label END AS label, CASE WHEN sure AND label % 3 < 2 THEN label % 3 = 0 END AS toxic,
  sure AND label % 3 <> 1 AS warn FROM s""")
def q6_recognise(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    near = dense.topk(probes_of(rows), rows, 60).join(rows.select("docid", "label"), "docid")
    species = rows.select("label").distinct().select("label", F.when(F.col("label") % 3 < 2, F.col("label") % 3 == 0).alias("toxic"))
    return dense.recognise(near, species).select("query_id", "label", "toxic", "warn")


def _pictures(spark, sf_dir):
    """Two of three vectors stand for photos, and their label for a species."""
    return embeddings(spark, sf_dir).withColumns({"kind": F.when(F.col("docid") % 3 < 2, "image"), "species": F.concat(F.lit("s"), F.col("label").cast("string"))})


@query(f"WITH {DENSE} SELECT query_id, docid, rank, round(score, 6) AS score FROM near WHERE rank < 60 AND docid % 3 < 2")
def p7_kind_filter(spark, sf_dir):
    rows = _pictures(spark, sf_dir)
    near = dense.of_kind(dense.topk(probes_of(rows), rows, 60), rows)
    return near.select("query_id", "docid", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT 's' || CAST(label AS VARCHAR) AS species, count(*) AS n FROM embeddings WHERE vec_id % 3 < 2 GROUP BY 1")
def a10_photo_counts(spark, sf_dir):
    return files.photo_counts(_pictures(spark, sf_dir))


@query("SELECT CAST(label AS INTEGER) AS list_id, count(*) AS n FROM embeddings GROUP BY 1")
def a19_list_sizes(spark, sf_dir):
    """Lists whose centroids stand on axes of their own, one a label, so that SQL can tell which list a row is in."""
    rows = embeddings(spark, sf_dir)
    most = rows.agg(F.max("label")).first()[0] or 0
    axes = dense.InvertedFile(np.eye(int(most) + 1, dtype=np.float32))
    on_axis = rows.select("docid", F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: (i == F.col("label")).cast("float")).alias("vec"))
    return dense.list_sizes(axes.assign(on_axis))


@query()
def l3_inverted_file(spark, sf_dir):
    """Searched by probing as many lists as a recall of 0.95 takes on this table; tests hold it against exact search."""
    rows = embeddings(spark, sf_dir)
    ivf = dense.InvertedFile.fit(rows)
    assigned = materialise(ivf.assign(rows), "assigned")
    n = max(16, ivf.nprobe_for(rows, assigned, 10))
    return ivf.topk_widening(probes_of(rows), assigned, 10, n, max(48, n))


@query()
def n7_hashed_embedding(spark, sf_dir):
    return dense.fit_and_embed(documents(spark, sf_dir))[1]


@query("""SELECT a.doc_id AS docid, b.doc_id AS nbr FROM documents a JOIN documents b ON abs(a.doc_id - b.doc_id) = 1 AND (a.doc_id // 3 = b.doc_id // 3 OR (a.doc_id // 3 % 4 = 0 AND b.doc_id // 3 % 4 = 0))""")
def j7_neighbours(spark, sf_dir):
    """Three documents share a source; every fourth source is null."""
    source = F.expr("doc_id div 3")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docid"), F.when(source % 4 != 0, source.cast("string")).alias("source"))
    return fusion.neighbours(docs)


# --- fusion and ranking ----------------------------------------------------------------------------

FUSED = """hits2 AS (SELECT query_id, doc_id AS docid, score, rank FROM hits WHERE rank < 50),
alt AS (SELECT query_id, doc_id AS docid, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) - 1 AS rank
  FROM (SELECT query_id, doc_id, count(*) AS n FROM qt JOIN post USING (term) GROUP BY ALL)),
lists AS (SELECT query_id, docid, 0 AS list_no, rank FROM alt WHERE rank < 50 UNION ALL SELECT query_id, docid, 1, rank FROM hits2),
f AS (SELECT query_id, docid, round(sum(1e0 / (60 + rank + 1)), 12) AS score, min(list_no * 1000 + rank) AS seen FROM lists GROUP BY ALL),
fused AS MATERIALIZED (SELECT query_id, docid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, docid) - 1 AS rank FROM f)"""


def _lists(spark, sf_dir):
    index, wanted = _indexed(spark, sf_dir)
    best = materialise(lexical.bm25(wanted, index, 50), "hits")  # two later steps read it
    other = lexical.best(wanted, index, 50, counts=True)
    lists = other.select("query_id", F.lit(0).alias("list_no"), "docid", "rank").unionByName(best.select("query_id", F.lit(1).alias("list_no"), "docid", "rank"))
    return index, wanted, best, lists


@query(f"WITH {TERMS}, {BATCH}, {SCORES}, {FUSED} SELECT query_id, docid, rank, round(score, 9) AS score FROM fused WHERE rank < 30")
def a7_rrf(spark, sf_dir):
    return fusion.rrf(_lists(spark, sf_dir)[3]).select("query_id", "docid", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


CANDIDATES = """c AS (SELECT query_id, docid, fused.rank, coalesce(h.score, 0) AS bm, h.score / max(h.score) OVER (PARTITION BY query_id) AS norm
  FROM fused LEFT JOIN hits2 h USING (query_id, docid) WHERE fused.rank < 30)"""


@query(f"""WITH {TERMS}, {BATCH}, {SCORES}, {FUSED},
m AS (SELECT query_id, max(score) AS top FROM hits2 GROUP BY query_id),
c AS (SELECT f.query_id, f.docid, f.rank, h.score / top AS norm, 1e0 / (1 + exp(-(4.0e0 * coalesce(h.score / top, 0) - 2.0e0))) AS conf
  FROM fused f JOIN m USING (query_id) LEFT JOIN hits2 h ON h.query_id = f.query_id AND h.docid = f.docid WHERE f.rank < 30),
v AS (SELECT query_id, rank, conf, coalesce(norm, 0) - lead(coalesce(norm, 0)) OVER (PARTITION BY query_id ORDER BY rank) AS d FROM c)
SELECT query_id, round(coalesce(d, 1.0), 6) AS margin, CASE WHEN conf < 0.35 THEN 'unknown' WHEN conf < 0.75 THEN 'unsure' WHEN coalesce(d, 1.0) < 0.02 THEN 'ambiguous' ELSE 'confident' END AS zone
FROM v WHERE rank = 0""")
def w2_zones(spark, sf_dir):
    _, _, best, lists = _lists(spark, sf_dir)
    lexed = fusion.normalised(best).select("query_id", "docid", "norm")
    rows = fusion.rrf(lists).join(lexed, ["query_id", "docid"], "left")
    rows = rows.select("query_id", F.col("rank").alias("place"), F.coalesce("norm", F.lit(0.0)).alias("raw_cos"), fusion.confidence(F.lit(None).cast("double"), F.col("norm"), F.lit(True)).alias("conf"))
    return fusion.verdicts(rows).select("query_id", F.round("margin", 6).alias("margin"), "zone")


FEATURED = f"""docterms AS MATERIALIZED (SELECT doc_id AS docid, list(DISTINCT term) AS dt FROM terms GROUP BY doc_id),
asked AS MATERIALIZED (SELECT query_id, list(DISTINCT term) AS q FROM qt GROUP BY query_id),
heads AS (SELECT doc_id AS docid, list(DISTINCT term) AS ht FROM (SELECT doc_id, {STEM} AS term FROM
  (SELECT doc_id, unnest(regexp_extract_all(lower(lang || ' ' || source), '[a-zа-я0-9]+')) AS w FROM documents)) GROUP BY doc_id),
feats AS MATERIALIZED (SELECT f.query_id, f.docid, f.rank, coalesce(h.score, 0) / (coalesce(h.score, 0) + 5) AS bm25,
  (len(list_intersect(q, ht)) / sqrt(len(q))) / (len(list_intersect(q, ht)) / sqrt(len(q)) + 2) AS bm25_head,
  len(list_intersect(q, dt)) / CAST(len(q) AS DOUBLE) AS coverage, 1 / (1 + dl / avgdl) AS len_norm,
  CASE WHEN EXISTS (SELECT 1 FROM qt JOIN lex USING (term) JOIN post USING (term) WHERE df = 1 AND qt.query_id = f.query_id AND post.doc_id = f.docid) THEN 1.0 ELSE 0.0 END AS rare_hit
  FROM fused f LEFT JOIN hits2 h ON h.query_id = f.query_id AND h.docid = f.docid
  JOIN asked ON asked.query_id = f.query_id JOIN docterms d ON d.docid = f.docid JOIN heads ON heads.docid = f.docid JOIN ds ON ds.doc_id = f.docid, cs WHERE f.rank < 30)"""


def _features(spark, sf_dir):
    index, wanted, best, lists = _lists(spark, sf_dir)
    asked = wanted.groupBy("query_id").agg(F.collect_set("term").alias("query_terms"))
    pool = fusion.rrf(lists).select("query_id", "docid", "rank").join(best.select("query_id", "docid", F.col("score").alias("bm25_raw")), ["query_id", "docid"], "left")
    pool = materialise(pool, "pool")
    # only the candidates' texts are cut into terms
    met = documents(spark, sf_dir).join(pool.select("docid").distinct(), "docid", "left_semi")
    docs = met.select("docid", F.concat_ws(" ", "lang", "source").alias("heading"), T.norm_terms(F.col("text")).alias("t"))
    docs = docs.select("docid", "heading", F.array_distinct("t").alias("doc_terms"), F.size("t").cast("long").alias("dl"))
    terms = sorted(r.term for r in wanted.select("term").distinct().collect())
    single = [(t,) for t, df in zip(terms, index.frequencies(terms).tolist(), strict=True) if df == 1]
    rare = wanted.join(spark.createDataFrame(single, "term string"), "term").groupBy("query_id").agg(F.collect_set("term").alias("rare_terms"))
    pool = pool.join(docs, "docid").join(asked, "query_id").join(rare, "query_id", "left").withColumn("avgdl", F.lit(index.size()[1]))
    return fusion.features(pool.withColumns({"rare": F.coalesce(F.arrays_overlap("rare_terms", "doc_terms"), F.lit(False)), "dense_raw": F.lit(0.0), "nbr_raw": F.lit(0.0), "dan": F.lit(0.0)}))


@query(f"""WITH {TERMS}, {BATCH}, {SCORES}, {FUSED}, {FEATURED}
SELECT query_id, docid, round(bm25, 6) AS bm25, round(bm25_head, 6) AS bm25_head, round(coverage, 6) AS coverage, round(len_norm, 6) AS len_norm, rare_hit FROM feats""")
def f7_features(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return rows.select("query_id", "docid", *(F.round(c, 6).alias(c) for c in ("bm25", "bm25_head", "coverage", "len_norm")), F.col("rare_hit").cast("double").alias("rare_hit"))


@query(f"""WITH {TERMS}, {BATCH}, {SCORES}, {FUSED}, {FEATURED},
s AS (SELECT query_id, docid, rank, bm25 + 0.6 * bm25_head + 0.8 * coverage + 0.3 * len_norm + 0.4 * rare_hit AS ltr FROM feats),
p AS (SELECT query_id, docid, ltr, row_number() OVER (PARTITION BY query_id ORDER BY round(ltr, 9) DESC, rank) - 1 AS place FROM s)
SELECT query_id, docid, place, round(ltr, 6) AS ltr FROM p WHERE place < 3""")
def f8_rerank(spark, sf_dir):
    return fusion.rerank(_features(spark, sf_dir)).select("query_id", "docid", F.col("place").cast("long").alias("place"), F.round("ltr", 6).alias("ltr"))


@query(f"""WITH {TERMS}, {BATCH}, {SCORES}, {FUSED}, {FEATURED},
s AS (SELECT query_id, docid, rank, bm25 + 0.6 * bm25_head + 0.8 * coverage + 0.3 * len_norm + 0.4 * rare_hit
  + CASE WHEN rank = 9 THEN 2.0 WHEN rank = 4 THEN 1.5 ELSE 0 END AS ltr FROM feats),
p AS (SELECT query_id, docid, ltr, row_number() OVER (PARTITION BY query_id ORDER BY round(ltr, 9) DESC, rank) - 1 AS place FROM s)
SELECT query_id, docid, place, round(ltr, 6) AS ltr FROM p WHERE place < 3""")
def l6_corrected(spark, sf_dir):
    rows = _features(spark, sf_dir)
    fixed = rows.where("rank in (9, 4)").select("query_id", "docid", F.when(F.col("rank") == 9, 0).otherwise(1).alias("place"))
    return fusion.rerank(rows, corrections=fixed).select("query_id", "docid", F.col("place").cast("long").alias("place"), F.round("ltr", 6).alias("ltr"))


def _embedded(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model, vectors = dense.fit_and_embed(docs)
    return docs, materialise(vectors, "vectors"), materialise(model.embed(benchmark(spark, sf_dir)).select("query_id", "vec"), "asked"), model


@query()
def q1_hybrid_search(spark, sf_dir):
    docs, vectors, asked, _ = _embedded(spark, sf_dir)
    return plans.search(benchmark(spark, sf_dir), Index.build(docs).counted(), vectors, asked)


@query()
def q2_ask(spark, sf_dir):
    docs, vectors, asked, _ = _embedded(spark, sf_dir)
    return plans.ask(asked, vectors, docs)


@query()
def q3_answer(spark, sf_dir):
    docs, vectors, asked, _ = _embedded(spark, sf_dir)
    return plans.answer(benchmark(spark, sf_dir).withColumn("text", F.concat("text", F.lit("?"))), asked, vectors, docs)


# --- learning --------------------------------------------------------------------------------------


@query(f"WITH {JOURNAL} SELECT d AS docid, count(*) AS shown FROM (SELECT unnest(shown) AS d FROM j) GROUP BY d")
def a12_shown(spark, sf_dir):
    return feedback.shown_counts(journal(spark, sf_dir))


@query(f"WITH {JOURNAL} SELECT picked AS docid, CAST(sum(sign) AS BIGINT) AS feedback FROM j GROUP BY picked")
def a13_doc_feedback(spark, sf_dir):
    return feedback.doc_feedback(journal(spark, sf_dir))


@query(f"""WITH {JOURNAL}, l AS (SELECT sig, picked AS docid, arg_max(sign, seq) AS sign, max(seq) AS seq FROM j GROUP BY ALL)
SELECT sig, docid, row_number() OVER (PARTITION BY sig ORDER BY seq DESC) - 1 AS place FROM l WHERE sign > 0""")
def f5_corrections(spark, sf_dir):
    return feedback.corrections(journal(spark, sf_dir)).select("sig", "docid", F.col("place").cast("long").alias("place"))


@query(f"""WITH {JOURNAL}, l AS (SELECT picked AS docid, arg_max(sign, seq) AS sign, sum(sign) AS total FROM j GROUP BY picked)
SELECT docid, sign > 0 AND total > -2 AS active, total <= -2 AS deleted FROM l""")
def f4_doc_state(spark, sf_dir):
    return feedback.doc_state(journal(spark, sf_dir))


@query(f"""WITH {JOURNAL}, e AS (SELECT seq, picked, sign, unnest(shown) AS docid FROM j)
SELECT seq, docid, CASE WHEN sign < 0 THEN docid ELSE picked END % 7 / 7e0 AS winner, CASE WHEN sign < 0 THEN picked ELSE docid END % 7 / 7e0 AS loser FROM e WHERE docid <> picked""")
def f6_pairs(spark, sf_dir):
    rows = journal(spark, sf_dir)
    feats = rows.select("seq", F.explode("shown").alias("docid")).select("seq", "docid", F.array(F.col("docid") % 7 / 7.0).alias("f")).distinct()
    return feedback.training_pairs(rows, feats).select("seq", "docid", F.get("winner", 0).alias("winner"), F.get("loser", 0).alias("loser"))


@query(f"""WITH {JOURNAL}, s AS (SELECT d AS docid, count(*) AS shown FROM (SELECT unnest(shown) AS d FROM j) GROUP BY d),
fb AS (SELECT picked AS docid, sum(sign) AS feedback FROM j GROUP BY picked),
k AS (SELECT doc_id AS docid, (doc_id % 10) / 10e0 AS familiarity FROM documents)
SELECT docid, CASE WHEN coalesce(feedback, 0) <= -2 THEN 'forget' ELSE 'relearn' END AS action FROM k LEFT JOIN s USING (docid) LEFT JOIN fb USING (docid)
WHERE coalesce(feedback, 0) <= -2 OR (coalesce(shown, 0) >= 2 AND familiarity < 0.3)""")
def f9_consolidation(spark, sf_dir):
    known = documents(spark, sf_dir).select("docid", (F.col("docid") % 10 / 10.0).alias("familiarity"))
    return feedback.consolidation(journal(spark, sf_dir), known)


@query()
def f2_familiarity(spark, sf_dir):
    """The trace of all vectors, and how familiar the query set is."""
    rows = feedback.codes(embeddings(spark, sf_dir), feedback.SparseCoder(size=64, cells=400))
    events = rows.select((F.col("docid") + 1).alias("ordinal"), "vec", "cells", F.lit(1.0).alias("amount"))
    asked = rows.where("docid % 100 = 0").select(F.col("docid").alias("query_id"), "vec", "cells")
    return feedback.familiarity(asked, feedback.trace(events), active=20)


@query("""SELECT conv_id AS session_id, turn AS seq, r - 1 AS back FROM
(SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r <= 8""")
def w8_session_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("q"))
    return feedback.session_tail(rows).select("session_id", "seq", F.col("back").cast("long").alias("back"))


# --- deduplication, sources ------------------------------------------------------------------------


@query()
def t13_simhash_dedup(spark, sf_dir):
    return ingest.unseen(documents(spark, sf_dir).select("docid", "text"), within=True).select("docid", "simhash")


@query("SELECT md5(html) AS digest, count(*) AS copies FROM pages GROUP BY 1")
def s11_content_digests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.md5("html").alias("digest"))
    once = files.new_images(pages)
    return once.join(pages.groupBy("digest").agg(F.count("*").alias("copies")), "digest")


@query("""SELECT event_id, k || ': ' || (CASE WHEN json_type(props, '$."' || k || '"') = 'VARCHAR' THEN json_extract_string(props, '$."' || k || '"') ELSE CAST(json_extract(props, '$."' || k || '"') AS VARCHAR) END) AS leaf
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def s7_json_leaves(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(V.json_leaves("props")).alias("leaf"))


@query("""SELECT source, doc_id AS docid FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3""")
def s13_first_per_group(spark, sf_dir):
    return files.first_per_group(documents(spark, sf_dir).select("source", "docid"), "source", "docid", 3)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, n_name AS genus, r_name AS family FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def j12_taxonomy(spark, sf_dir):
    """Suppliers as species, nations as genera, regions as families."""
    parts = []
    for name, key, title, parent, rank in (("supplier", "s_suppkey", "s_name", "concat('n', s_nationkey)", "species"), ("nation", "concat('n', n_nationkey)", "n_name", "concat('r', n_regionkey)", "genus"), ("region", "concat('r', r_regionkey)", "r_name", "''", "family")):
        parts.append(table(spark, sf_dir, name).select(F.expr(key).cast("string").alias("ID"), F.col(title).alias("scientificName"), F.lit("").alias("genus"), F.lit(rank).alias("rank"), F.expr(parent).alias("parentID")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return taxonomy.backbone(rows.select("ID", "scientificName", "genus", "rank"), rows.select("ID", F.col("ID").alias("nameID"), "parentID"))


@query("SELECT doc_id AS docid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j6_tombstones(spark, sf_dir):
    dead = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("docid")).distinct()
    return store.live(documents(spark, sf_dir).select("docid"), dead)


# --- evaluation ------------------------------------------------------------------------------------


@query(f"""WITH {TERMS}, {BATCH}, {SCORES},
g AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
r AS (SELECT coalesce(rank + 1, 99) AS r FROM g LEFT JOIN (SELECT * FROM hits WHERE rank < 10) h USING (query_id, doc_id))
SELECT count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS r_at_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS r_at_5,
  round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS r_at_10, round(avg(1e0 / r), 6) AS mrr, round(avg(CASE WHEN r <= 10 THEN 1e0 / log2(r + 1) ELSE 0 END), 6) AS ndcg_at_10 FROM r""")
def a20_rank_metrics(spark, sf_dir):
    index, wanted = _indexed(spark, sf_dir)
    hits = lexical.bm25(wanted, index, 10)
    out = evaluation.rank_metrics(lexical.holders(benchmark(spark, sf_dir), index.docs), hits)
    return out.select("n", *(F.round(c, 6).alias(c) for c in out.columns if c != "n"))


SWEEP = [round(0.5 + 0.035 * i, 3) for i in range(14)]


@query(f"""WITH s AS (SELECT (doc_id * 37 % 1000) / 1000e0 AS score, quality = 1 AS good FROM labels),
t AS (SELECT unnest({SWEEP}) AS threshold),
c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, sum(CASE WHEN score >= threshold AND good THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= threshold AND NOT good THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN score < threshold AND good THEN 1 ELSE 0 END) AS fn FROM s, t GROUP BY threshold)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
def a22_threshold_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") * 37 % 1000 / 1000.0).alias("score"), (F.col("quality") == 1).alias("right"))
    return evaluation.sweep(rows, SWEEP).select("threshold", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""SELECT gold, pred, n FROM (SELECT lang AS gold, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS pred, count(*) AS n FROM documents GROUP BY ALL)
WHERE gold IS DISTINCT FROM pred ORDER BY n DESC, gold, pred LIMIT 10""")
def a23_confusion(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return evaluation.confusion(docs.select(F.col("lang").alias("gold"), F.when(F.col("docid") % 7 == 0, "en").otherwise(F.col("lang")).alias("pred")))


@query("SELECT CAST(quantile_cont(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(value, 0.95) AS DOUBLE) AS p95 FROM events")
def a24_percentiles(spark, sf_dir):
    return evaluation.percentiles(table(spark, sf_dir, "events"), F.col("value"))


@query(f"""WITH {JOURNAL}, e AS (SELECT seq, picked, unnest(shown) AS docid FROM j), b AS (SELECT seq, picked, docid, row_number() OVER (PARTITION BY seq ORDER BY docid * 13 % 17 DESC, docid) AS r FROM e)
SELECT round(avg(CASE WHEN docid = picked THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM b WHERE r = 1""")
def a21_pairwise(spark, sf_dir):
    shown = journal(spark, sf_dir).select("seq", "picked", F.explode("shown").alias("docid")).withColumn("score", F.col("docid") * 13 % 17)
    return evaluation.pairwise_accuracy(shown).select(F.round("accuracy", 6).alias("accuracy"), "n")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS t, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents),
h AS (SELECT doc_id, t, CAST('0x' || m[1:8] AS BIGINT) AS h, 6 + CAST('0x' || m[9:14] AS BIGINT) % 5 AS size, CAST('0x' || m[15:22] AS BIGINT) AS spot FROM t WHERE len(t) >= 14),
c AS (SELECT *, spot % (len(t) - size + 1) AS start FROM h ORDER BY h, doc_id LIMIT 150)
SELECT doc_id AS query_id, array_to_string(t[start + 1 : start + size], ' ') AS text FROM c""")
def q9_probes(spark, sf_dir):
    return evaluation.probes(documents(spark, sf_dir))


@query("""SELECT count(*) AS n_docs, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS n_live, count(*) FILTER (WHERE doc_id % 5 = 0) AS n_images,
  count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_species FROM documents""")
def a28_health(spark, sf_dir):
    """Every fifth document stands for a photo, its language for a species, toxic ones are buried."""
    docs = documents(spark, sf_dir).withColumns({"kind": F.when(F.col("docid") % 5 == 0, "image"), "species": F.col("lang")})
    return store.health(docs, table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("docid")))


@query()
def q5_extract(spark, sf_dir):
    """Answers from conversations: a user's turn asks, the turns after it are the chunks."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("at"), F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("query"))
    near = asked.join(turns.select("conv_id", "turn", "text"), "conv_id").where("turn > at and turn <= at + 3")
    return answers.extract(near.select("query_id", "query", (F.col("turn") - F.col("at") - 1).cast("int").alias("rank"), "text"))


@query()
def q10_eval_rank(spark, sf_dir):
    """Retrieval quality on probes cut from the corpus: lexical, dense and fused."""
    from siftwood.plans import evaluate

    docs, vectors, _, model = _embedded(spark, sf_dir)
    asked = materialise(evaluation.probes(docs), "asked")
    said = materialise(model.embed(asked).select("query_id", "vec"), "probes")
    gold = asked.select("query_id", F.col("query_id").alias("docid"))
    return evaluate.eval_rank(asked, gold, Index.build(docs), vectors, said)


@query()
def q10_capacity(spark, sf_dir):
    from siftwood.plans import evaluate

    return evaluate.capacity(spark, [500, 1000, 2500, 5000, 10000, 20000])


SPECIES_THRESHOLDS = [round(0.3 + 0.05 * i, 2) for i in range(14)]


@query(f"""WITH p AS (SELECT vec_id AS query_id, embedding AS q, label FROM embeddings WHERE vec_id % 100 = 0),
v AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 100 <> 0),
s AS (SELECT query_id, p.label AS want, v.label, vec_id, round(list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS score FROM p, v),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 40),
g AS (SELECT query_id, greatest(0, coalesce(max(score) FILTER (WHERE label = want), 0)) AS gold, greatest(0, coalesce(max(score) FILTER (WHERE label <> want), 0)) AS other FROM n GROUP BY query_id),
t AS (SELECT CAST(unnest({SPECIES_THRESHOLDS}) AS DOUBLE) AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE gold >= threshold) AS tp, count(*) FILTER (WHERE (other >= threshold AND gold < threshold) OR (gold >= threshold AND gold < other)) AS fp, count(*) FILTER (WHERE gold < threshold) AS fn FROM g, t GROUP BY threshold)
SELECT threshold, tp, fp, fn, round(tp / CAST(greatest(1, tp + fp) AS DOUBLE), 6) AS precision, round(tp / CAST(greatest(1, tp + fn) AS DOUBLE), 6) AS recall FROM c""")
def q10_recogniser_sweep(spark, sf_dir):
    """The query set stands for held-out photos, the other vectors for the stored ones."""
    from siftwood.plans import evaluate

    rows = embeddings(spark, sf_dir).withColumnRenamed("label", "species")
    photos = rows.where("docid % 100 = 0").withColumnRenamed("docid", "query_id")
    swept = evaluate.recogniser_sweep(evaluate.recogniser_rows(photos, rows.where("docid % 100 <> 0")), SPECIES_THRESHOLDS)
    return swept.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query()
def a26_binary_probe(spark, sf_dir):
    """Accuracy, precision and recall of a two-class probe on labelled vectors, held out."""
    from siftwood.operators import probing

    return probing.accuracy(probing.probe(probing.split(embeddings(spark, sf_dir), F.col("label") % 2))[1])


@query()
def a27_linear_probe(spark, sf_dir):
    """Accuracy of a multinomial probe on labelled vectors, held out."""
    from siftwood.operators import probing

    rows = probing.split(embeddings(spark, sf_dir), F.col("label"))
    return probing.accuracy(probing.probe(rows)[1])


# --- filters, adapters and set operations ----------------------------------------------------------


@query("""SELECT item_id AS query_id, min(doc_id) AS docid FROM (SELECT item_id, lower(text) AS q FROM benchmark) JOIN (SELECT doc_id, lower(text) AS d FROM documents WHERE text <> '') ON contains(d, q) OR contains(q, d) GROUP BY 1""")
def p9_find(spark, sf_dir):
    return lexical.containing(benchmark(spark, sf_dir), documents(spark, sf_dir))


@query("""SELECT q AS query_id, doc_id AS docid FROM documents, (SELECT unnest([0, 1, 2]) AS q) WHERE q = 0 OR contains(lower(concat_ws(' ', lang, source)), CASE q WHEN 1 THEN 'en src1' ELSE 'src2' END)""")
def p3_heading_filter(spark, sf_dir):
    """A query without a heading, and two with one."""
    facts = documents(spark, sf_dir).withColumn("heading", F.concat_ws(" ", "lang", "source"))
    asked = spark.createDataFrame([(0, None), (1, "EN src1"), (2, "SRC2")], "query_id int, heading string")
    rows = facts.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("query_id"), "docid")
    return lexical.under_heading(rows, asked, facts).select("query_id", "docid")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS path, 'key: ' || n_nationkey || ' | name: ' || n_name AS text, 1 AS row FROM nation""")
def s5_csv_rows(spark, sf_dir):
    """A two-line table per nation; the last cell is empty and left out."""
    body = F.concat(F.lit("key,name,note\n"), F.col("n_nationkey").cast("string"), F.lit(","), "n_name", F.lit(","))
    made = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.lit("csv").alias("ext"), body.alias("body"))
    return files.csv_rows(made).select(F.col("source").alias("path"), "text", "row")


@query("""SELECT CAST(event_id AS VARCHAR) AS path, line FROM events, (SELECT unnest([1, 3]) AS line)""")
def s6_json_lines(spark, sf_dir):
    """Two good lines around a bad one and a blank one."""
    made = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.lit("jsonl").alias("ext"), F.concat("props", F.lit("\nbad{\n"), "props", F.lit("\n\n")).alias("body"))
    return files.json_lines(made).select(F.col("source").alias("path"), "line")


@query("""SELECT n_nationkey AS nation, repeat(n_name, CAST(n_nationkey AS INTEGER)) || chr(10) AS text FROM nation WHERE length(n_name) * n_nationkey + 1 <= 100""")
def s2_size_limit(spark, sf_dir):
    """A file for each nation, which holds its name as often as its key says; files of over 100 bytes are passed over."""
    folder = fresh_path(spark, "files")
    made = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.expr("repeat(n_name, cast(n_nationkey as int))").alias("text"))
    made.write.partitionBy("nation").text(folder)
    found = files.scan(spark, folder, 100).where("ext = 'txt'")
    return found.select(F.regexp_extract("path", r"nation=(\d+)", 1).cast(made.schema["nation"].dataType).alias("nation"), V.decoded("content").alias("text"))


@query(f"""WITH {TERMS}, b AS (SELECT DISTINCT {STEM} AS term FROM (SELECT unnest({TOKENS}) AS w FROM benchmark))
SELECT (SELECT count(*) FROM (SELECT term FROM lex INTERSECT SELECT term FROM b)) AS shared, (SELECT count(*) FROM (SELECT term FROM b EXCEPT SELECT term FROM lex)) AS missing,
  (SELECT count(*) FROM (SELECT term FROM lex UNION SELECT term FROM b)) AS every""")
def u3_set_operations(spark, sf_dir):
    ours = lexical.query_terms(documents(spark, sf_dir).withColumnRenamed("docid", "query_id")).select("term").distinct()
    theirs = lexical.query_terms(benchmark(spark, sf_dir)).select("term").distinct()
    both = ours.withColumn("a", F.lit(1)).join(theirs.withColumn("b", F.lit(1)), "term", "full_outer")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.agg(one(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), one(F.col("a").isNull()).alias("missing"), F.count("*").alias("every"))


@query(f"""WITH {TERMS}, {BATCH}, {SCORES} SELECT query_id, doc_id AS docid, round(score / max(score) OVER (PARTITION BY query_id), 6) AS norm FROM hits WHERE rank < 20""")
def w7_normalised(spark, sf_dir):
    index, wanted = _indexed(spark, sf_dir)
    return fusion.normalised(lexical.bm25(wanted, index, 20)).select("query_id", "docid", F.round("norm", 6).alias("norm"))


@query("""SELECT event_id, round(1 / (1 + exp(-(0.3e0 * value - 2))), 6) AS curve, round(1 / (1 + exp(-greatest(-30, least(30, value)))), 6) AS clipped FROM events""")
def n2_sigmoids(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.round(N.calibrated(F.col("value"), 0.3, -2.0), 6).alias("curve"), F.round(N.sigmoid(F.col("value")), 6).alias("clipped"))


@query("""WITH m AS (SELECT conv_id, turn, role, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM conversations)
SELECT conv_id, 'user ' || CAST(max(CASE WHEN role = 'user' THEN turn END) AS VARCHAR) AS heading, string_agg(CASE WHEN role <> 'user' THEN 'turn ' || turn END, ' ' ORDER BY turn) AS text
FROM m GROUP BY conv_id, part HAVING count(*) FILTER (WHERE role <> 'user') > 0""")
def w4_carry_forward(spark, sf_dir):
    """Each user's turn becomes a heading, which its answers carry; each conversation is one document."""
    turn = F.col("turn").cast("string")
    line = F.when(F.col("role") == "user", F.concat(F.lit("# user "), turn)).otherwise(F.concat(F.lit("turn "), turn))
    told = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    docs = told.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    return ingest.sections(docs).where("heading is not null or text not like '#%'").select("conv_id", "heading", "text")


# --- generic relational smoke queries --------------------------------------------------------------


def relational(name: str, sql: str, duck: str | None = None) -> None:
    """One statement for both engines."""

    def run(spark, sf_dir):
        used = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if t in sql]
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = (duck or sql).replace("{", "").replace("}", "")


relational("r1_pricing", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
relational("r3_shipping", """SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey
  JOIN {lineitem} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
relational("r5_local_suppliers", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name""")
relational("r6_forecast", """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
relational("r10_rollup", """SELECT p_brand, p_type, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY ROLLUP (p_brand, p_type)""")
relational("r13_customers_without_orders", """SELECT count(*) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey WHERE o_orderkey IS NULL""")
