"""From raw documents to chunks: sections by markdown headings, sentence windows, duplicates by simhash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.functions import text as T
from siftwood.functions.vectors import simhash

HEADING = r"^\s*#{1,6}\s+(.*)$"


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with section (number) and heading per run of lines under one heading, text being the run's body.

    Sections come from one document's own lines, so they are cut in place: no shuffle, no window. Equal
    headings in different places stay apart. A document without any body line keeps its whole text.
    """
    others = [c for c in docs.columns if c != text]
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n")
    empty = F.struct(F.lit(None).cast("string").alias("heading"), F.array().cast("array<string>").alias("lines"))
    step = lambda acc, line: F.when(line.rlike(HEADING), F.concat(acc, F.array(F.struct(F.trim(F.regexp_extract(line, HEADING, 1)).alias("heading"), F.array().cast("array<string>").alias("lines"))))).otherwise(
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["heading"].alias("heading"), F.concat(F.element_at(acc, -1)["lines"], F.array(line)).alias("lines"))))
    )
    runs = F.aggregate(lines, F.array(empty), step)
    bodies = F.filter(F.transform(runs, lambda r: F.struct(r["heading"].alias("heading"), T.clean(F.array_join(r["lines"], " ")).alias("body"))), lambda r: r["body"] != "")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"), T.clean(F.col(text)).alias("body")))
    headed = F.col(text).rlike(r"(?m)^\s*#{1,6}\s")
    # texts without a heading, the usual case, need no walk over their lines
    parts = F.when(F.coalesce(headed, F.lit(False)), F.when(F.size(bodies) > 0, bodies).otherwise(whole)).otherwise(whole)
    return docs.select(*others, F.posexplode(parts).alias("section", "__s")).select(*others, "section", F.col("__s.heading").alias("heading"), F.col("__s.body").alias(text))


def chunks(docs: DataFrame, size: int = 2, overlap: int = 1) -> DataFrame:
    """docs with section, heading, chunk (number in its section) and text, the chunk."""
    cut = sections(docs)
    others = [c for c in cut.columns if c != "text"]
    return cut.select(*others, F.posexplode(T.windows(T.split_sentences(F.col("text")), size, overlap)).alias("chunk", "text"))


def unseen(rows: DataFrame, known: DataFrame | None = None, within: bool = False) -> DataFrame:
    """rows with simhash, without those whose hash is among known (simhash); with ``within`` equal hashes stay once."""
    marked = rows.withColumn("simhash", simhash("text"))
    marked = marked if known is None else marked.join(known.select("simhash").distinct(), "simhash", "left_anti")
    return marked.dropDuplicates(["simhash"]) if within else marked
