"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, encoding.

Each stage gets the session, the documents its predecessor kept and the folder of tables, and returns a
DataFrame that ``run`` writes to the shared folder and reads again for the next. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from siftwood.llm.shared import materialise

#: A document goes where its language cannot be told: no letter, or no language clearly likeliest.
LEAST_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose likeliest language has less than LEAST_SCORE."""
    import public_tokenizers

    model = language_id.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = language_id.identify(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines and sets n_chars anew; a document that loses all of its text goes."""
    cut = line_dedup.dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.btrim(F.col("text"), F.lit(line_dedup.BLANK)) != ""))
    chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return cut.select(*(chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; five words, similarity 0.8."""
    found = near_dedup.near_duplicates(docs, near_dedup.Join(percent=80, trees=5))
    # stored first: its size decides whether the texts have to be shuffled
    gone = materialise(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the digests of the ids and of the bytes they decode to."""
    ranks, pattern = bpe.public_files()
    return bpe.digests(bpe.round_trip(docs.select("doc_id", "text"), ranks, pattern)).select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Several stages are beyond SQL; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
