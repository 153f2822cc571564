"""Folders of mixed files as raw documents: text, source, ext, row, line, page.

One binaryFile scan lists, filters and reads; size limits reach the scan. Formats are unfolded with
built-in functions, JSON with an Arrow UDF. A file that cannot be read gives no documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.functions import text as X
from siftwood.functions.vectors import decoded, json_leaves, json_line

# Extensions that are read as text, and folders that are passed over.
TEXT_EXTENSIONS = "txt md rst py rs go js ts jsx tsx java c cpp h hpp cs html htm css xml yaml yml toml ini cfg sh sql log env".split()
SKIPPED_FOLDERS = ".git __pycache__ node_modules .venv venv dist build .idea .vscode".split()
MAX_BYTES = 20 * 1024 * 1024

PLACES = ("row", "line", "page")


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, ext, content of the files below root, in no order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folders = "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS)
    kept = files.where((F.col("length") <= max_bytes) & ~F.col("path").rlike(f"/({folders})/"))
    name = F.element_at(F.split("path", "/"), -1)
    return kept.select("path", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "content")


def _documents(rows: DataFrame, text, **places) -> DataFrame:
    cells = [places.get(p, F.lit(None)).cast("int").alias(p) for p in PLACES]
    return rows.select(text.alias("text"), F.col("path").alias("source"), "ext", *cells)


def lines_of(text):
    return F.split(text, "\r\n|\r|\n")


def csv_rows(files: DataFrame) -> DataFrame:
    """One document per row after the header, ``name: cell`` joined by bars, empty cells left out.

    Lines are split first, so a quoted line end breaks a row. files: (path, ext, body).
    """

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        csv.field_size_limit(1 << 30)

        def one(line: str) -> list[str] | None:
            try:
                return next(csv.reader([line]), [])
            except csv.Error:  # such a line gives no document
                return None

        for pdf in batches:
            yield pdf[["path", "ext", "at"]].assign(cells=[one(line) for line in pdf["line"]])

    lines = files.select("path", "ext", F.posexplode(lines_of(F.col("body"))).alias("at", "line"))
    split = lines.mapInPandas(cells, "path string, ext string, at int, cells array<string>")
    heads = split.where("at = 0").select("path", F.col("cells").alias("names"))
    joined = split.where("at > 0 and cells is not null").join(heads, "path")
    pair = F.zip_with(F.slice("names", 1, F.size("cells")), F.slice("cells", 1, F.size("names")), lambda h, c: F.when(c != "", F.concat(h, F.lit(": "), c)))
    text = X.clean(F.array_join(F.array_compact(pair), " | "))
    return _documents(joined, text, row=F.col("at")).where("text <> ''")


def json_lines(files: DataFrame) -> DataFrame:
    """One document per line that holds JSON; the line number counts all lines."""
    lines = files.select("path", "ext", F.posexplode(lines_of(F.col("body"))).alias("at", "value")).where(F.trim("value") != "")
    return _documents(lines, json_line(F.trim("value")), line=F.col("at") + 1).where("text is not null")


def json_documents(files: DataFrame) -> DataFrame:
    """One document per leaf: ``path: value``."""
    return _documents(files.select("path", "ext", F.explode(json_leaves("body")).alias("leaf")), F.col("leaf"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """One document per page; none where the PDF library is not installed. files: (path, ext, content)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pages(contents: pd.Series) -> pd.Series:
        def one(data: bytes) -> list[str]:
            import io

            try:
                from pypdf import PdfReader
            except ImportError:
                return []
            try:
                return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
            except Exception:  # a broken file gives no documents
                return []

        return contents.map(one)

    return _documents(files.select("path", "ext", F.posexplode(pages("content")).alias("at", "body")), F.col("body"), page=F.col("at") + 1)


def load(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All documents below root."""
    files = scan(spark, root, max_bytes)
    bodies = files.where(F.col("ext").isin(*TEXT_EXTENSIONS, "csv", "jsonl", "ndjson", "json")).select("path", "ext", decoded("content").alias("body"))
    plain = bodies.where(F.col("ext").isin(*TEXT_EXTENSIONS))
    parts = [
        _documents(plain, F.col("body")),
        csv_rows(bodies.where("ext = 'csv'")),
        json_lines(bodies.where("ext in ('jsonl', 'ndjson')")),
        json_documents(bodies.where("ext = 'json'")),
        pdf_pages(files.where("ext = 'pdf'")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def species_folders(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Cards (species, text, toxic) and photos (species, path, digest, content) of ``root/<species>/``."""
    species = F.element_at(F.split("path", "/"), -2)
    read = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    cards = read("card.md").select(species.alias("species"), decoded("content").alias("text")).withColumn("toxic", X.toxicity(F.col("text")))
    photos = read("*.{jpg,jpeg,png}").select(species.alias("species"), "path", F.md5("content").alias("digest"), "content")
    return cards, photos


def photo_counts(docs: DataFrame) -> DataFrame:
    """species, n: how many images (kind) each species has."""
    return docs.where("kind = 'image'").groupBy("species").agg(F.count("*").alias("n"))


def new_images(photos: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One photo per content, without those whose digest is known."""
    once = photos.dropDuplicates(["digest"])
    return once if known is None else once.join(known.select("digest"), "digest", "left_anti")


def first_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """A sampler: the first n rows of each group."""
    from pyspark.sql import Window as W

    return rows.withColumn("__place", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("__place") <= n).drop("__place")
