"""The segment store: immutable Parquet segments, tombstones, and snapshots behind a pointer file.

Paths go through Hadoop's file system, so any store Spark writes to will do.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """root/segments/segment=N, root/tombstones, root/<table>/v=N, root/CURRENT."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # small files
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def write_note(self, name: str, value) -> None:
        """Writes JSON under a draft name and renames it, so readers see the old or the new."""
        fs, path = self._path(name)
        _, draft = self._path(f"{name}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        out.close()
        fs.delete(path, False)
        fs.rename(draft, path)

    def read_note(self, name: str, default=None):
        fs, path = self._path(name)
        if not fs.exists(path):
            return default
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # segments
    def manifest(self) -> dict:
        return self.read_note("CURRENT", {"version": 1, "segments": []})

    def size(self) -> int:
        return sum(s["n"] for s in self.manifest()["segments"])

    def append(self, docs: DataFrame) -> int:
        """Writes docs (text and the like, no docid) as a new segment with docids that go on from the last one; returns its rows.

        Docids are dense and follow the rows' order (source, row, line, page, text), which neighbour lookups rely on.
        """
        manifest = self.manifest()
        first = sum(s["n"] for s in manifest["segments"])
        number = len(manifest["segments"])
        keys = [c for c in ("source", "row", "line", "page", "chunk", "text") if c in docs.columns]
        ordered = docs.orderBy(*keys)  # a range sort: partitions follow one another
        path = f"{self.root}/segments/segment={number}"
        schema = ordered.schema
        rows = ordered.rdd.zipWithIndex().map(lambda x: (x[1] + first, *x[0]))
        from pyspark.sql import types as T

        numbered = self.spark.createDataFrame(rows, T.StructType([T.StructField("docid", T.LongType()), *schema.fields]))
        numbered.write.mode("overwrite").parquet(path)
        n = self.spark.read.parquet(path).count()
        if n:  # the next segment takes the place of an empty one
            manifest["segments"].append({"name": f"segment={number}", "n": n})
            found = self.spark.read.option("basePath", f"{self.root}/segments").parquet(path).schema
            manifest.setdefault("schema", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found))  # no reader has to look it up
            self.write_note("CURRENT", manifest)
        return n

    def documents(self, segment: str | None = None) -> DataFrame | None:
        """All committed segments, or one; None where there is none."""
        names = [f"{self.root}/segments/{s['name']}" for s in self.manifest()["segments"] if segment in (None, s["name"])]
        read = self.spark.read.option("basePath", f"{self.root}/segments")
        schema = self.manifest().get("schema")
        return (read.schema(schema) if schema else read).parquet(*names) if names else None

    def bury(self, docids: DataFrame) -> None:
        docids.select(F.col("docid").cast("long").alias("docid")).distinct().write.mode("append").parquet(f"{self.root}/tombstones")

    def tombstones(self) -> DataFrame:
        fs, path = self._path("tombstones")
        return self.spark.read.parquet(str(path)).distinct() if fs.exists(path) else self.spark.createDataFrame([], "docid long")

    def remove_source(self, part: str) -> int:
        """Buries documents whose source contains the string; returns how many are new."""
        docs = self.documents()
        if docs is None:
            return 0
        found = live(docs, self.tombstones()).where(F.col("source").contains(part)).select("docid")
        n = found.count()
        if n:
            self.bury(found)
        return n

    # snapshots of derived tables
    def save(self, **tables: DataFrame) -> int:
        """Writes every table to a new version and then flips the pointer to it."""
        version = (self.read_note("SNAPSHOT", {"version": 0}))["version"] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/snapshot/v={version}/{name}")
        self.write_note("SNAPSHOT", {"version": version, "tables": sorted(tables)})
        return version

    def load(self) -> dict[str, DataFrame]:
        note = self.read_note("SNAPSHOT")
        return {n: self.spark.read.parquet(f"{self.root}/snapshot/v={note['version']}/{n}") for n in note["tables"]} if note else {}


def live(docs: DataFrame, tombstones: DataFrame) -> DataFrame:
    return docs.join(tombstones, "docid", "left_anti")


def source_counts(docs: DataFrame) -> DataFrame:
    """source, n."""
    return docs.groupBy("source").agg(F.count("*").alias("n"))


def health(docs: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: n_docs, n_live, n_images, n_sources, n_species of docs (docid, source, and where present kind and species)."""
    marked = docs.join(dead.select("docid", F.lit(True).alias("dead")).distinct(), "docid", "left")
    image = (F.col("kind") == "image") if "kind" in docs.columns else F.lit(False)
    species = F.col("species") if "species" in docs.columns else F.lit(None).cast("string")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return marked.agg(F.count("*").alias("n_docs"), one(F.col("dead").isNull()).alias("n_live"), one(image).alias("n_images"), F.countDistinct("source").alias("n_sources"), F.countDistinct(species).alias("n_species"))
