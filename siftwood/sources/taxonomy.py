"""A taxonomy from two tab-separated tables: names and taxa. Species with their genus and family."""

from __future__ import annotations

import shutil
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = ("species", "genus", "family")


def unzip(archive: str, folder: str) -> dict[str, str]:
    """Unpacks name.tsv and taxon.tsv into a folder all executors can read."""
    out = {}
    with zipfile.ZipFile(archive) as z:
        for member in ("name.tsv", "taxon.tsv"):
            out[member] = str(Path(folder, member))
            with z.open(member) as src, open(out[member], "wb") as dst:
                shutil.copyfileobj(src, dst)
    return out


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("quote", '"').csv(path)


def backbone(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """id, name, genus, family per species.

    names: (ID, scientificName, genus, rank); taxa: (ID, nameID, parentID). A parent gives the genus, its own
    parent the family; without a parent the name's own genus stands and the family is empty.
    """
    own = names.where(F.col("rank").isin(*RANKS)).select(F.col("ID").alias("nameID"), F.trim(F.coalesce("scientificName", F.lit(""))).alias("name"), F.trim(F.coalesce("genus", F.lit(""))).alias("genus"), "rank")
    known = taxa.select(F.col("ID").alias("id"), "nameID", F.col("parentID").alias("parent")).join(own, "nameID")
    genus = known.select(F.col("id").alias("parent"), F.col("name").alias("g_name"), F.col("parent").alias("g_parent"))
    family = known.select(F.col("id").alias("g_parent"), F.col("name").alias("f_name"))
    rows = known.where("rank = 'species'").join(genus, "parent", "left").join(family, "g_parent", "left")
    return rows.select("id", "name", F.coalesce(F.nullif("g_name", F.lit("")), "genus").alias("genus"), F.coalesce("f_name", F.lit("")).alias("family"))


def write_backbone(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def skeletons(rows: DataFrame, family: str, limit: int = 500) -> DataFrame:
    """folder, card for the first ``limit`` species of a family by id (the feature): a card to fill in."""
    parts = F.split("name", r"\s+")
    chosen = rows.where((F.col("family") == family) & (F.size(parts) >= 2)).orderBy("id").limit(limit)
    card = F.concat(
        F.lit("# "), "name", F.lit("\n\n- семейство: "), "family", F.lit("\n- род: "), "genus", F.lit("\n- wfo: "), "id", F.lit("\n- ядовит: неизвестно\n")
    )
    return chosen.select(F.concat_ws("_", F.get(parts, 0), F.get(parts, 1)).alias("folder"), card.alias("card"))


def write_skeletons(cards: DataFrame, root: str) -> int:
    """Writes cards that do not exist yet below a folder all executors can reach; returns how many."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = 0
            for folder, card in zip(pdf["folder"], pdf["card"], strict=True):
                place = Path(root, folder, "card.md")
                place.parent.mkdir(parents=True, exist_ok=True)
                if not place.exists():
                    place.write_text(card, encoding="utf-8")
                    n += 1
            yield pd.DataFrame({"n": [n]})

    return cards.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
