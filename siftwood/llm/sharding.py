"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents with equal texts are linked through their group. Each round counts every group's documents
per shard, names the shard with most of them, and lets members move there as far as that shard has room;
room is dealt by a hash, so no round sorts the corpus. A last pass settles the law ``rows``: shard sizes
differ by one document at most. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.llm.shared import content_key, materialise

SHARDS = 40
ROUNDS = 3
SLACK = 0.05
SALTS = 16
CELLS = 16
#: Rows that one window of the last pass may number, on average, where a shard holds one group only.
PART_ROWS = 1_000_000


def propagate(docs: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """docs has __sw_k1, __sw_k2 (the group) and __sw_mix (a hash of the row); adds __sw_shard and __sw_linked.

    Rows start on a shard by their own hash. A round's state is one small table of groups with more than
    one row and their wanted shard; rows in no such group never move.
    """
    total = docs.count()
    room = (1 + SLACK) * total / shards
    group = ["__sw_k1", "__sw_k2"]
    many = docs.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")
    salt = F.pmod(F.col("__sw_mix"), F.lit(SALTS)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__sw_salt")
    docs = docs.withColumns({"__sw_salt": salt, "__sw_shard": F.pmod(F.shiftright("__sw_mix", 8), F.lit(shards)).cast("int")})
    marked = docs.join(many.select(*group, spread, F.lit(True).alias("__sw_linked")), [*group, "__sw_salt"], "left")
    state = materialise(marked.withColumn("__sw_linked", F.coalesce("__sw_linked", F.lit(False))), "shard0")
    for step in range(rounds):
        # what each group has on each shard, and the shard it has most on; the lowest shard wins ties
        have = state.where("__sw_linked").groupBy(*group, "__sw_shard").agg(F.count("*").alias("c"))
        want = have.groupBy(*group).agg(F.max_by("__sw_shard", F.struct("c", (-F.col("__sw_shard")).alias("s"))).alias("__sw_want"), F.sum("c").alias("n"), F.max("c").alias("top"))
        want = want.where("top < n")
        # unlinked rows give up their places when sizes are settled, so linked ones alone take up room; one row per shard
        load = {r[0]: r[1] for r in have.groupBy("__sw_shard").agg(F.sum("c")).collect()}
        asked = {r[0]: r[1] for r in want.groupBy("__sw_want").agg(F.sum(F.col("n") - F.col("top"))).collect()}
        if not asked:
            break
        # movers leave room behind, so a shard may take what it has free and what its own movers give up
        leaving = {r[0]: r[1] for r in have.join(want, group).where("__sw_shard <> __sw_want").groupBy("__sw_shard").agg(F.sum("c")).collect()}
        chance = F.array(*(F.lit(min(1.0, max(0.0, room - load.get(s, 0) + leaving.get(s, 0) / 2) / max(1, asked.get(s, 0)))) for s in range(shards)))
        moved = state.join(want.select(*group, spread, "__sw_want"), [*group, "__sw_salt"], "left")
        draw = F.pmod(F.xxhash64("__sw_mix", F.lit(step)), F.lit(1 << 20)) / (1 << 20)
        goes = F.col("__sw_linked") & F.col("__sw_want").isNotNull() & (draw < F.get(chance, F.col("__sw_want")))
        state = materialise(moved.withColumn("__sw_shard", F.when(goes, F.col("__sw_want")).otherwise(F.col("__sw_shard"))).drop("__sw_want"), f"shard{step + 1}")
    return state.drop("__sw_salt")


def settle(state: DataFrame, shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot``: counts differ by one at most, slots run gapless from 0.

    Rows are numbered within cells of a shard, linked rows first and whole groups together, and each cell's
    offset is summed up over the table of cells, a join away. Rows beyond their shard's quota take the free slots
    of the others in order, so unlinked rows move first.
    """
    cell = (F.when(F.col("__sw_linked"), F.pmod("__sw_k1", F.lit(CELLS))).otherwise(CELLS + F.pmod(F.shiftright("__sw_mix", 20), F.lit(CELLS)))).cast("int")
    # one group may fill a cell: its rows are dealt to parts of their own
    parts = max(8, state.count() // (shards * PART_ROWS))
    part = F.pmod(F.shiftright("__sw_mix", 4), F.lit(parts)).cast("int")
    state = state.withColumns({"__sw_cell": cell * parts + part})
    cells = materialise(state.groupBy("__sw_shard", "__sw_cell").agg(F.count("*").alias("__sw_n")), "cells")
    load = [0] * shards
    for r in cells.groupBy("__sw_shard").agg(F.sum("__sw_n").alias("n")).collect():  # one row per shard
        load[r["__sw_shard"]] = r["n"]
    # a shard's cells in order, each with the number of rows before it
    upto = W.partitionBy("__sw_shard").orderBy("__sw_cell").rowsBetween(W.unboundedPreceding, -1)
    table = cells.select("__sw_shard", "__sw_cell", F.coalesce(F.sum("__sw_n").over(upto), F.lit(0)).alias("__sw_before"))
    total = sum(load)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    over, free, first_over, first_free = 0, 0, [], []
    for s in range(shards):
        first_over.append(over)
        first_free.append(free)
        over += max(0, load[s] - quota[s])
        free += max(0, quota[s] - load[s])
    rank = F.row_number().over(W.partitionBy("__sw_shard", "__sw_cell").orderBy("__sw_k1", "__sw_k2", "__sw_mix", "doc_id"))
    numbered = state.withColumn("__sw_rank", rank).join(table, ["__sw_shard", "__sw_cell"])
    at = F.col("__sw_before") + F.col("__sw_rank") - 1
    longs = lambda x: F.array(*(F.lit(v).cast("long") for v in x))
    excess = at - F.get(longs(quota), F.col("__sw_shard"))
    place = excess + F.get(longs(first_over), F.col("__sw_shard"))
    # the last shard whose free slots begin at or before the place, among those that have any
    holes = [s for s in range(shards) if load[s] < quota[s]]
    host = F.lit(0)
    for s in holes:
        host = F.when(place >= first_free[s], s).otherwise(host)
    host_slot = place - F.get(longs(first_free), host) + F.get(longs(load), host)
    stays = excess < 0
    return numbered.withColumns({"shard": F.when(stays, F.col("__sw_shard")).otherwise(host).cast("int"), "slot": F.when(stays, at).otherwise(host_slot)})


def assign_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text; nothing else is used).

    A null text counts as empty: size 16 and the CRC of nothing, in one group with empty texts. Equal rows
    are interchangeable. Ties in the order of rows fall to doc_id, nulls first. An empty table has no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = content_key(text)
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        k1.alias("__sw_k1"),
        k2.alias("__sw_k2"),
        F.xxhash64(F.lit("row"), "doc_id", text).alias("__sw_mix"),
    )
    placed = settle(propagate(materialise(base, "sizes"), shards, rounds), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
