"""Connected components by alternating large-star and small-star rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.llm.shared import materialise, salted_join

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to its smallest neighbour, itself included. One vertex may have most edges, so its row is salted."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return salted_join(both.where("b > a"), least, "a", "b").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links itself and its smaller neighbours to the smallest of them; after a large star it has few."""
    least = F.min("a").over(W.partitionBy("b"))
    ends = edges.select(least.alias("m"), F.explode(F.array("a", "b")).alias("v"))
    return ends.where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """vertex, component (the smallest vertex reachable) for every vertex of edges (a, b long).

    edges are read twice, so let them be a stored table. Each round's edges go to the shared folder, so a lost executor
    costs one round; a sum over what is written tells when nothing changes any more. Loops are ignored. With ``rounds``
    it stops early: equal components are connected still, but one component may go by several names.
    """
    state, before = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), None
    for _ in range(rounds or MAX_ROUNDS):
        seen = Observation()
        found = _small_star(_large_star(state))
        state = materialise(found.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "edges")
        if seen.get == before or not seen.get["n"]:
            break
        before = seen.get
    else:
        if not rounds:
            raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    ends = F.explode(F.array(F.struct(F.col("b").alias("vertex")), F.struct(F.col("a").alias("vertex")))).alias("e")
    return state.select(ends, F.col("a").alias("component")).groupBy(F.col("e.vertex").alias("vertex")).agg(F.min("component").alias("component"))
