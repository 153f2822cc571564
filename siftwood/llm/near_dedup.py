"""Near duplicates by a chosen-path set similarity join.

Documents are sets of five-word shingles. Equal sets go on as one. Several independent trees then branch the
sets: a node chooses a few minwise coordinates by its level and tree, and each sends a set to the child named
by its minimum there, so similar sets tend to stay together. Nodes whose sets are connected already, or that
have the same members as another, end at once. Most sets that meet share one minimum by chance: all minima and
the sizes tell these apart before any set is fetched. Small nodes are compared exhaustively on full sets. A large
node of sets alike does not fall apart: its sets are compared with some pivots first, and those outside the
component that results with every set of the node, block by block. The first tree goes ahead of the others,
which find most nodes connected and only look for what it has missed. Comparisons hand on a star for each
group that they connect, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm.components import connected_components
from siftwood.llm.shared import arrow_map, materialise, salted_join, shingle_sets, text_slices


@dataclass(frozen=True)
class Join:
    """percent: least Jaccard similarity of a link, times 100.

    A pair at similarity s stays together on a level with probability 1 - (1 - s) ** branches, so at 0.85
    four trees of three levels with two branches miss about one pair in a million. node: sets that are
    compared at once; block and weight: sets and shingles of one part of a large node.
    """

    percent: int = 85
    trees: int = 4
    branches: int = 2
    levels: int = 3
    node: int = 64
    block: int = 512
    weight: int = 1_000_000

    @property
    def coordinates(self) -> int:
        return self.trees * self.branches * self.levels

    @property
    def agreeing(self) -> int:
        """The coordinates in which two sets agree at least: a pair at the least similarity has fewer with a probability below UNLIKE."""
        s, below = self.percent / 100, 0.0
        for k in range(self.coordinates):
            below += comb(self.coordinates, k) * s**k * (1 - s) ** (self.coordinates - k)
            if below > UNLIKE:
                return k
        return self.coordinates


#: Sets that a large node's sets are held against first, and parts that the copies of one set are dealt to.
PIVOTS = 8
COPY_SALTS = 16
#: Of linked pairs that meet, the share that their minima may part: a thousandth of what the trees miss.
UNLIKE = 1e-9
SIGNATURES = "doc_id long, n_shingles long, h1 long, h2 long, minima array<int>"


def signatures(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """Per row: the set's size, 128 bits that identify it, and its minimum under each coordinate's hash."""
    rng = np.random.default_rng(20240229)
    odd = rng.integers(0, 1 << 63, how.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, how.coordinates, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"))
            sizes = np.array([len(s) for s in sets], np.int64)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            full, minima = np.flatnonzero(sizes), np.zeros((len(sets), how.coordinates), np.int32)
            if len(full):
                every, begins = np.concatenate([sets[i] for i in full]), np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                for k in range(how.coordinates):
                    hashed = (every ^ flip[k]) * odd[k]
                    hashed = (hashed ^ (hashed >> np.uint64(31))) * odd[k] >> np.uint64(33)
                    minima[full, k] = np.minimum.reduceat(hashed, begins).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * how.coordinates), pa.array(minima.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), lists], ["doc_id", "n_shingles", "h1", "h2", "minima"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sign, SIGNATURES)


def stored_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, shingles (sorted 64-bit hashes as bytes) of the wanted documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 20):
            data = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data], ["doc_id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id")
    return arrow_map(texts, cut, "doc_id long, shingles binary")


def children(rows: DataFrame, level: int, how: Join) -> DataFrame:
    """The rows (tree, node, ...) of each node's children: node is the child, parent the node. Needs minima."""
    first = (F.col("tree") * how.levels + level) * how.branches
    kids = F.transform(F.sequence(F.lit(0), F.lit(how.branches - 1)), lambda i: F.xxhash64(F.col("node"), first + i, F.get("minima", first + i)))
    return rows.select(*(c for c in rows.columns if c not in ("node", "parent", "n", "weight")), F.col("node").alias("parent"), F.explode(kids).alias("node"))


def open_nodes(rows: DataFrame) -> DataFrame:
    """rows (tree, node, doc_id, size, c, ...) of nodes that hold two components or more, with n and weight.

    Of nodes with the same members one stays, of the lowest tree.
    """
    sums = [F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.sum(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30))).alias("y"), F.min("doc_id").alias("z")]
    found = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.min("tree").alias("t"), F.min("c").alias("low"), F.max("c").alias("high"), *sums).where("low < high")
    once = found.groupBy("n", "weight", "x", "y", "z").agg(F.min_by("node", F.struct("t", "node")).alias("node"))
    return salted_join(rows, once.select("node", "n", "weight"), "node", "doc_id")


def near_by_minima(minima: np.ndarray, sizes: np.ndarray, how: Join) -> np.ndarray:
    """Which sets of one node have another there that they may link with: by sizes none else can, by minima see Join.agreeing."""
    near, step = np.zeros(len(sizes), bool), max(1, (1 << 22) // minima.size)
    for low in range(0, len(sizes), step):
        part = slice(low, low + step)
        pairs = (minima[part, None] == minima).sum(2) >= how.agreeing
        pairs &= 100 * np.minimum(sizes[part, None], sizes) >= how.percent * np.maximum(sizes[part, None], sizes)
        near[part] = pairs.sum(1) > 1  # one is the set itself
    return near


def likely(rows: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """The rows (tree, node, doc_id, size, c) of nodes that near_by_minima keeps. No node has more sets than a block."""
    width = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["tree", "node", "doc_id", "size", "c"]
    met = rows.select(*names).join(sets.select("doc_id", "minima").hint("merge"), "doc_id").select(*names, "minima").repartition(width, "node").sortWithinPartitions("node")

    def kept(table: pa.Table) -> Iterator[pa.RecordBatch]:
        minima, sizes, nodes = table["minima"].combine_chunks().flatten().to_numpy(), table["size"].to_numpy(), table["node"].to_numpy()
        minima, ends = minima.reshape(-1, how.coordinates), np.append(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1, len(nodes))
        near = [near_by_minima(minima[a:b], sizes[a:b], how) for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
        yield from table.select(names).filter(pa.array(np.concatenate(near))).combine_chunks().to_batches()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last node's rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            others = np.flatnonzero(table["node"].to_numpy() != table["node"][-1].as_py())
            full = int(others[-1]) + 1 if len(others) else 0
            if full:
                yield from kept(table.slice(0, full))
            held = table.slice(full)
        if held is not None:
            yield from kept(held)

    return arrow_map(met, pick, rows.select(*names).schema)


def settle(rows: DataFrame, sets: DataFrame, how: Join) -> tuple[DataFrame, DataFrame | None]:
    """(node, doc_id) of the small nodes, and (tree, node, doc_id, n, weight) of the large ones that stay so; None without any.

    rows: open nodes of the first level. A large node branches on while that halves the work at least: sets that agree
    in a share s of coordinates leave s of the node in each child.
    """
    big = (F.col("n") > how.node) | (F.col("weight") > how.weight)
    small, ends = rows.where(~big).select("node", "doc_id"), None
    wide = rows.where(big)
    if wide.isEmpty():
        return small, None
    wide = materialise(wide.join(sets.select("doc_id", "minima").hint("merge"), "doc_id"), "wide")
    for level in range(1, how.levels):
        work = children(wide, level, how).groupBy("parent", "node").agg(F.count("*").alias("k")).groupBy("parent").agg(F.sum(F.col("k") * F.col("k")).alias("work"))
        sizes = wide.groupBy("node").agg(F.first("n").alias("n")).withColumnRenamed("node", "parent")
        parting = materialise(work.join(sizes.hint("merge"), "parent").where("2 * work < n * n").select("parent"), "parting")
        stay = salted_join(wide, parting.withColumnRenamed("parent", "node"), "node", "doc_id", "left_anti").select("tree", "node", "doc_id", "size", "c", "n", "weight")
        ends = stay if ends is None else ends.unionByName(stay)
        if parting.isEmpty():
            return small, ends
        kids = children(salted_join(wide, parting.withColumnRenamed("parent", "node"), "node", "doc_id", "left_semi"), level, how)
        found = materialise(open_nodes(kids), f"level{level}")
        small = small.unionByName(found.where(~big).select("node", "doc_id"))
        wide = found.where(big)
    wide = wide.select("tree", "node", "doc_id", "size", "c", "n", "weight")
    return small, wide if ends is None else ends.unionByName(wide)


def parts_of(n: Column, weight: Column, how: Join) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / how.block), F.ceil(weight / how.weight)).cast("int")


def dealt(large: DataFrame, how: Join) -> DataFrame:
    """Rows of large nodes with the number of blocks of their node and their own block."""
    blocks = parts_of(F.col("n"), F.col("weight"), how)
    return large.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("doc_id", "node"), blocks).cast("int")})


def stars(large: DataFrame, how: Join) -> DataFrame:
    """Members (node, doc_id, side) of seats that hold a block of a large node and the node's pivots, picked by a hash."""
    slot = F.pmod(F.xxhash64("doc_id", "node"), F.lit(PIVOTS))
    lowest = large.groupBy("node").agg(F.first("n").alias("n"), F.first("weight").alias("weight"), *(F.min(F.when(slot == i, F.struct(F.xxhash64("doc_id"), "doc_id"))).alias(f"p{i}") for i in range(PIVOTS)))
    blocks = F.sequence(F.lit(0), parts_of(F.col("n"), F.col("weight"), how) - 1)
    picked = materialise(lowest.select("node", F.array_compact(F.array(*(F.col(f"p{i}.doc_id") for i in range(PIVOTS)))).alias("pivots"), blocks.alias("blocks")), "pivots")
    seat = F.xxhash64(F.lit("star"), "node", "block").alias("node")
    first = picked.select("node", "pivots", F.explode("blocks").alias("block")).select(seat, F.explode("pivots").alias("doc_id"), F.lit(1).alias("side"))
    second = salted_join(dealt(large, how), picked.select("node", "pivots"), "node", "doc_id").where(~F.array_contains("pivots", F.col("doc_id")))
    return first.unionByName(second.select(seat, "doc_id", F.lit(2).alias("side")))


def rest(large: DataFrame, how: Join) -> DataFrame:
    """Members (node, doc_id, side) of seats where every set outside its large node's main component meets every set of the node."""
    main = large.groupBy("node", "c").agg(F.count("*").alias("k"), F.sum("size").alias("w")).groupBy("node").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("k"), F.sum("k").alias("every"), (F.sum("w") - F.max_by("w", F.struct("k", "c"))).alias("over")).where("k < every")
    choice = materialise(main.select("node", "main", parts_of(F.col("every") - F.col("k"), F.col("over"), how).alias("groups")), "choice")
    met = salted_join(dealt(large, how), choice, "node", "doc_id")
    met = met.withColumn("group", F.when(F.col("c") != F.col("main"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("groups")).cast("int")))
    seat = F.xxhash64(F.lit("rest"), "node", "group", "block").alias("node")
    one = met.where(F.col("group").isNotNull()).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # in the seat of its own group and block a set stands on the first side
    others = F.filter(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: ~g.eqNullSafe(F.col("group")))
    other = met.withColumn("group", F.explode(others))
    return one.select(seat, "doc_id", F.lit(1).alias("side")).unionByName(other.select(seat, "doc_id", F.lit(2).alias("side")))


def compare(sets: list[np.ndarray], ids: list[int], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """A star for each group of sets that links of one node connect, from its smallest id. side 0: with all; 1 and 2: with the other side only, 1 also with itself."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets], np.int64)
    rows = [i for i, side in enumerate(sides) if side != 2]
    if len(sets) == 2:
        shared = np.full((len(rows), 2), len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
    else:
        # only shingles that two sets have count; incidence times its transpose counts them for all pairs
        every = np.concatenate(sets)
        values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        number = np.cumsum(counts > 1) - 1
        held = counts[inverse] > 1
        width = int(number[-1]) + 1 if len(number) else 0
        shared = np.zeros((len(rows), len(sets)), np.float32)  # exact below 2 ** 24
        row = np.repeat(np.arange(len(sets)), sizes)[held]
        column = number[inverse[held]]
        for low in range(0, width, 4096):
            inside = (column >= low) & (column < low + 4096)
            grid = np.zeros((len(sets), min(4096, width - low)), np.float32)
            grid[row[inside], column[inside] - low] = 1
            shared += grid[rows] @ grid.T
    for i, both in zip(rows, shared, strict=True):
        for j in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes - both)).tolist():
            if j != i and (a := root(i)) != (b := root(j)):
                parent[b] = a
    least: dict[int, int] = {}
    for i, doc_id in enumerate(ids):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(least[root(i)], doc_id) for i, doc_id in enumerate(ids) if doc_id != least[root(i)]]


def confirm(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what links among each node's members connect, on full sets. members: node, doc_id, side.

    sets: doc_id, shingles. No node has more sets and shingles than a block of each side.
    """
    width = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.join(sets.hint("merge"), "doc_id").select("node", "doc_id", "side", "shingles").repartition(width, "node").sortWithinPartitions("node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        node, ids, sides, own = None, [], [], []
        for batch in batches:
            for n, doc_id, side, data in zip(*(batch.column(c).to_pylist() for c in ("node", "doc_id", "side", "shingles")), strict=True):
                if n != node:
                    if len(own) > 1:
                        found += compare(own, ids, sides, percent)
                    node, ids, sides, own = n, [], [], []
                ids.append(doc_id), sides.append(side), own.append(np.frombuffer(data, np.uint64))
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                found = []
        if len(own) > 1:
            found += compare(own, ids, sides, percent)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return arrow_map(rows, link, "a long, b long")


def with_components(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with c, the component of doc_id as far as it is known."""
    return rows.drop("c").join(known.hint("merge"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))


def links(docs: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """Links (a, b), a stored table, that connect all sets which links of the join connect.

    sets: doc_id, n_shingles, minima of distinct sets.
    """
    paths = F.flatten(F.array(*(F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(k), F.get("minima", k)).alias("node")) for k in range(t * how.levels * how.branches, (t * how.levels + 1) * how.branches))) for t in range(how.trees))))
    rows = sets.select("doc_id", F.col("n_shingles").alias("size"), F.col("doc_id").alias("c"), F.explode(paths).alias("p")).select("p.tree", "p.node", "doc_id", "size", "c")
    met = materialise(open_nodes(rows), "level0")
    names, few = ["tree", "node", "doc_id", "size", "c"], F.col("n") <= how.block
    level = materialise(open_nodes(likely(met.where(few), sets, how).unionByName(met.where(~few).select(*names))), "likely")
    pool = materialise(stored_sets(docs, materialise(level.select("doc_id").distinct(), "involved")), "pool")
    both = lambda nodes: nodes.withColumn("side", F.lit(0))

    def found(members: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """All links so far, and the components they make as far as two rounds tell."""
        new = confirm(pool, members, how.percent)
        kept = materialise(new if before is None else new.unionByName(before.select(F.col("c").alias("a"), F.col("doc_id").alias("b")).where("a <> b")), "links")
        return kept, materialise(connected_components(kept, rounds=2).withColumnsRenamed({"vertex": "doc_id", "component": "c"}), "known")

    small, large = settle(level.where("tree = 0"), sets, how)
    kept, known = found(both(small) if large is None else both(small).unionByName(stars(large, how)), None)
    if large is not None:
        kept, known = found(rest(materialise(with_components(large, known), "large"), how), known)
    level = materialise(open_nodes(with_components(level.where("tree > 0"), known).drop("n", "weight")), "late")
    small, large = settle(level, sets, how)
    late = both(small) if large is None else both(small).unionByName(rest(materialise(large, "large"), how))
    return materialise(confirm(pool, late, how.percent).unionByName(known.select(F.col("c").alias("a"), F.col("doc_id").alias("b")).where("a <> b")), "links")


def near_duplicates(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Rows of one doc_id are one vertex. Texts without a word have an empty set, link with nothing and are kept.
    Rows without a doc_id cannot be named: they link with nothing, have a null component_id and are kept.
    """
    signed = materialise(signatures(docs, how), "signed")
    named = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    sets = materialise(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("minima").alias("minima")), "sets")
    # a doc_id whose rows differ connects their sets
    unlike = named.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).where("low <> high").select("doc_id")
    several = named.select("doc_id", "h1", "h2").join(unlike.hint("merge"), "doc_id").distinct()
    own = several.withColumnRenamed("doc_id", "b").join(sets.select("h1", "h2", F.col("doc_id").alias("a")).hint("merge"), ["h1", "h2"]).select("a", "b").where("a <> b")
    edges = materialise(links(docs, sets, how).unionByName(own), "edges")
    parts = connected_components(edges).withColumnsRenamed({"vertex": "doc_id"})
    # equal sets join after their components are known; a set with many copies is dealt out by salts
    named_sets = sets.select("h1", "h2", "doc_id", "copies").join(parts.hint("merge"), "doc_id", "left").select("h1", "h2", F.coalesce("component", "doc_id").alias("component"), "copies", F.col("doc_id").alias("first"))
    salt = lambda c: F.pmod(F.xxhash64(c, F.lit("copy")), F.lit(COPY_SALTS)).cast("int")
    salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))).otherwise(F.array(salt("first")))
    facts = named_sets.select("h1", "h2", "component", F.explode(salts).alias("salt"))
    joined = signed.drop("minima").withColumn("salt", salt("doc_id")).join(facts.hint("merge"), ["h1", "h2", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(x[i : i + 4], ' ') AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(x) - 3))) AS i) WHERE len(x) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
edges AS MATERIALIZED (
  SELECT a, b FROM links JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
