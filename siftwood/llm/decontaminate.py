"""Benchmark decontamination by SimHash over item-sized windows. DataFrame functions only.

A window of a document is as long, in words, as a benchmark item. Similarity takes no account of order,
so windows are laid at every position where they hold enough shingles that items of their length have,
wherever in the item these stand: a window with fewer cannot reach the least similarity, which its
shared shingles over the item's own bound. Windows and items get 64-bit SimHash
fingerprints of their shingles, weighted by how often each occurs. Fingerprints are cut into a few wide
blocks; if every block of two were further apart than its share of the radius, together they would be
beyond it. So items are entered under every value within that share of each of their blocks, and an
equi-join on length, block number and block value finds all pairs within the radius. These are then held
to the exact weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm.shared import SHINGLE, content_key, materialise, salted_join

#: Places of item shingles (at most 32 bytes each in memory) up to which the index of items is broadcast.
BROADCAST_PLACES = 500_000


@dataclass(frozen=True)
class Match:
    """similarity: least weighted Jaccard similarity. Pairs at 0.8 lie 10 bits apart on average, 3 more or less."""

    similarity: float = 0.8
    radius: int = 19
    blocks: int = 5


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased; null and blank texts have none."""
    clean = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[\x20\x09-\x0D]+"))


def shingles_of(words: Column, k: int = SHINGLE) -> Column:
    """Hashes of each k successive words; none where there are fewer."""
    count = F.size(words) - (k - 1)
    each = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(*(F.element_at(words, i + j) for j in range(k))))
    return F.when(count > 0, each).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """64 bits, each set where the occurrences that have it outweigh those that lack it."""

    def votes(low: int) -> Column:
        # three counters of 21 bits share a long: a window would need two million shingles to overflow one
        lane = lambda x, b: F.shiftleft(F.shiftright(x, low + b).bitwiseAND(F.lit(1)).cast("long"), 21 * b)
        spread = lambda x: reduce(lambda a, b: a.bitwiseOR(b), (lane(x, b) for b in range(min(3, 64 - low))))
        return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, x: acc + spread(x))

    totals = F.array(*(votes(low) for low in range(0, 64, 3)))

    def assemble(sums: Column) -> Column:
        shift = lambda name, x, by: F.call_function(name, x, by.cast("int"))
        count = lambda i: shift("shiftrightunsigned", F.get(sums, F.floor(i / 3)), 21 * (i % 3)).bitwiseAND(F.lit((1 << 21) - 1))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(shift("shiftleft", (2 * count(i) > F.size(shingles)).cast("long"), i)))

    # one element, so that the sums are made once for all bits
    return F.get(F.transform(F.array(totals), assemble), 0)


def widths_of(how: Match) -> list[tuple[int, int, int]]:
    """First bit, number of bits, and the distance to look for, of each block: if all were beyond theirs, the sum would be beyond the radius."""
    cuts = [64 * i // how.blocks for i in range(how.blocks + 1)]
    share = how.radius - how.blocks + 1
    return [(a, b - a, (share * (i + 1)) // how.blocks - (share * i) // how.blocks) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _value(fingerprint: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << bits) - 1))


def blocks_of(fingerprint: Column, how: Match) -> Column:
    """(block number, value) of each block; together they cover the 64 bits."""
    return F.array(*(F.struct(F.lit(i).alias("nr"), _value(fingerprint, a, n).alias("value")) for i, (a, n, _) in enumerate(widths_of(how))))


def probes_of(fingerprint: Column, how: Match) -> Column:
    """(block number, value) for every value within each block's share of the radius."""

    def near(nr: int, first: int, bits: int, far: int) -> Column:
        flips = [sum(1 << bit for bit in chosen) for k in range(far + 1) for chosen in combinations(range(bits), k)]
        own = _value(fingerprint, first, bits)
        return F.transform(F.from_json(F.lit(str(flips)), "array<bigint>"), lambda x: F.struct(F.lit(nr).alias("nr"), own.bitwiseXOR(x).alias("value")))

    return F.concat(*(near(i, *width) for i, width in enumerate(widths_of(how))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over the sum of the larger, of two arrays taken as multisets. 0 where both are empty."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


def items_of(benchmark: DataFrame, how: Match) -> DataFrame:
    """item_id, n (words), k (words per shingle), shingles, and i1, i2 that name their content. Items without words are left out."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    few = reduce(lambda acc, k: F.when(F.col("n") == k, shingles_of(F.col("words"), k)).otherwise(acc), range(1, SHINGLE), shingles_of(F.col("words")))
    cut = words.select("item_id", "n", F.least("n", F.lit(SHINGLE)).alias("k"), few.alias("shingles"))
    i1, i2 = content_key(F.col("shingles"))
    return cut.select("*", i1.alias("i1"), i2.alias("i2"))


def starts_of(at: Column, n: Column, how: Match) -> Column:
    """Where windows of n words start that hold enough of the shared shingles at these sorted positions.

    Similarity is at most the shared shingles over the item's. The i-th position is a window's first
    if the window starts after the position before it, and the window holds enough if it reaches
    the position that many further on.
    """
    last = n - F.least(n, F.lit(SHINGLE))  # from a window's start to its last shingle
    least = F.greatest(F.ceil((how.similarity - 1e-6) * (last + 1)).cast("int"), F.lit(1))
    low = lambda i: F.greatest(F.when(i > 1, F.element_at(at, i - 1) + 1).otherwise(F.element_at(at, i) - last), F.element_at(at, i + least - 1) - last)
    runs = lambda i: F.when(low(i) <= F.element_at(at, i), F.sequence(low(i), F.element_at(at, i))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(at) >= least, F.flatten(F.transform(F.sequence(F.lit(1), F.size(at) - least + 1), runs))).otherwise(F.array().cast("array<int>"))


def leaks(docs: DataFrame, benchmark: DataFrame, how: Match = Match()) -> DataFrame:
    """__sw_k1, __sw_k2 (a text), item_id, similarity: the best window of each text that matches an item.

    Works on texts, not rows: equal texts give one result. Items shorter than five words match whole.
    """
    items = materialise(items_of(benchmark, how), "items")
    sizes = [r[0] for r in items.select("k").distinct().collect()]  # five at most
    k1, k2 = content_key(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select(k1, k2, words_of(F.col("text")).alias("words"))
    seeds = materialise(items.select("k", "n", F.explode("shingles").alias("shingle")).distinct(), "seeds")
    narrow = seeds.count() <= BROADCAST_PLACES
    hits = None
    for k in sizes:
        each = texts.select("__sw_k1", "__sw_k2", F.posexplode(shingles_of(F.col("words"), k)).alias("pos", "shingle"))
        index = seeds.where(F.col("k") == k).select("shingle", "n")
        # broadcast where its measured size allows, else joined by shuffle
        shared = each.join(F.broadcast(index) if narrow else index, "shingle").select("__sw_k1", "__sw_k2", "n", "pos")
        hits = shared if hits is None else hits.unionByName(shared)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "__sw_k1 long, __sw_k2 long, item_id long, similarity double").withColumn("item_id", F.col("item_id").cast(benchmark.schema["item_id"].dataType))
    laid = hits.groupBy("__sw_k1", "__sw_k2", "n").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    laid = laid.select("__sw_k1", "__sw_k2", "n", starts_of(F.col("at"), F.col("n"), how).alias("starts")).where(F.size("starts") > 0)
    places = materialise(laid.groupBy("__sw_k1", "__sw_k2").agg(F.collect_list(F.struct("n", "starts")).alias("places")), "places")

    # each text once: its shingles are made once for all windows of a size, cut to the text where they reach over an end.
    # texts without a place go by their keys alone; places compress so well that their stored size says little
    held = texts.join(places.select("__sw_k1", "__sw_k2"), ["__sw_k1", "__sw_k2"], "left_semi").dropDuplicates(["__sw_k1", "__sw_k2"])
    once = held.join(places.hint("merge"), ["__sw_k1", "__sw_k2"])
    sized = once.select("__sw_k1", "__sw_k2", F.explode("places").alias("p"), "words").select("__sw_k1", "__sw_k2", F.col("p.n").alias("n"), F.col("p.starts").alias("starts"), "words")
    whole = sized.withColumn("all", reduce(lambda acc, k: F.when(F.col("n") == k, shingles_of(F.col("words"), k)).otherwise(acc), range(1, SHINGLE), shingles_of(F.col("words"))))
    windows = whole.select("__sw_k1", "__sw_k2", "n", F.explode("starts").alias("start"), "all")
    cut = F.slice("all", F.greatest("start", F.lit(0)) + 1, F.col("n") - F.least("n", F.lit(SHINGLE)) + 1 + F.least("start", F.lit(0)))
    shingled = windows.select("__sw_k1", "__sw_k2", "n", cut.alias("shingles"))
    # windows that read the same are fingerprinted and compared once
    print_of = content_key(F.col("shingles"))
    full = shingled.where(F.size("shingles") > 0).select("__sw_k1", "__sw_k2", "n", *(c.alias(n) for c, n in zip(print_of, ("c1", "c2"), strict=True)), "shingles")
    windows = materialise(full, "windows")
    contents = windows.groupBy("n", "c1", "c2").agg(F.first("shingles").alias("shingles"))
    marked = materialise(contents.withColumn("print", simhash(F.col("shingles"))), "prints")
    known = materialise(items.dropDuplicates(["n", "i1", "i2"]).withColumn("print", simhash(F.col("shingles"))), "prints")

    pairs = within_radius(marked, known, how).hint("merge")
    rated = pairs.join(marked.select("n", "c1", "c2", "shingles").hint("merge"), ["n", "c1", "c2"]).join(known.select("n", "i1", "i2", F.col("shingles").alias("wanted")).hint("merge"), ["n", "i1", "i2"])
    rated = rated.select("n", "c1", "c2", "i1", "i2", F.round(weighted_jaccard(F.col("shingles"), F.col("wanted")), 6).alias("similarity")).where(F.col("similarity") >= how.similarity)
    matches = materialise(rated.join(items.select("item_id", "n", "i1", "i2").hint("merge"), ["n", "i1", "i2"]).select("n", "c1", "c2", "item_id", "similarity"), "matches")
    # one content may stand in a third of all texts: salted, and rows of one content and item are rare
    return salted_join(windows.select("__sw_k1", "__sw_k2", "n", "c1", "c2"), matches, ["n", "c1", "c2"], "__sw_k1").groupBy("__sw_k1", "__sw_k2", "item_id").agg(F.max("similarity").alias("similarity"))


def within_radius(marked: DataFrame, known: DataFrame, how: Match) -> DataFrame:
    """n, c1, c2, i1, i2: all pairs of windows (n, c1, c2, print) and items (n, i1, i2, print) whose prints are within the radius."""
    ours = marked.select("n", "c1", "c2", "print", F.explode(blocks_of(F.col("print"), how)).alias("block"))
    theirs = known.select("n", "i1", "i2", F.col("print").alias("theirs"), F.explode(probes_of(F.col("print"), how)).alias("block"))
    near = ours.join(theirs.hint("merge"), ["n", "block"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("theirs"))) <= how.radius)
    return near.select("n", "c1", "c2", "i1", "i2").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, how: Match = Match()) -> DataFrame:
    """doc_id, item_id, similarity of every document and benchmark item that match; equal rows each have theirs.

    Texts without words match nothing, nor do items without words. Repeated items with one item_id count
    once. Rows with a null doc_id are listed under null, items with a null item_id as one item without a name.
    """
    found = materialise(leaks(docs, benchmark, how), "leaks")
    k1, k2 = content_key(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select("doc_id", k1, k2).withColumn("__sw_mix", F.monotonically_increasing_id())
    return salted_join(keyed, found, ["__sw_k1", "__sw_k2"], "__sw_mix").select("doc_id", "item_id", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, how: Match = Match()) -> DataFrame:
    """The rows of docs whose text matches no item, with their columns; null texts stay."""
    found = materialise(leaks(docs, benchmark, how).select("__sw_k1", "__sw_k2").distinct(), "leaks")
    k1, k2 = content_key(F.coalesce(F.col("text"), F.lit("")))
    # a broadcast where the keys' stored size allows
    return docs.withColumns({"__sw_k1": k1, "__sw_k2": k2}).join(found, ["__sw_k1", "__sw_k2"], "left_anti").select(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
