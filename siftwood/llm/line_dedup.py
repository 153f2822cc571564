"""Line deduplication through sharded minimal perfect hashes.

A first pass counts documents per distinct line hash. The hashes of lines in two documents or more go to
shards; one task per shard builds a minimal perfect hash and, in its order, arrays of fingerprints, document
counts and the document that keeps the line. The counts decide: the index serves any threshold. The line
hashes of many documents go to the shards in common packets, so the work follows the lines, however many
shards there are, and probe the arrays; only the positions of lines to drop come back. Lines themselves
are never shuffled, and no shard is ever on the driver.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm.shared import arrow_map, content_key, materialise, mix, text_slices

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 32_768
#: Lines of one packet at most, and of the packets that a task hands on at once.
PACKET_LINES, SENT_LINES = 512, 1 << 16
BLANK = " \t\n\x0b\x0c\r"


class PerfectHash:
    """Levels of bit arrays: a key sits at the first level where no other key shares its bit; its rank is its number."""

    GAMMA = 2

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits).astype(np.int64))))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        sizes, parts, level = [], [], 0
        while len(keys):
            size = 64 * (1 + cls.GAMMA * len(keys) // 64)
            at = cls._place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys, level = keys[~alone[at]], level + 1
        return cls(np.array(sizes, np.int64), np.concatenate([*parts, np.zeros(0, np.uint64)]))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1 where no level has a bit. Keys that were not built in may get any number."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self.base[level] + self._place(keys[left], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left = left[~hit]
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, count: np.ndarray, keeper: np.ndarray, nobody: np.ndarray) -> bytes:
    """One shard's arrays as bytes. nobody: keys whose documents all lack an id, so no line of theirs goes."""
    index = PerfectHash.build(h1.view(np.uint64))
    at = index.find(h1.view(np.uint64))
    order = np.empty(len(at), np.int64)
    order[at] = np.arange(len(at))
    out = io.BytesIO()
    np.savez(out, sizes=index.sizes, bits=index.bits, print=h2[order], count=np.minimum(count[order], 2**32 - 1).astype(np.uint32), keeper=keeper[order], nobody=nobody[order])
    return out.getvalue()


class Shard:
    def __init__(self, packed: bytes):
        arrays = np.load(io.BytesIO(packed))
        self.index = PerfectHash(arrays["sizes"], arrays["bits"])
        self.print, self.count, self.keeper, self.nobody = (arrays[k] for k in ("print", "count", "keeper", "nobody"))

    def drops(self, h1: np.ndarray, h2: np.ndarray, doc_id: np.ndarray, has_id: np.ndarray, min_docs: int) -> np.ndarray:
        """Which line hashes lose their lines; doc_id, has_id: of each one's document."""
        at = self.index.find(h1.view(np.uint64))
        known = (at >= 0) & (self.print[at] == h2) & (self.count[at] >= min_docs) & ~self.nobody[at]
        return known & ~(has_id & (self.keeper[at] == doc_id))


def line_hashes(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines whose key is long enough, in order: their texts' numbers, their own, and 128-bit hashes of the keys as an n x 2 array."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = np.asarray(lists.offsets, np.int64)
    offsets = offsets - offsets[0]
    keys = pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=BLANK))
    lengthy = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)
    wanted = np.flatnonzero(lengthy)
    digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys.filter(pa.array(lengthy)).cast(pa.binary()).to_pylist())
    rows = np.searchsorted(offsets, wanted, "right") - 1
    return rows, wanted - offsets[rows], np.frombuffer(digests, np.int64).reshape(-1, 2)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of the columns differs from the one before; the first always does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, n, keeper: how many documents hold each line key and the largest doc_id among them."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows, _, hashes = line_hashes(batch.column("text"), min_chars)
            h1, h2 = hashes[:, 0], hashes[:, 1]
            order = np.lexsort((h2, h1, rows))
            once = order[changes(rows[order], h1[order], h2[order])]  # a document counts once, however often it has the line
            yield pa.RecordBatch.from_arrays([pa.array(h1[once]), pa.array(h2[once]), batch.column("doc_id").take(pa.array(rows[once]))], ["h1", "h2", "doc_id"])

    found = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keys, "h1 long, h2 long, doc_id long")
    return found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Every row of docs (doc_id, text, anything else) with its text cut, and n_lines and n_dropped (long).

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of min_chars code
    points or more that min_docs rows or more hold lose all their lines except in the largest doc_id.
    Rows that share a doc_id count each by itself and the largest doc_id keeps its lines in all of its
    rows; a null doc_id is below all others, and lines held only by such rows stay. A null or empty
    text is one empty line; a null text stays null. Columns n_lines and n_dropped are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    repeated = materialise(line_counts(docs, min_chars).where(F.col("n") >= min(2, min_docs)), "lines")
    shards = max(1, -(-repeated.count() // shard_keys))
    repeated = repeated.withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a shard gets packets in proportion to the documents that hold its keys; salts split them evenly
    weight = np.zeros(shards)
    for r in repeated.groupBy("shard").agg(F.sum("n").alias("w")).collect():  # one row per shard
        weight[r["shard"]] = r["w"]
    salts = np.maximum(1, np.ceil(4 * width * np.maximum(weight / max(1.0, weight.sum()), 1 / shards))).astype(np.int64)

    # a keeper may be null, which pandas would turn into an inexact double
    exact = repeated.select("shard", "h1", "h2", "n", F.coalesce("keeper", F.lit(0)).alias("keeper"), F.col("keeper").isNull().alias("nobody"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = pack_shard(*(pdf[k].to_numpy() for k in ("h1", "h2", "n", "keeper", "nobody")))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "packed": [packed]})

    blobs = materialise(exact.groupBy("shard").applyInPandas(build, "shard int, packed binary"), "shards")
    salted = spark.createDataFrame([(i, int(n)) for i, n in enumerate(salts)], "shard int, salts int")
    blobs = blobs.join(F.broadcast(salted), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "packed")

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows, lines, hashes = line_hashes(batch.column("text"), min_chars)
            if not len(rows):
                continue
            k1, k2, ids = (pc.fill_null(batch.column(k), 0).to_numpy() for k in ("k1", "k2", "doc_id"))
            has_id = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            shard = np.mod(hashes[:, 1], shards)
            order = np.argsort(shard, kind="stable")
            begins = np.flatnonzero(changes(shard[order])).tolist()
            parts = [order[i : min(i + PACKET_LINES, end)] for begin, end in zip(begins, [*begins[1:], len(order)], strict=True) for i in range(begin, end, PACKET_LINES)]
            out: list[tuple] = []
            held = 0
            for part in parts:
                of, s = rows[part], int(shard[part[0]])
                # the salt hangs on what the packet holds, so that a task that runs again sends it to the same place
                salt = int(k1[of[0]] ^ hashes[part[0], 0]) % int(salts[s])
                out.append((s, salt, 1, np.stack([k1[of], k2[of], ids[of], has_id[of], lines[part], hashes[part, 0], hashes[part, 1]]).tobytes()))
                held += len(part)
                if held >= SENT_LINES:
                    yield packet_rows(out)
                    out, held = [], 0
            if out:
                yield packet_rows(out)

    keyed = docs.select(*(c.alias(n) for c, n in zip(content_key(F.col("doc_id"), F.col("text")), ("k1", "k2"), strict=True)), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = arrow_map(keyed, packets, "shard int, salt int, kind int, packed binary")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, met = None, []
        for batch in batches:
            for kind, packed in zip(batch.column("kind").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if kind == 0:
                    yield from found(shard, met)
                    shard, met = Shard(packed), []
                else:
                    met.append(np.frombuffer(packed, np.int64).reshape(7, -1))
            yield from found(shard, met)
            met = []

    def found(shard: Shard | None, met: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if shard is None or not met:
            return
        k1, k2, ids, has_id, lines, h1, h2 = np.concatenate(met, axis=1)
        gone = np.flatnonzero(shard.drops(h1, h2, ids, has_id != 0, min_docs))
        if len(gone):
            gone = gone[np.lexsort((k2[gone], k1[gone]))]
            begins = np.flatnonzero(changes(k1[gone], k2[gone]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(gone)).astype(np.int32)), pa.array(lines[gone]))
            yield pa.RecordBatch.from_arrays([pa.array(k1[gone][begins]), pa.array(k2[gone][begins]), lists], ["k1", "k2", "gone"])

    # a shard's blob comes before its packets; a shard without keys has no blob, and whatever it meets instead knows none of its hashes
    probed = sent.unionByName(blobs).repartition(width, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    gone = arrow_map(probed, probe, "k1 long, k2 long, gone array<long>").groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("__sw_gone"))

    k1, k2 = content_key(F.col("doc_id"), F.col("text"))
    joined = docs.withColumns({"__sw_k1": k1, "__sw_k2": k2}).join(gone.withColumnsRenamed({"k1": "__sw_k1", "k2": "__sw_k2"}), ["__sw_k1", "__sw_k2"], "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__sw_gone"), i.cast("long"))), "\n")
    text = F.when(F.col("__sw_gone").isNull(), F.col("text")).otherwise(left)
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("__sw_gone"), F.lit(0)).cast("long").alias("n_dropped"))


PACKET = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary())])


def packet_rows(packets: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*packets, strict=True), PACKET.types, strict=True)], schema=PACKET)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT a.doc_id, a.pos, a.line, (r.k IS NOT NULL AND r.keeper <> a.doc_id) AS gone
  FROM keyed a LEFT JOIN repeated r ON a.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
