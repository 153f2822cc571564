"""Byte-level BPE over overlapping chunks, and its inverse.

A text is cut into chunks that reach into their successors. Each chunk is pre-tokenised from its own start;
where the boundaries of two neighbours first agree inside their overlap, both follow the true segmentation
from there on, and the pre-tokens up to that place are encoded. Where they don't agree (one pre-token spans the
overlap) the first chunk is taken twice as long. Chunks of one task follow each other; a long text is cut into
spans of chunks, which are the work of many tasks. A span begins where its predecessor ends, or else the text's
spans are put together again for one task. Decoding concatenates the ids' bytes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.llm.shared import arrow_map, content_key, materialise, salted_join, text_slices

CHUNK = 1_024
OVERLAP = 128
#: Chunks of one span.
SPAN = 64
#: Characters at a cut that may still change the pre-tokens before them: no alternative looks further ahead.
MARGIN = 8
CACHED_PIECES = 300_000


@lru_cache(maxsize=2)
def encoder(ranks_file: str, pattern: str):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


class Pieces(dict):
    """Ids by pre-token; short ones are kept."""

    def __init__(self, ranks_file: str, pattern: str):
        self.merge = encoder(ranks_file, pattern)._encode_single_piece

    def __missing__(self, piece: str) -> list[int]:
        ids = self.merge(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def meeting(own: list[str], end: int, after: list[str], cut: int, limit: int) -> tuple[int, int, int] | None:
    """The first place from cut to limit where pre-tokens of both lists begin or end, with how many of each lie before it.

    own ends at ``end``, after begins at ``cut``.
    """
    seen, place, k = {end: len(own)}, end, len(own)
    while k and place > cut:
        k -= 1
        place -= len(own[k])
        seen[place] = k
    place = cut
    for j, piece in enumerate((*after, "")):
        if place > limit:
            return None
        if place in seen:
            return seen[place], j, place
        place += len(piece)
    return None


def runs(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, final: bool = True) -> Iterator[tuple[int, list[str]]]:
    """Runs of pre-tokens with their places, from chunks that start at multiples of chunk. final: the text ends here."""
    split, n = splitter(pattern).findall, len(text)
    begin, at, width, own = 0, 0, chunk, split(text, 0, min(n, chunk + overlap))
    while begin + width < n:
        cut = begin + width
        end, after = min(n, cut + overlap), split(text, cut, min(n, cut + chunk + overlap))
        met = meeting(own, end, after, cut, end if final and end == n else end - MARGIN)
        if met is None:
            width *= 2
            own = split(text, at, min(n, begin + width + overlap))
            continue
        k, j, place = met
        yield at, own[:k]
        begin, at, width, own = cut, place, chunk, after[j:]
        if place == n:
            return
    yield at, own


def whole_ids(text: str, pieces: Pieces, pattern: str, chunk: int, overlap: int) -> np.ndarray:
    out = array("i")
    for _, run in runs(text, pattern, chunk, overlap):
        out.extend(chain.from_iterable(map(pieces.__getitem__, run)))
    return np.frombuffer(out, np.int32) if out else np.zeros(0, np.int32)


def span_ids(text: str, lead: int, last: bool, pieces: Pieces, pattern: str, chunk: int, overlap: int) -> tuple[int, int, list[int]] | None:
    """Where a span begins and ends in its text, and the ids between; None where a chunk next to it never agrees.

    text: lead characters (one chunk, or none) of the predecessor, the span, and the overlap after it.
    """
    end = len(text) if last else len(text) - overlap
    first, stop, out = None, None, array("i")
    for at, run in runs(text, pattern, chunk, overlap, last):
        if at >= end and not last:
            stop = at
            break
        if at >= lead:
            first = at if first is None else first
            out.extend(chain.from_iterable(map(pieces.__getitem__, run)))
    stop = len(text) if last else stop
    return None if first is None or stop is None or first > lead + overlap else (first - lead, stop - lead, out.tolist())


def _ids(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32)))


def encode(docs: DataFrame, ranks_file: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, span: int = SPAN, back: bool = False) -> DataFrame:
    """Every row of docs with ids (array<int>) in place of text. A null or empty text has no ids. A column ids is replaced.

    The pattern must match all of any text. Texts of any length, and pre-tokens longer than a chunk, take the
    same path. back: decodes as well, see round_trip.
    """
    docs = docs.drop("ids")
    others = [c for c in docs.columns if c != "text"]
    wanted = T.StructType([*(docs.schema[c] for c in others), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    size, reach = F.length("text"), span * chunk
    short = docs.where(size.isNull() | (size <= reach))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(ranks_file, pattern)
        for batch in text_slices(batches):
            if len(pieces) > CACHED_PIECES:
                pieces.clear()
            ids = _ids([whole_ids(t or "", pieces, pattern, chunk, overlap) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), ids], [*others, "ids"])

    # long texts: equal rows are encoded once
    long = docs.where(size > reach).withColumns(dict(zip(("__sw_k1", "__sw_k2"), content_key(F.col("text")), strict=True)))
    texts = long.select("__sw_k1", "__sw_k2", "text").dropDuplicates(["__sw_k1", "__sw_k2"])
    last = F.ceil(F.length("text") / reach).cast("int") - 1
    rows = texts.select("*", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("nr"))
    lead = F.when(F.col("nr") > 0, chunk).otherwise(0)
    upto = F.when(F.col("nr") < F.col("last"), reach + overlap).otherwise(reach)
    rows = rows.select("__sw_k1", "__sw_k2", "nr", "last", F.substring("text", F.col("nr") * reach - lead + 1, lead + upto).alias("text"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "__sw_k1", "__sw_k2", "nr")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(ranks_file, pattern)
        for batch in text_slices(batches):
            if len(pieces) > CACHED_PIECES:
                pieces.clear()
            found = [span_ids(t, chunk if nr else 0, nr == end, pieces, pattern, chunk, overlap) for nr, end, t in zip(*(batch.column(c).to_pylist() for c in ("nr", "last", "text")), strict=True)]
            first, stop, ids = ([None if x is None else x[i] for x in found] for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("__sw_k1"), batch.column("__sw_k2"), batch.column("nr"), pa.array(first, pa.int64()), pa.array(stop, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["__sw_k1", "__sw_k2", "nr", "first", "stop", "ids"])

    done = arrow_map(rows, spans, "__sw_k1 long, __sw_k2 long, nr int, first long, stop long, ids array<int>")
    met = done.groupBy("__sw_k1", "__sw_k2").agg(F.sort_array(F.collect_list(F.struct("nr", "first", "stop", "ids"))).alias("parts"))
    # each span must begin where the one before it ends
    pairs = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts")), lambda a, b: F.coalesce(a["stop"] == b["first"] + reach, F.lit(False)))
    whole_parts = ~F.exists("parts", lambda p: p["ids"].isNull()) & F.forall(pairs, lambda x: x)
    met = materialise(met.select("__sw_k1", "__sw_k2", F.when(whole_parts, F.flatten(F.transform("parts", lambda p: p["ids"]))).alias("ids")), "stitched")
    stitched = salted_join(long.withColumn("__sw_mix", F.monotonically_increasing_id()), met, ["__sw_k1", "__sw_k2"], "__sw_mix")
    apart = stitched.where(F.col("ids").isNull()).select(*docs.columns)
    joined = stitched.where(F.col("ids").isNotNull()).select(*others, "ids")
    if not back:
        return arrow_map(short, whole, wanted).unionByName(joined).unionByName(arrow_map(apart, whole, wanted))
    both = lambda batches: decoded(whole(batches), ranks_file, pattern)
    return arrow_map(short, both, with_bytes(wanted)).unionByName(decode(joined, ranks_file, pattern)).unionByName(arrow_map(apart, both, with_bytes(wanted)))


def decoded(batches: Iterator[pa.RecordBatch], ranks_file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches with ids, with bytes after their columns: the concatenated bytes of the ids."""
    enc = encoder(ranks_file, pattern)
    for batch in batches:
        # few rows at a time: a Python list of ids takes many times their bytes
        for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
            data = pa.array([enc.decode_bytes(x or []) for x in part.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, data], [*part.schema.names, "bytes"])


def with_bytes(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bytes", T.BinaryType())])


def decode(rows: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Every row with bytes (binary) beside ids: the concatenated bytes of its ids; null ids give no bytes."""
    base = rows.drop("bytes")
    return arrow_map(base, lambda batches: decoded(batches, ranks_file, pattern), with_bytes(base.schema))


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, span: int = SPAN) -> DataFrame:
    """decode(encode(docs)), the two in one Python worker where a text is one span."""
    return encode(docs.drop("bytes"), ranks_file, pattern, chunk, overlap, span, back=True)


def public_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_files()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(round_trip(docs, ranks, pattern)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def digests(decoded: DataFrame) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to rows with ids and bytes."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(joined, 256), "decoded_sha256": F.sha2("bytes", 256)})
