"""What the training-data operators have in common: scratch tables, word splitting, shingles.

Names that start with ``__sw_`` are reserved for columns the operators add while they work.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.scratch import fresh_path, materialise  # noqa: F401  the operators take them from here

#: The white space that separates words: space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
#: Bytes of one batch that Spark hands to Python.
ARROW_BYTES = 8 << 20
#: Parts that the rows of one key are dealt to in a salted join.
SALTS = 8
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that models never learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def content_key(*parts: Column) -> list[Column]:
    """128 bits in two longs that identify the given values; never null."""
    return [F.xxhash64(*parts).alias("__sw_k1"), F.xxhash64(F.lit(7), *parts).alias("__sw_k2")]


def salted_join(rows: DataFrame, facts: DataFrame, key: str | list[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with facts (one row per key), where a key may hold most of the rows: facts are repeated per salt.

    by: the column of rows that spreads them. Sorted, so that many small joins build no tables on the driver.
    """
    keys = [key] if isinstance(key, str) else key
    many = facts.withColumn("__sw_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = rows.withColumn("__sw_salt", F.pmod(F.xxhash64(F.col(by), F.lit("salt")), F.lit(salts)).cast("int"))
    return own.join(many.hint("merge"), [*keys, "__sw_salt"], how).drop("__sw_salt")


def give_back() -> None:
    """Returns a task's freed memory to the system: Python workers outlive their tasks and add up with others' on an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of ARROW_BYTES, so that what lies between the JVM and Python stays small whatever the rows' size."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(key, str(ARROW_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and where each text's words begin (one entry more than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    real = pc.greater(pc.binary_length(flat), 0)
    mask = real.to_numpy(zero_copy_only=False)
    if not mask.all():
        offsets = np.concatenate(([0], np.cumsum(mask)))[offsets]
        flat = flat.filter(real)
    return flat, offsets


def word_codes(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Each word's position in the list of distinct words, and that list."""
    coded = words.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit hashes of five successive words, A-Z lower-cased.

    A text of one to four words has one shingle, its whole sequence; without words the set is empty.
    """
    words, starts = split_words(pc.ascii_lower(texts))
    code, distinct = word_codes(words)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[code]
    rolled = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        rolled = rolled * _BASE + hashes[i : i + len(rolled)]
    rolled = mix(rolled)
    out = []
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if end - begin >= SHINGLE:
            out.append(np.unique(rolled[begin : end - SHINGLE + 1]))
        elif end > begin:
            whole = np.uint64(end - begin)
            with np.errstate(over="ignore"):
                for h in hashes[begin:end]:
                    whole = whole * _BASE + h
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
