"""What has no built-in: hashed embeddings, simhash, transposition distance, sparse codes, file decoding.

Arrow-batched UDFs. Hashes are 64-bit BLAKE2b, little endian; those of repeated features are computed once
per task.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 512
NGRAM_WEIGHT = 0.3
_TOKEN = re.compile("[a-zа-я0-9]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower().replace("ё", "е"))


class Hashes(dict):
    """64-bit hashes by feature, filled on demand and emptied when too many."""

    MOST = 1_000_000

    def __missing__(self, feature: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[feature] = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
        return value


def simhash_one(text: str | None, hashes: Hashes) -> int:
    words = tokens(text)
    if not words:
        return 0
    values = np.array([hashes[w] for w in words], np.uint64)
    ones = ((values[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
    bits = (2 * ones.astype(np.int64) > len(words)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """64 sign votes over all token occurrences, as a signed long; 0 for a text without tokens."""
    hashes = Hashes()
    return texts.map(lambda t: simhash_one(t, hashes))


def embed_tokens(words: list[str], weights: list[float], hashes: Hashes, size: int = DIMENSIONS) -> np.ndarray:
    """Words by their weights, and character 3- and 4-grams of the line they make, into signed buckets. Not normalised."""
    line = f" {' '.join(words)} "
    features = [*words, *(f"#{line[i : i + n]}#" for n in (3, 4) for i in range(len(line) - n + 1))]
    every = np.concatenate((np.asarray(weights, float), np.full(len(features) - len(words), NGRAM_WEIGHT)))
    return _buckets(np.array([hashes[f] for f in features], np.uint64), every, np.zeros(len(features), np.int64), 1, size)[0]


def _buckets(values: np.ndarray, weights: np.ndarray, row: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Signed sums by row and bucket."""
    sign = np.where((values >> np.uint64(32)) & np.uint64(1) == 1, 1.0, -1.0)
    at = row * size + (values % np.uint64(size)).astype(np.int64)
    return np.bincount(at, sign * weights, rows * size).reshape(rows, size)


class Grams:
    """Character n-grams of many lines at once: each distinct one of a batch is looked up once."""

    def __init__(self, hashes: Hashes):
        self.hashes = hashes

    def __call__(self, lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each n-gram ``#abc#`` of the lines, and the line it stands in."""
        points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.array([len(x) for x in lines], np.int64)
        row = np.repeat(np.arange(len(lines)), lengths)
        if len(points) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        # letters, digits and the space lie below 2 ** 16
        keys = sum((points[inside + i] << np.uint64(16 * i) for i in range(n)), np.zeros(len(inside), np.uint64))
        distinct, which = np.unique(keys, return_inverse=True)
        spelled = distinct.astype("<u8").view("<u2").reshape(-1, 4)[:, :n].astype("<u4").tobytes().decode("utf-32-le")
        found = np.fromiter((self.hashes[f"#{spelled[i : i + n]}#"] for i in range(0, len(spelled), n)), np.uint64, len(distinct))
        return found[which], row[inside]


def embed_lines(words: list[str], codes: np.ndarray, weights: np.ndarray, row: np.ndarray, lines: list[str], hashes: Hashes, size: int = DIMENSIONS) -> np.ndarray:
    """embed_tokens for a batch. words: the distinct ones; codes, weights, row: of each token its word, weight and line."""
    values = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    out = _buckets(values[codes], weights, row, len(lines), size)
    for n in (3, 4):
        found, at = Grams(hashes)(lines, n)
        out += _buckets(found, np.full(len(found), NGRAM_WEIGHT), at, len(lines), size)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x)
    return x / size if size > 0 else x


def osa(a: str, b: str, cutoff: int = 3) -> int:
    """Edit distance with swaps of neighbours, each place edited once; cutoff where it would be more."""
    if abs(len(a) - len(b)) >= cutoff:
        return cutoff
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    table[:, 0], table[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            ways = [table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1])]
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                ways.append(table[i - 2, j - 2] + (a[i - 1] != b[j - 1]))
            table[i, j] = min(ways)
    return min(cutoff, int(table[-1, -1]))


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "koi8-r", "mac-cyrillic", "latin-1")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text by the first encoding that takes them."""

    def one(data: bytes | None) -> str | None:
        for encoding in ENCODINGS if data is not None else ():
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                continue
        return None

    return content.map(one)


def leaves(value, path: str = ""):
    """(path, value) of every leaf of parsed JSON: ``a.b[0]``."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, value


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_leaves(texts: pd.Series) -> pd.Series:
    """``path: value`` of every leaf, white space made single; empty for text that is not JSON."""

    def one(text: str | None) -> list[str]:
        try:
            return [" ".join(f"{p}: {v}".split()) for p, v in leaves(json.loads(text))]
        except (TypeError, ValueError):
            return []

    return texts.map(one)


@F.pandas_udf(T.StringType())
def json_line(texts: pd.Series) -> pd.Series:
    """One JSON value, written anew; null for a line that is blank or not JSON."""

    def one(text: str | None) -> str | None:
        try:
            return " ".join(json.dumps(json.loads(text), ensure_ascii=False).split())
        except (TypeError, ValueError):
            return None

    return texts.map(one)


class SparseCoder:
    """A fixed random projection whose strongest cells, and those close behind, form a text's code."""

    def __init__(self, size: int = DIMENSIONS, cells: int = 2000, share: float = 0.05, soft: float = 0.9, seed: int = 42):
        self.cells, self.active, self.soft = cells, max(1, int(cells * share)), soft
        self.weights = np.random.default_rng(seed).normal(0.0, 1.0 / np.sqrt(size), (size, cells)).astype(np.float32)

    def codes(self, vectors: np.ndarray) -> list[np.ndarray]:
        drive = vectors.astype(np.float32) @ self.weights
        least = -np.partition(-drive, self.active - 1, axis=1)[:, self.active - 1]
        return [np.flatnonzero((d >= t) | (d >= self.soft * t)) for d, t in zip(drive, least, strict=True)]


def projection(size: int = 576, to: int = DIMENSIONS, seed: int = 13) -> np.ndarray:
    """An orthonormal map from image features to the shared vector space; the same for every seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, to)))
    return q * np.sign(np.diag(r))


def half_precision(vectors: np.ndarray) -> np.ndarray:
    """Vectors as they come back from 16-bit storage."""
    return np.asarray(vectors, np.float16).astype(np.float32)
