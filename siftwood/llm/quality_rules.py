"""Quality rules: repetition counts, and divergence of histograms from references of the language.

Each document has a histogram of character classes and one of common words. References are the sums of
these over all documents of a language. A document fails where the Jensen-Shannon distance to its
reference is too large and the text is long enough for the distance to mean something.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm.shared import arrow_map, materialise, split_words, text_slices, word_codes

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in a is that for it was on are as with be by at from this "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les en un du une que est pour qui dans par plus pas au avec sur "
    "el y los del se las por para con no su al lo como más o pero sus"
).split()
WORD_BINS = len(dict.fromkeys(COMMON_WORDS)) + 1
CHAR_CLASSES = ("lower", "upper", "letter", "digit", "space", "stop", "symbol", "other")
STOPS = ".,;:!?'\"-()"
SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    """Largest distances that pass, and the least characters and words for each to be judged."""

    char_distance: float = 0.25
    word_distance: float = 0.36
    min_chars: int = 200
    min_words: int = 100


@lru_cache(maxsize=1)
def char_table() -> np.ndarray:
    """The class of every code point."""
    kinds = {"Ll": 0, "Lu": 1, "Lt": 2, "Lm": 2, "Lo": 2, "Mn": 2, "Mc": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4} | {g: 6 for g in ("Sm", "Sc", "Sk", "So", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po")}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c)), 7) for c in range(0x110000)), np.uint8, 0x110000)
    table[[ord(x) for x in STOPS]], table[[ord(x) for x in SPACE]] = 5, 4
    return table


def char_histograms(texts: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    k = len(CHAR_CLASSES)
    return np.bincount(row * k + char_table()[points], minlength=len(texts) * k).reshape(-1, k)


def word_histograms(code: np.ndarray, distinct: list[bytes], starts: np.ndarray) -> np.ndarray:
    bins = {w: i + 1 for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
    common = np.fromiter((bins.get(w.decode().strip(STOPS).lower(), 0) for w in distinct), np.int64, len(distinct))
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return np.bincount(row * WORD_BINS + common[code], minlength=(len(starts) - 1) * WORD_BINS).reshape(-1, WORD_BINS)


def repeated_words(code: np.ndarray) -> int:
    """Words of one text that lie in a 3-word window found twice or more, first occurrences included."""
    if len(code) < 4:
        return 0
    pairs, last = code[:-2] * (int(code.max()) + 1) + code[1:-1], code[2:]
    if code.max() >= 1 << 21:  # else three numbers fit into one
        pairs, last = (np.unique(x, return_inverse=True)[1].astype(np.int64) for x in (pairs, last))
    windows = pairs * (int(last.max()) + 1) + last
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(code), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<int>, words array<int>"


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, and per text the counts and both histograms. A null text has no word, character or line."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            words, starts = split_words(texts)
            code, distinct = word_codes(words)
            upto = np.concatenate(([0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))))
            plain = texts.to_pylist()
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.int32).ravel()))
            columns = {
                "doc_id": batch.column("doc_id"),
                "lang": batch.column("lang"),
                "n_words": pa.array(np.diff(starts)),
                "word_chars": pa.array(upto[starts[1:]] - upto[starts[:-1]]),
                "n_symbols": pc.count_substring_regex(texts, r"[#*$%&|<>]").cast(pa.int64()),
                "n_dup_lines": pa.array([duplicate_lines(t) for t in plain], pa.int64()),
                "n_repeat_words": pa.array([repeated_words(code[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.int64()),
                "chars": lists(char_histograms(plain)),
                "words": lists(word_histograms(code, distinct, starts)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    return arrow_map(rows, count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, {MEASURES}")


def references(measured: DataFrame) -> DataFrame:
    """lang, ref_chars, ref_words: summed histograms of every language, however rare."""
    both = measured.where(F.col("lang").isNotNull()).select("lang", F.posexplode(F.concat("chars", "words")).alias("bin", "n"))
    bins = both.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    sums = bins.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("sums"))
    k = len(CHAR_CLASSES)
    return sums.select("lang", F.slice("sums", 1, k).alias("ref_chars"), F.slice("sums", k + 1, WORD_BINS).alias("ref_words"))


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances, 0 to 1, of rows of counts to the rows of reference; 0 for an empty row."""
    share = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1)
    p, q = share(counts.astype(float)), share(reference.astype(float))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)
        gap = np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))
    return np.where((counts.sum(axis=1) > 0) & (reference.sum(axis=1) > 0), gap, 0.0)


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): counts, base_failed, kept, char_distance, word_distance.

    References cover all rows, one a language. A null language is held against every language, and the
    smallest distance of each kind counts; without any language there is none to diverge from. A null or
    empty text has no words and so fails the base rules. Repeated rows are judged each.
    """
    measured = materialise(measure(docs), "measures")
    found = materialise(references(measured), "references")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c, w, rc, rw = (np.asarray(batch.column(k).flatten()).reshape(batch.num_rows, -1) for k in ("chars", "words", "ref_chars", "ref_words"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "doc_id", *counts)), pa.array(c.sum(axis=1)), pa.array(distances(c, rc)), pa.array(distances(w, rw))], ["row", "doc_id", *counts, "n", "char_distance", "word_distance"])

    kind = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in counts)}, n long, char_distance double, word_distance double"
    none = lambda k: F.array_repeat(F.lit(0).cast("long"), k)
    refs = [F.coalesce("ref_chars", none(len(CHAR_CLASSES))).alias("ref_chars"), F.coalesce("ref_words", none(WORD_BINS)).alias("ref_words")]
    with_refs = lambda rows: arrow_map(rows.select("row", "doc_id", *counts, "chars", "words", *refs), compare, kind)
    named = measured.where(F.col("lang").isNotNull()).withColumn("row", F.lit(0).cast("long")).join(found, "lang", "left")
    unnamed = measured.where(F.col("lang").isNull()).withColumn("row", F.monotonically_increasing_id()).join(found.drop("lang"), F.lit(True), "left")
    least = with_refs(unnamed).groupBy("row", "doc_id", *counts, "n").agg(F.min("char_distance").alias("char_distance"), F.min("word_distance").alias("word_distance"))
    compared = with_refs(named).unionByName(least)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    diverges = ((F.col("n") >= limits.min_chars) & (F.col("char_distance") > limits.char_distance)) | ((F.col("n_words") >= limits.min_words) & (F.col("word_distance") > limits.word_distance))
    return compared.select("doc_id", *counts, failed.alias("base_failed"), (~failed & ~diverges).alias("kept"), "char_distance", "word_distance")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def _op8_sql(limits: Limits = Limits()) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    # each class as RE2 has it, after those that come first
    stops, spaces = r".,;:!?'\"\-()", r"\x20\x09-\x0D\p{Zs}"
    plain = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "letter": r"\p{Lt}\p{Lm}\p{Lo}\p{Mn}\p{Mc}", "digit": r"\p{N}", "space": spaces, "stop": stops}
    kept = lambda chars, not_in="": f"length(regexp_replace(t, {quoted(f'[^{chars}]' if not not_in else f'[^{chars}]|[{not_in}]')}, '', 'g'))"
    counted = [kept(plain[c]) for c in CHAR_CLASSES[:6]] + [kept(r"\p{S}\p{P}", stops)]
    rows = "\n  UNION ALL ".join(f"SELECT doc_id, lang, 'c' AS kind, {i} AS bin, CAST({x} AS BIGINT) AS k FROM d" for i, x in enumerate([*counted, f"length(t) - ({' + '.join(counted)})"]))
    bins = ", ".join(f"({quoted(w)}, {i + 1})" for i, w in enumerate(dict.fromkeys(COMMON_WORDS)))
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
x AS MATERIALIZED (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS x FROM d),
w AS MATERIALIZED (SELECT doc_id, lang, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM x),
tri AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + s) AS n FROM again, (SELECT unnest([0, 1, 2]) AS s) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT x.doc_id, x.lang, CAST(len(x) AS BIGINT) AS n_words, CAST(length(array_to_string(x, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, length(t) AS n
  FROM x LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
common AS (SELECT * FROM (VALUES {bins}) AS v(w, bin)),
wb AS (SELECT doc_id, lang, coalesce(bin, 0) AS bin, count(*) AS k FROM (SELECT doc_id, lang, lower(trim(w, {quoted(STOPS)})) AS w FROM w) LEFT JOIN common USING (w) GROUP BY ALL),
hist AS MATERIALIZED ({rows}
  UNION ALL SELECT doc_id, lang, 'w' AS kind, bin, k FROM wb),
totals AS (SELECT doc_id, kind, sum(k) AS total FROM hist GROUP BY ALL),
refs AS MATERIALIZED (SELECT lang AS ref, kind, bin, sum(k) AS k, sum(sum(k)) OVER (PARTITION BY lang, kind) AS total FROM hist WHERE lang IS NOT NULL GROUP BY lang, kind, bin),
pairs AS (SELECT t.doc_id, t.kind, r.ref, r.bin, coalesce(h.k, 0) / CAST(t.total AS DOUBLE) AS p, r.k / CAST(r.total AS DOUBLE) AS q
  FROM totals t JOIN d USING (doc_id) JOIN refs r ON r.kind = t.kind AND r.total > 0 AND (d.lang IS NULL OR r.ref = d.lang)
  LEFT JOIN hist h ON h.doc_id = t.doc_id AND h.kind = t.kind AND h.bin = r.bin WHERE t.total > 0),
lone AS (SELECT h.doc_id, h.kind, r.ref, sum(h.k / CAST(t.total AS DOUBLE)) AS rest FROM hist h JOIN totals t USING (doc_id, kind) JOIN d USING (doc_id)
  JOIN (SELECT DISTINCT ref, kind FROM refs WHERE total > 0) r ON r.kind = h.kind AND (d.lang IS NULL OR r.ref = d.lang)
  WHERE t.total > 0 AND NOT EXISTS (SELECT 1 FROM refs x WHERE x.ref = r.ref AND x.kind = h.kind AND x.bin = h.bin) GROUP BY ALL),
far AS (SELECT doc_id, kind, ref, sqrt(greatest(0, least(1, (sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)
  + coalesce(any_value(lone.rest), 0)) / 2))) AS gap FROM pairs LEFT JOIN lone USING (doc_id, kind, ref) GROUP BY doc_id, kind, ref),
near AS (SELECT doc_id, min(gap) FILTER (WHERE kind = 'c') AS c, min(gap) FILTER (WHERE kind = 'w') AS w FROM far GROUP BY doc_id),
judged AS (SELECT b.*, coalesce(c, 0) AS c, coalesce(w, 0) AS w, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed FROM base b LEFT JOIN near USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
  NOT failed AND NOT ((n >= {limits.min_chars} AND c > {limits.char_distance}) OR (n_words >= {limits.min_words} AND w > {limits.word_distance})) AS kept,
  round(c, 6) AS char_distance, round(w, 6) AS word_distance FROM judged
"""


OP8_SQL = _op8_sql()
