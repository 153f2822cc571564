"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood
is the sum over all ways to cut it into pieces, which a forward pass adds up without listing them;
a text's is the product over its words. The probabilities come from expectation-maximisation on a
bounded sample of labelled documents: about ``SAMPLE_DOCS`` per language, taken by a hash of doc_id.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.llm.shared import arrow_map, give_back, held_out, materialise, split_words, text_slices

SAMPLE_DOCS = 300
EM_ROUNDS = 3
#: Keeps products of piece probabilities within a double for words up to BLOCK pieces long.
SCALE = 64.0
BLOCK = 96
#: Scaled sums below this are made anew from logarithms, long before a double loses bits.
FAINT = 1e-250
UNKNOWN = 0
FLOOR = 1e-7
CACHED_WORDS = 150_000
UNDETERMINED = "und"


def vocabulary(model_file: str) -> list[str]:
    """The pieces of a sentencepiece model that stand for text; entry 0 stands for any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i))
    return ["\0", *dict.fromkeys(p for p in pieces if "▁" not in p[1:])]


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters and marks of each text, and where each text's runs begin."""
    return split_words(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " "))


class Lattice:
    """All ways to cut words into pieces, as edges sorted by where they end."""

    def __init__(self, words: list[str], index: dict[str, int]):
        row, end, size, piece = array("i"), array("i"), array("i"), array("i")
        for r, word in enumerate(words):
            word = "▁" + word
            n = len(word)
            for s in range(n):
                alone = True
                for e in range(s + 1, n + 1):
                    p = index.get(word[s:e])
                    if p is None:
                        break
                    if p >= 0:
                        row.append(r), end.append(e), size.append(e - s), piece.append(p)
                        alone = alone and e > s + 1
                if alone:
                    row.append(r), end.append(s + 1), size.append(1), piece.append(UNKNOWN)
        self.lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        row, end, size, piece = (np.frombuffer(x, np.int32).astype(np.int64) for x in (row, end, size, piece))
        order = np.lexsort((size, end))
        self.row, self.end, self.size, self.piece = row[order], end[order], size[order], piece[order]
        self._cut()

    def _cut(self) -> None:
        key = self.end * (1 << 20) + self.size
        cuts = np.flatnonzero(np.diff(key)) + 1
        self.steps = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True)) if len(key) else []

    def only(self, chosen: np.ndarray) -> Lattice:
        """The lattice of the chosen words."""
        part, kept = copy(self), chosen[self.row]
        part.lengths, part.row = self.lengths[chosen], (np.cumsum(chosen) - 1)[self.row[kept]]
        part.end, part.size, part.piece = self.end[kept], self.size[kept], self.piece[kept]
        part._cut()
        return part

    def faint(self, sums: np.ndarray) -> np.ndarray:
        """The words with a scaled sum, at any position and in any language, too small to be trusted."""
        inside = np.arange(sums.shape[1]) <= self.lengths[:, None]
        return ((sums < FAINT).any(axis=2) & inside).any(axis=1)

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Scaled sums over the segmentations of each prefix: word x position x language."""
        alpha = np.zeros((len(self.lengths), int(self.lengths.max(initial=0)) + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for a, b in self.steps:  # a word has one edge of a given end and size at most
            e, n, r = int(self.end[a]), int(self.size[a]), self.row[a:b]
            alpha[r, e] += alpha[r, e - n] * (prob[self.piece[a:b]] * SCALE**n)
        return alpha

    def backward(self, prob: np.ndarray) -> np.ndarray:
        beta = np.zeros((len(self.lengths), int(self.lengths.max(initial=0)) + 1, prob.shape[1]))
        beta[np.arange(len(self.lengths)), self.lengths] = 1
        for a, b in reversed(self.steps):
            e, n, r = int(self.end[a]), int(self.size[a]), self.row[a:b]
            beta[r, e - n] += beta[r, e] * (prob[self.piece[a:b]] * SCALE**n)
        return beta

    def log_forward(self, prob: np.ndarray) -> np.ndarray:
        """Logarithms of the sums of forward, without SCALE; slower, and never too small to hold."""
        logs = np.log(prob)
        alpha = np.full((len(self.lengths), int(self.lengths.max(initial=0)) + 1, prob.shape[1]), -np.inf)
        alpha[:, 0] = 0
        for a, b in self.steps:
            e, n, r = int(self.end[a]), int(self.size[a]), self.row[a:b]
            alpha[r, e] = np.logaddexp(alpha[r, e], alpha[r, e - n] + logs[self.piece[a:b]])
        return alpha

    def log_backward(self, prob: np.ndarray) -> np.ndarray:
        logs = np.log(prob)
        beta = np.full((len(self.lengths), int(self.lengths.max(initial=0)) + 1, prob.shape[1]), -np.inf)
        beta[np.arange(len(self.lengths)), self.lengths] = 0
        for a, b in reversed(self.steps):
            e, n, r = int(self.end[a]), int(self.size[a]), self.row[a:b]
            beta[r, e - n] = np.logaddexp(beta[r, e - n], beta[r, e] + logs[self.piece[a:b]])
        return beta

    def log_likelihood(self, prob: np.ndarray) -> np.ndarray:
        alpha = self.forward(prob)
        faint = self.faint(alpha)
        total = alpha[np.arange(len(self.lengths)), self.lengths]
        total[faint] = 1
        out = np.log(total) - (self.lengths * np.log(SCALE))[:, None]
        if faint.any():
            part = self.only(faint)
            out[faint] = part.log_forward(prob)[np.arange(len(part.lengths)), part.lengths]
        return out

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each language's words, seen ``counts`` times, use each piece."""
        alpha, beta = self.forward(prob), self.backward(prob)
        faint = self.faint(alpha) | self.faint(beta)
        if faint.any():
            clear = self.only(~faint).expected(prob, counts[~faint]) if not faint.all() else 0
            return clear + self.only(faint)._expected_faint(prob, counts[faint])
        total = alpha[np.arange(len(self.lengths)), self.lengths]
        share = alpha[self.row, self.end - self.size] * prob[self.piece] * (SCALE**self.size)[:, None] * beta[self.row, self.end]
        share *= (counts / total)[self.row]
        return self._by_piece(share, len(prob))

    def _expected_faint(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        alpha, beta = self.log_forward(prob), self.log_backward(prob)
        total = alpha[np.arange(len(self.lengths)), self.lengths]
        share = np.exp(alpha[self.row, self.end - self.size] + np.log(prob)[self.piece] + beta[self.row, self.end] - total[self.row])
        return self._by_piece(share * counts[self.row], len(prob))

    def _by_piece(self, share: np.ndarray, pieces: int) -> np.ndarray:
        return np.stack([np.bincount(self.piece, share[:, k], pieces) for k in range(share.shape[1])], axis=1)


def long_word_likelihood(word: str, index: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """The same sum for a word of any length, scaled anew at each position."""
    word = "▁" + word
    longest = max(map(len, index))
    alpha, log_scale = {0: np.ones(prob.shape[1])}, np.zeros(prob.shape[1])
    for e in range(1, len(word) + 1):
        here = np.zeros(prob.shape[1])
        for s in range(max(0, e - longest), e):
            p = index.get(word[s:e], -1)
            if p >= 0:
                here += alpha[s] * prob[p]
            elif s == e - 1:
                here += alpha[s] * prob[UNKNOWN]
        alpha[e] = here
        alpha.pop(e - longest, None)
        log_scale += np.log(here)
        alpha = {k: v / here for k, v in alpha.items()}
    return log_scale


@dataclass
class UnigramModel:
    """Languages in order, the pieces, and a probability per piece and language."""

    languages: list[str]
    pieces: list[str]
    prob: np.ndarray
    _index: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.languages, self.pieces, self.prob

    def __setstate__(self, state):
        self.languages, self.pieces, self.prob = state
        self._index = {}

    @property
    def index(self) -> dict[str, int]:
        """Pieces by text; -1 marks texts that only begin a piece."""
        if not self._index:
            for p in self.pieces[1:]:
                for k in range(1, len(p)):
                    self._index.setdefault(p[:k], -1)
            self._index.update((p, i) for i, p in enumerate(self.pieces) if i)
        return self._index

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 16), (16, BLOCK)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in np.array_split(rows, max(1, len(rows) // 8192)):
                if len(part):
                    out[part] = Lattice([words[i] for i in part], self.index).log_likelihood(self.prob)
        for i in np.flatnonzero(lengths > BLOCK):
            out[i] = long_word_likelihood(words[i], self.index, self.prob)
        return out


def fit(words: list[str], counts: np.ndarray, languages: list[str], pieces: list[str], rounds: int = EM_ROUNDS) -> UnigramModel:
    """Expectation-maximisation over all segmentations; counts is word x language."""
    model = UnigramModel(languages, pieces, np.full((len(pieces), len(languages)), 1 / len(pieces)))
    # a word of more letters than BLOCK is fitted in parts
    cut = [(word[k : k + BLOCK], i) for i, word in enumerate(words) for k in range(0, len(word), BLOCK)]
    parts = np.array_split(np.arange(len(cut)), max(1, len(cut) // 8192))
    lattices = [(Lattice([cut[k][0] for k in part], model.index), counts[[cut[k][1] for k in part]]) for part in parts if len(part)]
    for _ in range(rounds):
        used = sum((x.expected(model.prob, n) for x, n in lattices), np.zeros_like(model.prob)) + 1e-3
        model.prob = np.maximum(used / used.sum(0), FLOOR)
    return model


def train(docs: DataFrame, model_file: str, sample_docs: int = SAMPLE_DOCS) -> UnigramModel | None:
    """Fits the pieces' probabilities on about sample_docs documents per language outside the held-out fold.

    None if no document has both a language and a text. The driver receives word counts of the sample only.
    """
    own = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # a join, as a table may name any number of languages
    share = F.least(F.lit(1.0), sample_docs / F.count("*")).alias("__sw_share")
    shares = materialise(own.groupBy("lang").agg(share), "shares")
    chosen = own.join(shares, "lang").where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < F.col("__sw_share") * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words, starts = letter_words(batch.column("text"))
            langs = batch.column("lang").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(starts))))
            table = pa.table({"lang": langs, "word": words}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            table = table.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).cast(pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))
            yield from table.to_batches()

    seen = arrow_map(chosen.select("doc_id", "text", "lang"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(seen.column("lang").to_pylist()))
    if not languages:
        return None
    coded = seen.column("word").combine_chunks().dictionary_encode()
    counts = np.zeros((len(coded.dictionary), len(languages)))
    column = {k: i for i, k in enumerate(languages)}
    counts[np.asarray(coded.indices), [column[x] for x in seen.column("lang").to_pylist()]] = seen.column("n").to_numpy()
    model = fit(coded.dictionary.to_pylist(), counts, languages, vocabulary(model_file))
    give_back()  # the driver keeps the model only
    return model


def identify(docs: DataFrame, model: UnigramModel | None) -> DataFrame:
    """Every row of docs (it needs a text column), whole, with lang_pred and score after its columns.

    score is the posterior of lang_pred under equal priors. A text that is null, empty or without a
    letter, or any text without a model, gets ``und`` and 0. Ties go to the first language by name.
    Existing columns lang_pred and score are replaced.
    """
    spark = docs.sparkSession
    base = docs.drop("lang_pred", "score")
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        rows: dict[str, int] = {}
        table = np.zeros((1024, len(model.languages) if model else 1))
        for batch in text_slices(batches):
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if model:
                words, starts = letter_words(batch.column("text"))
                coded = words.dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(rows) > CACHED_WORDS:
                    rows.clear()
                new = [w for w in distinct if w not in rows]
                if new:
                    first = len(rows)
                    rows.update(zip(new, range(first, first + len(new)), strict=True))
                    if len(rows) > len(table):
                        table = np.concatenate((table[:first], np.zeros((2 * len(rows) - first, table.shape[1]))))
                    table[first : len(rows)] = model.word_scores(new)
                ids = np.fromiter((rows[w] for w in distinct), np.int64, len(distinct))
                # each text's own sum: a difference of running sums would depend on the texts before it
                total, filled = np.zeros((batch.num_rows, table.shape[1])), starts[1:] > starts[:-1]
                if filled.any():
                    total[filled] = np.add.reduceat(table[ids[np.asarray(coded.indices)]], starts[:-1][filled], axis=0)
                lettered = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                share = np.exp(total - total.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best = np.where(lettered, share.argmax(axis=1), -1)
                score = np.where(lettered, share.max(axis=1), 0.0)
            named = pa.array([*(model.languages if model else []), UNDETERMINED]).take(pa.array(best % (len(model.languages) + 1 if model else 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, named, pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return arrow_map(base, predict, schema)


def op1_language_id(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """The contract's columns for every document; model_file defaults to the public 32k piece vocabulary."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, model_file)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
