"""A compression classifier: Zstandard dictionaries of good and of bad text.

A text is cut into windows, and each is compressed by itself with either dictionary, so that the dictionary
counts throughout and not only until the text explains itself. The difference of the two summed sizes over the
text's own size says which of the two it resembles; a logistic curve over that difference turns it into a
probability. Dictionaries come from one half of a bounded sample of labelled documents outside the held-out
fold, the curve from the other half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.llm.shared import arrow_map, held_out, text_slices

#: Labelled documents per class that the sample holds, about.
SAMPLE_DOCS = 1200
DICTIONARY_BYTES = 112_640
#: Bytes of a window, about, and what a text's size counts more, as a few bytes say nothing about a short text.
WINDOW = 512
SHORT = 64
#: Bytes of a training piece, and the pieces that a text gives at most, spread over all of it.
PIECE = 4096
PIECES = 8
LEVEL = 3
THRESHOLD = 0.7
PRIOR = 0.5


def spread(text: bytes) -> list[bytes]:
    """Pieces of a text from its beginning to its end: one long text must not fill a dictionary."""
    count = max(1, -(-len(text) // PIECE))
    chosen = range(count) if count <= PIECES else (i * (count - 1) // (PIECES - 1) for i in range(PIECES))
    return [text[i * PIECE : (i + 1) * PIECE] for i in chosen]


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on the texts; their plain bytes where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, [p for t in texts for p in spread(t)]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    scale: float
    weights: np.ndarray

    def compressors(self):
        import zstandard

        out = []
        for d in (self.good, self.bad):
            trained = zstandard.ZstdCompressionDict(d)
            trained.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def windows(text: bytes) -> list[bytes]:
    """A text in even parts of about WINDOW bytes; an empty one is one window."""
    count = max(1, round(len(text) / WINDOW))
    cuts = [len(text) * i // count for i in range(count + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def differences(texts: list[bytes], compressors) -> np.ndarray:
    """Bytes that the bad dictionary needs more than the good one, over the text's size."""
    good, bad = compressors
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        parts = windows(text)
        out[i] = (sum(len(bad.compress(p)) for p in parts) - sum(len(good.compress(p)) for p in parts)) / (len(text) + SHORT)
    return out


def features(difference: np.ndarray, scale: float) -> np.ndarray:
    """A cubic curve in the difference, which is held within five times its usual size."""
    d = np.clip(difference / scale, -5, 5)
    return np.stack([np.ones(len(d)), d, d**2, d**3], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Newton steps to the ridge logistic fit, each halved until the loss falls."""
    sign, w = 2 * y - 1, np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, -sign * (x @ w)).sum() + ridge * (w @ w) / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move, now = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w), loss(w)
        while (after := loss(w - move)) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        if not after < now:
            break
        w = w - move
    return w


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> CompressionModel | None:
    """None if either class has no labelled text outside the held-out fold. The driver gets the sample only."""
    own = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).dropDuplicates()
    sizes = {r[0]: r[1] for r in own.groupBy("quality").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    limit = F.when(F.col("quality") == 1, min(1.0, sample_docs / sizes[1])).otherwise(min(1.0, sample_docs / sizes[0]))
    hashed = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30))
    chosen = own.where(hashed < limit * (1 << 30)).withColumn("fit", hashed % 2 == 0)
    # chosen has about 2 x sample_docs rows of a few bytes whatever the input; a text comes to the driver as its pieces
    pieces = F.udf(lambda text: spread_text(text), "array<binary>")
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    fit = rows.where("fit").select("doc_id", "quality", pieces("text").alias("pieces")).toArrow().to_pylist()
    fit.sort(key=lambda r: (r["doc_id"], r["quality"], r["pieces"]))
    pick = lambda q: [b"".join(r["pieces"]) for r in fit if r["quality"] == q]
    good, bad = pick(1), pick(0)
    if not good or not bad:  # too few to part the sample
        both = rows.select("quality", pieces("text").alias("pieces")).toArrow().to_pylist()
        good, bad = ([b"".join(r["pieces"]) for r in both if r["quality"] == q] for q in (1, 0))
        if not good or not bad:
            return None
        rows = rows.withColumn("fit", F.lit(False))
    model = CompressionModel(dictionary(good), dictionary(bad), 1.0, np.zeros(4))
    rest = measured(rows.where("not fit").select("quality", "text"), model, "difference").select("quality", "difference").toArrow()
    d, y = rest.column("difference").to_numpy(), rest.column("quality").to_numpy().astype(float)
    order = np.lexsort((d, y))
    d, y = d[order], y[order]
    model.scale = float(d.std()) or 1.0 if len(d) else 1.0
    # the sample holds both classes alike; the intercept goes back to their true shares
    seen, true = max(0.5, y.sum()) / max(0.5, len(y) - y.sum()), sizes[1] / sizes[0]
    model.weights = logistic(features(d, model.scale), y)
    model.weights[0] += np.log(true / seen)
    return model


def spread_text(text: str) -> list[bytes]:
    return spread(text.encode())


def measured(docs: DataFrame, model: CompressionModel | None, out: str) -> DataFrame:
    """docs with a column: the difference of sizes, or (``score``) the probability made of it."""
    base = docs.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        compressors = model.compressors() if model else None
        for batch in text_slices(batches):
            found = np.full(batch.num_rows, PRIOR)
            if model:
                found = differences([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], compressors)
                if out == "score":
                    found = 1 / (1 + np.exp(-np.clip(features(found, model.scale) @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, out])

    return arrow_map(base, rate, schema)


def score(docs: DataFrame, model: CompressionModel | None) -> DataFrame:
    """Every row of docs (it needs a text column) with ``score``, the probability of good quality, 0 to 1.

    Null and empty texts are scored as a text of no bytes. Without a model all scores are PRIOR.
    An existing column score is replaced.
    """
    return measured(docs, model, "score")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = score(docs, model)
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
