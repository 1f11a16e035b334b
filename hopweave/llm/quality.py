"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

A text's tokens are its runs of word bytes and its runs of other printable bytes;
features are hashed unigrams and bigrams of tokens and of token shapes, the
shape being the classes of a token's first, second and last byte, so that a
style carries over to words never seen; a token repeated at once is one bigram
whatever the token. A document is a sparse vector of its
features' shares, its score the logistic of a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._bytes import SPACE, U64, batch_rows, mix, prefix_hash, slices, span_hash, trimmed

BITS = 18
#: Labelled documents drawn for training, about, and the distinct features at which a document is too long to be one of them.
SAMPLE, LONGEST = 6000, 50_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 1e-3, 3

# Byte classes: space 0, word (letters, digits, every byte of a non-ASCII character) 1, other 2.
_KIND = np.full(256, 2, np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
# Shapes: capitals A, other word bytes a, digits 0, the rest themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[48:58] = 48


def features(column):
    """Per text: feature indices and values (shares of the text's tokens)."""
    for i, j, data, offsets in slices(column):
        n = len(data)
        if not n:
            yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in range(j - i))
            continue
        kind = _KIND[data]
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        new[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], n)
        real = kind[start] > 0
        start, end = start[real], end[real]
        row = np.searchsorted(offsets, start, "right") - 1
        word = span_hash(prefix_hash(data), start, end)
        # A shape is the classes of the first, second and last byte: "Aa", "AA", "aa", punctuation as it is.
        shape = _SHAPE[data[start]].astype(U64) << U64(16) | _SHAPE[data[np.minimum(start + 1, end - 1)]].astype(U64) << U64(8) | _SHAPE[data[end - 1]].astype(U64)
        shape = mix(shape + U64(1 << 40))
        bound = np.searchsorted(row, np.arange(j - i + 1))
        pair = lambda h: mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
        wide, broad = pair(word) if len(word) > 1 else word[:0], pair(shape) if len(shape) > 1 else shape[:0]
        wide = np.where(word[1:] == word[:-1], U64(1), wide)  # any token said twice in a row is one and the same bigram
        mask = U64((1 << BITS) - 1)
        for k in range(j - i):
            a, b = bound[k], bound[k + 1]
            if a == b:
                yield np.zeros(0, np.int64), np.zeros(0)
                continue
            idx = np.concatenate([word[a:b] & mask, wide[a : b - 1] & mask, shape[a:b] & mask, broad[a : b - 1] & mask]).astype(np.int64)
            idx, c = np.unique(idx, return_counts=True)
            yield idx, c / np.sqrt((c * c).sum())


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; an extra last weight is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, idx):
        z, n = self.z[idx], self.n[idx]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, idx, x, y, importance):
        idx, x = np.append(idx, 1 << BITS), np.append(x, 1.0)
        w = self.weights(idx)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x * importance
        s = (np.sqrt(self.n[idx] + g * g) - np.sqrt(self.n[idx])) / ALPHA
        self.z[idx] += g - s * w
        self.n[idx] += g * g


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from docs(doc_id, text) and labels(doc_id, quality) where crc32(doc_id as text) mod 3 is not 1.

    The sample is bounded in rows, drawn by a hash of doc_id with the probability that gives ``sample`` of them, and in bytes: documents of more than LONGEST
    different features are not learned from (they are scored). Null labels and ids are left out; repeated labels of an id count once, the higher one. Without both classes
    only the bias is learned.
    """
    batch_rows(docs.sparkSession, 1000)
    own = labels.where("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = own.count()
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    # At most about ``sample`` ids of 16 bytes: broadcast, so that texts are not shuffled.
    picked = F.broadcast(own.where(h < min(1.0, sample / max(total, 1))))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(picked, "doc_id")

    def run(batches):
        for batch in batches:
            f = list(features(batch["text"]))
            fits = pa.array([len(i) <= LONGEST for i, _ in f], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"].cast(pa.int32()), pa.array([i.astype(np.int32).tobytes() for i, _ in f], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in f], pa.binary())], ["doc_id", "y", "i", "v"]).filter(fits)

    got = rows.mapInArrow(trimmed(run), "doc_id long, y int, i binary, v binary").toArrow()
    model = Ftrl()
    order = np.argsort(got["doc_id"].to_numpy())
    y = (got["y"].to_numpy() > 0).astype(float)
    rare = y.mean() if len(y) else 0.5
    data = [(np.frombuffer(got["i"][int(k)].as_py(), np.int32), np.frombuffer(got["v"][int(k)].as_py(), np.float32).astype(float), y[k]) for k in order]
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            i, v, t = data[k]
            model.update(i, v, t, 0.5 / max(rare if t else 1 - rare, 0.02))
    return model.weights(np.arange((1 << BITS) + 1)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with score (0 to 1, higher: quality 1 likelier) and predicted (1 if score >= 0.5).

    Every whole text is scored; null counts as empty, which scores the bias alone. Columns of docs with these names are replaced; all others stay.
    """
    batch_rows(docs.sparkSession, 1000)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB, whatever the data
    keep = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        w = shared.value
        for batch in batches:
            z = np.array([w[i] @ v for i, v in features(batch["text"])]) if batch.num_rows else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(z + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    own = docs.select(*keep).withColumn("text", F.col("text").cast("string"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(trimmed(run), f"{kinds}, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), weights).select("doc_id", (F.expr("crc32(cast(doc_id as string)) % 3") == 1).alias("held_out"), "score", "predicted")
