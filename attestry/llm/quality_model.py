"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's words are split where letters, digits and other signs meet ("the%%%" is "the", "%%%"), case kept; a token equal to the
one before it is written as a repeat mark, so that n-grams can tell of repetition whatever the word. Unigrams, bigrams and
trigrams of whole texts are hashed into 2**BITS weights; a text's value for each is its count over the number of tokens. The
score is a sparse dot product through the logistic function.

Training uses a bounded sample: TRAIN_DOCS labelled documents (the rest of the corpus only if its labels are fewer), taken by a
hash of the id over all labelled rows outside the held-out third, one text an id (the first in byte order, where rows repeat it).
They are turned into sparse rows where they are; one task makes EPOCHS passes of per-coordinate FTRL-proximal updates over these in a
fixed order.

Defined results: null or empty text has no n-grams and scores by the bias alone; labels that are null, or ids labelled both
ways, teach nothing; with nothing to learn from, every score is 0.5; a score of exactly 0.5 predicts 1; very long texts give all
their n-grams; repeated rows score alike; an empty table gives no rows; other columns aren't read. `keep` returns its input's columns and rows in which the model predicts 1.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import held_out, remembered, small_batches

TRAIN_DOCS = 5_000
BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
MEMORY = 150_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
REPEAT = np.uint64(0x9E3779B97F4A7C15)
_P2, _P3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Tokens(dict):
    """Token → 64-bit hash, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a whole text; index 0 is the bias."""
    found = TOKEN.findall(text or "")
    n = len(found)
    if not n:
        return np.zeros(1, np.int64), np.ones(1)
    h = np.fromiter(map(remembered("classifier", Tokens).__getitem__, found), np.uint64, n)
    again = np.zeros(n, bool)
    again[1:] = h[1:] == h[:-1]
    h = np.where(again, REPEAT, h)
    with np.errstate(over="ignore"):
        grams = [h]
        if n > 1:
            two = h[:-1] * _P2 + h[1:]
            two ^= two >> np.uint64(29)
            grams.append(two * _P3)
        if n > 2:
            three = (grams[1][:-1] ^ (grams[1][:-1] >> np.uint64(31))) * _P2 + h[2:]
            three ^= three >> np.uint64(29)
            grams.append(three * _P3)
    at = np.maximum((np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64), 1)
    at, counts = np.unique(at, return_counts=True)
    return np.concatenate([[0], at]), np.concatenate([[1.0], np.sqrt(counts / n) * 2])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal: z and n for each coordinate, weights made from them when used."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    ones = sum(r[2] for r in rows)
    # Both classes weigh the same in all, as labels are uneven.
    weight = (len(rows) / (2 * max(len(rows) - ones, 1)), len(rows) / (2 * max(ones, 1)))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-min(max(float(w @ x), -35.0), 35.0)))
            g = (p - y) * x * weight[y]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(1 << bits))


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> np.ndarray:
    """The weights. Labels of held-out ids aren't read; documents are looked up by the sampled ids, a bounded list."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    sample = one.select("doc_id", F.col("hi").cast("int").alias("y"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most)
    small_batches(docs.sparkSession)
    # At most `most` rows, even where rows repeat an id.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("h", "doc_id", "y").agg(F.min("text").alias("text")).select("h", "y", "text")

    def sparse(batches):
        for b in batches:
            made = [features(t) for t in b.column(2).to_pylist()]
            at, x = ([m[i] for m in made] for i in range(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([a.astype(np.float32) for a in x], pa.list_(pa.float32()))], ["h", "y", "at", "x"])

    def fit(batches):
        rows = []
        for b in batches:
            cols = [b.column(i) for i in range(4)]
            rows += [(h.as_py(), at.values.to_numpy(), x.values.to_numpy(), y.as_py()) for h, y, at, x in zip(*cols)]
        if rows:
            rows.sort(key=lambda r: r[0])
            yield pa.RecordBatch.from_arrays([pa.array([train([r[1:] for r in rows]).astype(np.float32).tobytes()], pa.binary())], ["weights"])

    # One task trains on the sample; only the weights, 2**BITS numbers, come to the driver.
    row = texts.mapInArrow(sparse, "h long, y int, at array<int>, x array<float>").repartition(1).mapInArrow(fit, "weights binary").first()
    return np.frombuffer(row["weights"], np.float32) if row else np.zeros(1 << BITS, np.float32)


def _scores(texts, w) -> list[float]:
    out = []
    for t in texts:
        at, x = features(t)
        out.append(1 / (1 + float(np.exp(-np.clip(w[at] @ x, -35, 35)))))
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches):
        w = sent.value
        for b in batches:
            s = np.array(_scores(b.column(2).to_pylist(), w), float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of `docs` that the model accepts, all their columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches):
        w = sent.value
        for b in batches:
            yield b.filter(pa.array(np.array(_scores(b.column(place).to_pylist(), w), float) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
