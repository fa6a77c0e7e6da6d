"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Training takes a bounded sample of the labelled rows, the first by a hash of their doc_id. Each round
deals it to a fixed number of workers that go on from the common state, and averages their states
coordinate by coordinate (only those that a worker touched). A score is a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, whole_partition

TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS = 18
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.005, 0.01
SAMPLE_ROWS, WORKERS, ROUNDS = 16_000, 4, 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_hashes: dict[str, int] = {}


def _shape(token: str) -> str:
    """A class in place of the letters of a token: what stays when the words are new."""
    if token[0].isalnum() or token[0] == "_":
        return "<UPPER>" if token.isupper() and len(token) > 1 else "<Title>" if token[0].isupper() else "<digit>" if token.isdigit() else "<word>"
    return token[:3]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, their weights) of the whole text: words, pairs, and triples of word classes.

    Weights are log counts scaled to length one, so a long text weighs no more than a short one;
    an empty text has only the constant.
    """
    import xxhash

    if len(_hashes) > 150_000:
        _hashes.clear()
    tokens = TOKEN.findall(text or "")
    words = np.empty(len(tokens), dtype=np.uint64)
    shapes = np.empty(len(tokens), dtype=np.uint64)
    for i, t in enumerate(tokens):
        both = _hashes.get(t)
        if both is None:
            both = _hashes[t] = (xxhash.xxh3_64_intdigest(t.lower().encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(_shape(t).encode("utf-8", "surrogatepass"), 1))
        words[i], shapes[i] = both
    with np.errstate(over="ignore"):
        parts = [words, words[:-1] * _A + words[1:], shapes, shapes[:-1] * _A + shapes[1:] * _B, (shapes[:-2] * _A + shapes[1:-1]) * _B + shapes[2:] * _A]
        grams = [((p * _B) >> np.uint64(64 - BITS)).astype(np.int64) for p in parts]
    out_i, out_v = [np.zeros(1, dtype=np.int64)], [np.ones(1)]
    for group in (grams[:2], grams[2:]):
        index, count = np.unique(np.concatenate(group), return_counts=True)
        if len(index):
            weight = np.log1p(count)
            out_i.append(index)
            out_v.append(weight / np.sqrt((weight**2).sum()))
    return np.concatenate(out_i), np.concatenate(out_v)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights for the state (z, n)."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over (index, value, label) rows, changing z and n."""
    for index, value, label in rows:
        w = weights(z[index], n[index])
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
        np.add.at(z, index, g - sigma * w)
        np.add.at(n, index, g * g)


def _workers(shared):
    """The workers' passes from the common state: the coordinates that each touched."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        index, z0, n0 = shared.value
        z[index], n[index] = z0, n0
        frame = frame.sort_values(["turn", "label"])
        rows = [(*features(t), label) for t, label in zip(frame["text"], frame["label"], strict=True)]
        touched = np.unique(np.concatenate([i for i, _, _ in rows]))
        learn(rows, z, n)
        return pd.DataFrame({"i": touched, "z": z[touched], "n": n[touched]})

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = whole_partition(frames)
        if rows is not None:
            for _, frame in rows.groupby("worker"):
                yield one(frame)

    return of


def sample(labels: DataFrame, most: int = SAMPLE_ROWS, workers: int = WORKERS) -> DataFrame:
    """doc_id, label, worker, turn of at most ``most`` rows of ``labels`` (doc_id, label), the first by a hash.

    The rows are dealt to the workers by turns, so that all have as many, but for one.
    """
    first = labels.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(most)
    rank = F.row_number().over(Window.orderBy("turn", "doc_id"))  # over the bounded sample alone
    return first.withColumn("worker", F.pmod(rank, F.lit(workers)).cast("int"))


def train(sampled: DataFrame, workers: int = WORKERS) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) of a model for ``sampled`` (text, label 0/1, worker, turn), of a bounded count.

    The model has at most 2 ** ``BITS`` weights. Without rows all weights are zero. A worker's rows are
    one task's, under a partition of their own.
    """
    spark = sampled.sparkSession
    sampled = materialise(sampled.select("worker", "turn", "text", "label"))  # texts, not features: these are larger, and cross the shuffle in each round
    state = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(state)  # bounded by 2 ** BITS entries

        dealt = sampled.repartitionByRange(workers, "worker")
        found = dealt.mapInPandas(_workers(shared), "i long, z double, n double").groupBy("i").agg(F.sort_array(F.collect_list("z")).alias("z"), F.sort_array(F.collect_list("n")).alias("n"))
        new = found.select("i", F.aggregate("z", F.lit(0.0), lambda a, x: a + x) / F.size("z"), F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / F.size("n")).toPandas()
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        z[state[0]], n[state[0]] = state[1], state[2]
        z[new.iloc[:, 0]], n[new.iloc[:, 0]] = new.iloc[:, 1], new.iloc[:, 2]
        index = np.flatnonzero(n)
        state = (index, z[index], n[index])
    w = weights(state[1], state[2])
    return state[0][w != 0], w[w != 0]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[shared.value[0]] = shared.value[1]
        for batch in batches:
            sums = [float(w[i] @ v) for i, v in (features(t.as_py()) for t in batch.column(1))]
            p = 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=float), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(p, 9)), pa.array((np.round(p, 9) >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labelled rows outside the held fold.

    The fold is crc32 of the doc_id as text; a null doc_id is not held out and has no label. Only the
    sample's doc_ids, which are bounded, go to the texts, so no text is shuffled to find its label. Of
    several labels of a doc_id the highest counts, of several texts the first in order; a null label teaches
    nothing; a score equal to the threshold is 1; an empty or null text has the score of the constant;
    without labels all scores are 0.5; an empty table gives no rows; texts of any length are read
    whole, other columns left out.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label")).filter(fold != held)
    known = materialise(sample(known.groupBy("doc_id").agg(F.max("label").alias("label"))))
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label", "worker", "turn").agg(F.min("text").alias("text"))
    scored = score(docs, train(texts))
    return scored.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", "predicted")
