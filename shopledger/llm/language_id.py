"""Language identification by hyperdimensional profiles.

Each letter has a random vector of signs. The vector of three letters in a row binds theirs, each
permuted by its place; a text bundles those of all its letter triples, and a language those of
its texts. A text's language is the prototype of the highest cosine.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS, SEED = 1024, 11
SAMPLE_ROWS = 20_000
TEXTS_AT_ONCE = 128
_SCALE = 1 << 20
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


@lru_cache(maxsize=20_000)
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1


@lru_cache(maxsize=30_000)
def triple_vector(triple: int) -> np.ndarray:
    a, b, c = (triple >> 42), (triple >> 21) & 0x1FFFFF, triple & 0x1FFFFF
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


def triples(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct letter triples, counts) of the whole text; runs of other characters are one space."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[_SPACE], np.where(letter, codes, _SPACE), [_SPACE]])
    codes = codes[np.concatenate([[True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)])]
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


def bundles(texts: list[str | None]) -> np.ndarray:
    """A vector of length one for each text; all zero without letters."""
    found = [triples(t) for t in texts]
    every, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    counts = np.zeros((len(texts), len(every)), dtype=np.float32)
    counts[np.repeat(np.arange(len(texts)), [len(f[0]) for f in found]), place] = np.concatenate([f[1] for f in found])
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for at in range(0, len(every), 8192):
        vectors = np.stack([triple_vector(t) for t in every[at : at + 8192].tolist()]).astype(np.float32)
        out += counts[:, at : at + 8192] @ vectors
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, their prototypes) from ``labelled`` (doc_id, text, lang).

    At most about ``SAMPLE_ROWS`` rows, the least by a hash of doc_id, are learned from. Sums
    are of whole numbers, so their order does not matter.
    """
    total = labelled.select("lang").count()
    below = -(1 << 63) + min((1 << 64) - 1, (SAMPLE_ROWS << 64) // max(1, total))  # of all hashes the share that is wanted, however small
    sample = labelled.filter(F.xxhash64("doc_id") <= below).select("text", "lang")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, np.ndarray] = {}
        for f in frames:
            for at in range(0, len(f), TEXTS_AT_ONCE):
                some = f.iloc[at : at + TEXTS_AT_ONCE]
                vectors = np.rint(bundles(list(some["text"])) * _SCALE).astype(np.int64)
                for lang, rows in some.reset_index(drop=True).groupby("lang").groups.items():
                    by[lang] = by.get(lang, 0) + vectors[list(rows)].sum(axis=0)
        if by:
            yield pd.DataFrame({"lang": list(by), "v": list(by.values())})

    partial = sample.mapInPandas(sums, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    rows = partial.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    found = [(r["lang"], np.array([x["x"] for x in r["v"]], dtype=np.float64)) for r in rows]
    found = [(lang, v / np.linalg.norm(v)) for lang, v in found if v.any()]
    return [lang for lang, _ in found], np.array([v for _, v in found], dtype=np.float32).reshape(-1, DIMENSIONS)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of each row; ``und`` and 0 without letters or languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vector for each language

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = shared.value
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                vectors = bundles(some.column(1).to_pylist())
                cosines = vectors @ prototypes.T if names else np.zeros((len(vectors), 1))
                known = vectors.any(axis=1) & bool(names)
                best = cosines.argmax(axis=1)
                value = np.where(known, np.clip(np.round(cosines.max(axis=1).astype(float), 6), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([names[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()), pa.array(value, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from ``docs`` (doc_id, text, lang) outside the held fold.

    A null text, or one without letters, is ``und``; a null lang teaches nothing; a null doc_id is
    not held out; repeated rows count and give results each; of equal cosines the language first by name
    counts; texts of any length are read whole; an empty table gives no rows; other columns, whatever
    their names, are left out.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    model = learn(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~out).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
