"""Importance resampling and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from shopledger.llm import periodic_runs, resampling

from .test_operators import ODD, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# resampling


def _features(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]).encode() for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def _resampled(docs, target, longest, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in _features(text, longest)[0]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s.sum() + buckets) / ((s[i] + 1) * (t.sum() + buckets)))) for i in range(buckets)]
    rows = []
    for doc_id, text in docs:
        found, n = _features(text, longest)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted((*r[:4], rank.get(id(r))) for r in rows)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, longest):
    texts = [*ODD, *(prose(i, 15 + 3 * i) for i in range(40)), "x" * 1_000_000, "A-b c\x7fd É9 " * 30_000]
    docs = table(spark, texts, weight=1, rank="clash", score=None, uid=2, part=3, n_words="x").repartition(3)
    target = [prose(100 + i, 30) for i in range(5)] + [None, ""]
    rows = resampling.resample(docs, table(spark, target), longest, buckets=500, percent=30).collect()
    assert sorted(tuple(r) for r in rows) == _resampled(list(enumerate(texts)), target, longest, 500, 20, 30)


def test_resampling_of_nothing_ties_and_nulls(spark):
    docs = table(spark, [])
    assert resampling.resample(docs, docs).count() == 0
    same = table(spark, [prose(1, 30)] * 6)
    assert {r["weight"] for r in resampling.resample(same, docs).collect()} == {r["weight"] for r in resampling.resample(same.limit(3).union(same.limit(3)), docs).collect()}
    from pyspark.sql import functions as F

    twice = same.withColumn("doc_id", F.when(F.col("doc_id") < 5, F.lit(7).cast("long")))
    rows = resampling.resample(twice, docs, percent=100).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5, 6]
    assert [r["rank"] for r in rows if r["doc_id"] is None] == [6]


def test_table_resolves_equal_keys_by_bytes():
    found, _ = resampling.grams([b"aa bb aa cc bb aa dddd", b"cc aa"], 1)
    seen = resampling.Table(found, 97, keys=np.full(len(found.starts), 15, dtype=np.uint64))
    slot = dict(zip([found.data[a:b] for a, b in zip(found.starts, found.ends, strict=True)], seen.slots.tolist(), strict=True))
    assert len(set(slot.values())) == 4
    assert {w: int(seen.count[s]) for w, s in slot.items()} == {b"aa": 4, b"bb": 2, b"cc": 2, b"dddd": 1}
    assert all(seen.bucket[s] == zlib.crc32(w) % 97 for w, s in slot.items())


# runs


def _runs(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e - s) for (s, e), q in found.items())


def _digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = [(s, e, q) for s, q, e in _runs(words)]
    gone = {i for s, e, q in runs for i in range(s + q, s + e)}
    best = min(runs, key=lambda r: (-(r[1] * math.lcm(*(x[2] for x in runs)) // r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{e},{q}\n" for s, e, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def _nested(r):
    """Words with runs within runs, cut and joined at random."""
    words = []
    while len(words) < r.randint(30, 700):
        block = [r.choice("abcdefgh") for _ in range(r.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40]))]
        if r.random() < 0.4:
            block = block * r.randint(2, 12) + [r.choice("xyz")] * r.randint(0, 9)
        words += block * r.randint(1, r.choice([2, 5, 12])) + [r.choice("abcpq") for _ in range(r.randint(0, 12))]
    return words


def test_tiles_and_stitching_equal_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(_nested(r)) for _ in range(150)]
    texts += [" ".join(["a"] * n) for n in (23, 24, 25, 47, 48, 49, 300)]
    texts += [" ".join((x * k)[: 3 * len(x) + d]) for x in ([str(i) for i in range(16)], [str(i) for i in range(64)], [str(i % 33) for i in range(100)]) for k in (4,) for d in (-1, 0, 1)]
    rows = periodic_runs.periodic_runs(table(spark, texts, start="clash", uid=1, period=0).repartition(5)).collect()
    found = {}
    for x in rows:
        found.setdefault(x["doc_id"], []).append((x["start"], x["period"], x["length"]))
    for i, text in enumerate(texts):
        assert sorted(found.get(i, [])) == _runs(text.split()), text


def test_slabs_of_a_long_text_are_stitched(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLAB_WORDS", 64)
    monkeypatch.setattr(periodic_runs, "_ROW_BYTES", 500)
    r = random.Random(6)
    texts = [" ".join(_nested(r)) for _ in range(40)] + [" ".join(f"w{i % 211}" for i in range(3000))]
    rows = periodic_runs.periodic_runs(table(spark, texts)).collect()
    found = {}
    for x in rows:
        found.setdefault(x["doc_id"], []).append((x["start"], x["period"], x["length"]))
    for i, text in enumerate(texts):
        assert sorted(found.get(i, [])) == _runs(text.split())


def test_run_digests_equal_brute_force(spark):
    r = random.Random(7)
    texts = [*ODD, *(prose(i, 60 + 7 * i) for i in range(40)), *(" ".join(_nested(r)) for _ in range(60)), "é\x1c b\x0bc " * 40]
    docs = table(spark, texts, n_runs=1, words="clash", plain=2, octave=0).repartition(4)
    rows = periodic_runs.run_digests(docs).collect()
    assert sorted(tuple(x) for x in rows) == sorted(_digest(i, t) for i, t in enumerate(texts))
    assert any(x["n_runs"] > 1 for x in rows)


def test_runs_of_repeated_null_and_no_rows(spark):
    from pyspark.sql import functions as F

    docs = table(spark, ["a b " * 30, None, "a b " * 30]).withColumn("doc_id", F.when(F.col("doc_id") != 1, F.lit(1).cast("long")))
    rows = periodic_runs.run_digests(docs).collect()
    assert sorted((x["doc_id"] is None, x["n_runs"], x["period"]) for x in rows) == [(False, 1, 2), (False, 1, 2), (True, 0, None)]
    assert periodic_runs.run_digests(docs.limit(0)).count() == periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_a_megabyte_of_one_word(spark):
    rows = periodic_runs.periodic_runs(table(spark, ["ab " * 350_000])).collect()
    assert [(x["start"], x["length"], x["period"]) for x in rows] == [(0, 350_000, 1)]
