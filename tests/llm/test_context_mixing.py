"""Context mixing: counts against brute force, scores against one token after another, held-out gain."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopledger.llm import context_mixing as cm
from shopledger.llm.common import materialise

from .test_operators import ODD, prose, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


BITS = 17


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def _base(docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = collections.Counter(t for i, text in docs if not held(i) for t in [*_words(text), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, text in docs:
        tokens = [*_words(text), None]
        out[i] = (held(i), len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
    return out


TEXTS = [*ODD, *(prose(i, 40 + 9 * i, 60) for i in range(60)), "Ab\x0bCÉ ab\x00c " * 20, "ACGT" * 3000, "z" * 1_000_000]


@pytest.mark.parametrize("frequent", [400_000, 200])
def test_base_columns_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(cm, "FREQUENT", frequent)
    docs = table(spark, TEXTS, score="clash", uid=1, rare=2, kind="x", word=5).repartition(4)
    rows = {r["doc_id"]: r for r in cm.language_scores(docs, slot_bits=BITS).collect()}
    want = _base(list(enumerate(TEXTS)))
    assert rows.keys() == want.keys()
    for i, (held, n, known, total, base) in want.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
        size = len((TEXTS[i] or "").encode())
        assert r["bits_per_byte"] == (pytest.approx(-r["score"] * math.log2(10) / size) if size else None)
    same = [i for i, t in enumerate(TEXTS) if t == "same text here"]
    assert len({rows[i]["score"] for i in same}) == 1


def _model(spark, texts):
    docs = table(spark, texts)
    groups = cm.word_groups(docs, cm.frequent_words(docs))
    units = materialise(cm.unit_counts(docs, groups))
    return cm.train(units, 2, BITS), groups, units


def test_scores_equal_one_token_after_another(spark):
    texts = [*(prose(i, 90, 30) for i in range(25)), *(t for t in ODD if t and len(t) < 100)]
    model, groups, _ = _model(spark, texts)
    frame = [(i, i, t) for i, t in enumerate(texts)]
    import pyarrow as pa

    class Shared:
        def __init__(self, value):
            self.value = value

    batch = pa.RecordBatch.from_pylist([{"uid": a, "doc_id": b, "text": c} for a, b, c in frame])
    got = next(cm._score(Shared(model), Shared([]), groups, 1, lambda c: np.log10(c + 0.5))(iter([batch]))).column("score").to_pylist()

    def bits(contexts, k_symbols, place):
        """The log probability of some bytes, one decision after another."""
        total = 0.0
        for (cs, symbol), p in zip(zip(contexts, k_symbols, strict=True), place, strict=True):
            at = int(model.code.first[symbol])
            for j in range(at, at + int(model.code.length[symbol])):
                slots = []
                for k, c in enumerate(cs):
                    m = ((c + k + 1) * cm._BASE) % 2**64
                    m ^= m >> 29
                    node = int(model.code.node[j])
                    place_ = (m ^ (node >> 4) * 0xD6E8FEB86659FD93 % 2**64) * 0xC2B2AE3D27D4EB4F % 2**64 >> (68 - BITS)
                    slots.append(place_ << 4 | (node ^ m) & 15)
                gate = p * cm.SEEN + int(model.seen[slots[cm.SURE]])
                logit = sum(float(model.weights[k, gate]) * float(model.odds[s]) for k, s in enumerate(slots))
                q = 1 / (1 + math.exp(-max(-30, min(30, logit))))
                q = (q + model.refined[gate * cm.STEPS + round((max(-8, min(8, logit)) + 8) * 2)]) / 2
                q = min(max(q, 1e-7), 1 - 1e-7)
                total += math.log(q if model.code.bit[j] else 1 - q)
        return total

    for text, score in zip(texts, got, strict=True):
        words = [w.encode() for w in _words(text)]
        met, total, share, worth = collections.Counter(), 0.0, cm.OWN_SHARE, 0.0
        before, past = b"", collections.Counter()
        for t, word in enumerate([*words, None]):
            kind = min((g for g in met if met[g] == max(met.values())), default=0)
            symbol, kk = (word[0] if word else cm.END), (kind + 1) << 48
            last, other = (before[-1] if before else 0), (before[-2] if len(before) > 1 else 0)
            pair = other << 8 | last
            first = [last | kk, last, pair, kk, pair | kk, other | kk]
            lp = bits([[c | 1 << 40 for c in first]], [symbol], [0])
            if word:
                contexts, symbols, places = [], [], []
                for i, b in enumerate([*word[1:], cm.SPACE], 1):
                    so_far = word[:i]
                    at = lambda d: so_far[-d] << 8 * (d - 1) if len(so_far) >= d else 0  # noqa: B023, E731
                    two = at(1) | at(2)
                    whole = sum((c + 1) * pow(cm._BASE, j, 2**64) for j, c in enumerate(so_far)) % 2**64
                    contexts.append([at(1) | kk, two | kk, two | at(3) | kk, two | at(3) | at(4), (whole + kk) % 2**64, whole])
                    symbols.append(b)
                    places.append(min(i, cm.PLACES - 1))
                lp += bits(contexts, symbols, places)
            own = share * past[word] / t if word and t else 0
            both = own + (1 - share) * math.exp(lp)
            total += math.log(both)
            worth += own / both
            if (t + 1) % cm.BLOCK == 0:
                share = (cm.OWN_WEIGHT * cm.OWN_SHARE + worth) / (cm.OWN_WEIGHT + t + 2)
            if word:
                past[word] += 1
                before = word
                if word in groups:
                    met[groups[word]] += 1
        assert score == pytest.approx(total / math.log(10), rel=1e-4)


def test_words_are_counted_whole_however_often_a_task_empties_its_table(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cm, "HELD_WORDS", 50)
    texts = [prose(i, 200, 60) for i in range(30)]
    groups = {b"w1": 1, b"w2": 2}
    of, counts = cm._count_units(groups), []
    for size in (1, 30):
        found = collections.Counter()
        for b in of(pa.RecordBatch.from_pydict({"text": texts[i : i + size]}) for i in range(0, 30, size)):
            for k, u, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found[k, u] += n
        counts.append(+found)
    assert counts[0] == counts[1]
    assert sum(n for (k, _), n in counts[0].items() if k <= cm.KINDS) == sum(len(t.split()) for t in texts) and counts[0][cm.ENDS, b"\n"] == 30


def test_slots_hold_all_counts(spark):
    _, _, units = _model(spark, [prose(i, 50, 40) for i in range(20)])
    model = cm.train(units, 1, BITS)
    again = cm.train(units.repartition(3), 3, BITS)
    assert (model.odds == again.odds).all() and (model.seen == again.seen).all()


def test_first_bytes_are_a_distribution(spark):
    model, *_ = _model(spark, [prose(i, 50, 40) for i in range(20)])
    for before in (0, ord("w") << 8, 3 << 24 | ord("1") << 16 | ord("7") << 8):
        keys = np.arange(256) + before
        assert np.exp(model.log_probabilities(cm.first_decisions(keys, model.code), 256)).sum() == pytest.approx(1)


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = cm.language_scores(docs).filter("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n"), F.avg(F.expr("score > base_score").cast("double")).alias("better")).first()
    assert r["score"] > r["base"] + 0.1 * r["n"] and r["better"] > 0.5


def test_shuffled_letters_score_lower(spark):
    import random

    texts = [prose(i % 3, 60, 50) for i in range(40)]
    odd = " ".join("".join(random.Random(i).sample(w, len(w))) + "q" for i, w in enumerate(texts[0].split()))
    rows = {r["doc_id"]: r["score"] for r in cm.language_scores(table(spark, [*texts, odd]), slot_bits=BITS).collect()}
    assert rows[40] < rows[0]


def test_nothing_nulls_and_repeats(spark):
    docs = table(spark, ["a b", None, "a b"]).withColumn("doc_id", F.when(F.col("doc_id") != 1, F.lit(1).cast("long")))
    assert cm.language_scores(docs.limit(0), slot_bits=BITS).count() == 0
    held = zlib.crc32(b"1") % 5 == 1
    rows = cm.language_scores(docs, slot_bits=BITS).collect()
    assert sorted((r["doc_id"] is None, r["held_out"], r["n_tokens"]) for r in rows) == [(False, held, 3), (False, held, 3), (True, False, 1)]
    only_held = table(spark, ["a b c"] * 40).filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in cm.language_scores(only_held, slot_bits=BITS).collect()} == {(0, 0, 0.0)}


def test_words_that_begin_alike_share_steps(monkeypatch):
    words = [b"abcd", b"abce", b"abcd", b"ab", b"b", b"abcd"]
    kinds = np.array([0, 0, 1, 0, 2, 0])
    code = cm.prefix_code(np.ones(256), BITS)
    steps = cm.word_steps(words, kinds)
    # of kind 0: b, c, d, e, the ends of ab, abcd, abce; of kind 1: b, c, d, end; of kind 2: the end of b
    assert len(steps.symbols) == 12 and len(steps.step) == sum(map(len, words))
    apart = [cm.word_steps([w], kinds[i : i + 1]) for i, w in enumerate(words)]
    for i, one in enumerate(apart):
        mine = steps.step[steps.word == i]
        assert all((c[mine] == o).all() for c, o in zip(steps.contexts, one.contexts, strict=True))
        assert (steps.symbols[mine] == one.symbols).all() and (steps.place[mine] == one.place).all()
    weighed = [(d, n) for d, n in cm._weighed(cm.Words(words, kinds), np.arange(1.0, 7.0), code)]
    assert sum(len(d.bit) for d, _ in weighed) == 12 * 8 and sum(n.sum() for _, n in weighed) == 8 * sum(n * len(w) for n, w in enumerate(words, 1))


def test_steps_of_one_hash_stay_apart():
    symbols, place = np.frombuffer(b"abab", dtype=np.uint8), np.array([1, 2, 1, 2])
    heads = np.array([5, 5, 6, 6])
    step, some = cm._alike_steps(np.array([1, 2, 3, 2], dtype=np.uint64), symbols, place, heads)  # the same byte after different ones
    assert step.tolist() == some.tolist() == [0, 1, 2, 3]
    step, some = cm._alike_steps(np.array([1, 2, 1, 2], dtype=np.uint64), symbols, place, np.array([5, 5, 5, 5]))
    assert step.tolist() == [0, 1, 0, 1] and some.tolist() == [0, 1]


def _arrow(texts):
    """Texts as Spark hands them over, which need not be valid UTF-8."""
    import pyarrow as pa

    raw = pa.array(texts, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())


def test_tokens_split_at_the_six_spaces_only():
    texts = [None, b"", b" \t\n", b"a", b" A  b\x0b\x0cC\x1c\x1fd \r", "ÉA\x85b\xa0c".encode(), b"\xff A\x80b ", b"a\x00B a"]
    for some in (texts, texts[:2], [None], []):
        words, n = cm.tokens(_arrow(some))
        split = [(t or b"").lower().split() for t in some]
        assert n.tolist() == [len(s) for s in split]
        assert [cm.listed(words.dictionary)[i] for i in words.indices.to_pylist()] == [w for s in split for w in s]


def test_passes_make_no_object_for_each_word():
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([_arrow([b"Some words " * 250_000, b"words"])], names=["text"])
    tracemalloc.start()
    (found,) = cm._often(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)) == {b"some": 250_000, b"words": 250_001}
    assert peak < 24 * 500_000  # numbers of half a million words take 12 bytes each, objects in a list took 60
