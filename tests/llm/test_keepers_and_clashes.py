"""Near-copies by representatives, columns that clash with inner names, samples of large corpora."""

import random

import pytest
from pyspark.sql import functions as F

from shopledger.llm import decontamination, language_id, near_copies, quality_classifier, quality_rules
from shopledger.llm.common import unused

from .test_operators import _long, _shingles, _similarity, prose, table


def _family(n, shared=300, pool=20, own=5, words=20, seed=3):
    """Texts of one template, each with some of a pool of blocks: few pairs are near-copies, but they chain."""
    r = random.Random(seed)
    template, blocks = _long("t", shared), [_long(f"b{k}x", words) for k in range(pool)]
    return [" ".join([*template, *(w for k in sorted(r.sample(range(pool), own)) for w in blocks[k])]) for _ in range(n)]


def _check(texts, keeper, similarity=0.8, spare=0):
    sets = [_shingles(t) for t in texts]
    stay = [i for i in range(len(texts)) if keeper[i] == i]
    for i, k in keeper.items():
        assert keeper[k] == k
        assert i == k or _similarity(sets[i], sets[k]) >= similarity - 1e-9, (i, k)
    alike = sum(_similarity(sets[i], sets[j]) >= similarity for n, i in enumerate(stay) for j in stay[:n])
    assert alike <= spare
    return stay


def test_no_text_goes_by_way_of_another(spark):
    texts = _family(300)
    stay = _check(texts, dict(near_copies.kept_copies(table(spark, texts)).collect()))
    assert 10 < len(stay) < 300
    kept = {r["doc_id"] for r in near_copies.drop_near_duplicates(table(spark, texts)).collect()}
    assert kept == set(stay)


def test_a_chain_of_small_changes_keeps_its_ends(spark):
    words = _long("w", 200)
    texts = []
    for step in range(12):
        texts.append(" ".join(words))
        words = [*words[:16 * step], *_long(f"n{step}x", 16), *words[16 * step + 16 :]]
    stay = _check(texts, dict(near_copies.kept_copies(table(spark, texts)).collect()))
    assert 0 in stay and len(stay) >= 4


def test_short_texts_find_their_copies(spark):
    r, texts = random.Random(8), []
    for k in range(150):
        base = _long(f"k{k}x", r.randint(24, 60))
        texts += [" ".join(base), " ".join([*base, "end"])]
    keeper = dict(near_copies.kept_copies(table(spark, texts)).collect())
    assert _check(texts, keeper, spare=2) and sum(keeper[i] == i for i in keeper) <= 152


def test_large_groups_of_copies_leave_one(spark):
    base = _long("c", 300)
    texts = [" ".join([*base[:i % 300], f"x{i}", *base[i % 300 + 1 :]]) for i in range(400)]
    stay = _check(texts, dict(near_copies.kept_copies(table(spark, texts)).collect()))
    assert stay == [0]


def test_the_search_begins_with_the_pivot_distance_table(spark, monkeypatch):
    class Reached(Exception):
        pass

    def links(fps, radius):
        raise Reached(radius)

    monkeypatch.setattr(near_copies, "fingerprint_links", links)
    with pytest.raises(Reached, match="2"):
        near_copies.drop_near_duplicates(table(spark, [prose(k, 30) for k in range(4)]))


def test_pivot_pairs_join_what_lies_within_two_bits(spark):
    texts = [" ".join([*_long(f"t{k}", 1500), f"end{i}"]) for k in range(6) for i in range(4)]
    bits = [near_copies.profile(t, 5)[1] for t in texts]
    root = list(range(len(texts)))
    near = [(j, i) for i in range(len(texts)) for j in range(i) if ((bits[i] ^ bits[j]) & (2**64 - 1)).bit_count() <= 2]

    def joined(pairs):
        of = root.copy()
        for a, b in pairs:
            of = [of[a] if x == of[b] else x for x in of]
        return sorted(sorted(i for i, x in enumerate(of) if x == y) for y in set(of))

    got = near_copies._pivot_pairs(spark.createDataFrame([(i + 1, b, i) for i, b in enumerate(bits)], "node long, fp long, rank long"))
    assert len(near) > 10 and joined(near) == joined([(r["a"] - 1, r["b"] - 1) for r in got.collect()])


def test_representatives_equal_greedy_choice(spark):
    r = random.Random(4)
    for n, m in ((30, 40), (60, 300), (40, 15)):
        links = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
        rank = {i: r.randint(0, n // 2) for i in range(n)}
        near = {i: {b if a == i else a for a, b in links if i in (a, b)} for i in range(n)}
        stay, want = [], {}
        for i in sorted(range(n), key=lambda i: (rank[i], i)):
            hold = [k for k in stay if k in near[i]]
            if hold:
                want[i] = set(hold)
            else:
                stay.append(i)
        got = dict(near_copies.representatives(spark.createDataFrame(list(links), "a long, b long"), spark.createDataFrame(list(rank.items()), "node long, rank long")).collect())
        assert got.keys() == want.keys() and all(got[i] in want[i] for i in got)


CLASHES = ("_host", "_copy", "_cut", "of", "cut", "host", "copy", "uid", "line", "_doc", "gone", "node", "keeper", "rank", "at", "n_hit", "n_words", "n_items", "items_sha256", "_t1", "_t2", "contaminated", "whole", "t1", "kept", "lines")


@pytest.mark.parametrize("stage", ["quality", "lines", "copies", "benchmark"])
def test_extra_columns_of_any_name_stay_as_they_are(spark, stage):
    texts = [prose(k, 80) for k in range(6)] + [prose(0, 80) + " end", None, ""]
    docs = table(spark, texts).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in CLASHES})
    of = {"quality": quality_rules.keep_good, "lines": quality_rules.without_common_lines, "copies": near_copies.drop_near_duplicates, "benchmark": lambda d: decontamination.without_contaminated(d, table(spark, [prose(3, 80)]).withColumn("item_id", F.col("doc_id")))}[stage]
    got = of(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    want = {"quality": {*range(7)}, "lines": {*range(9)}, "copies": {*range(6), 7}, "benchmark": {0, 1, 2, 4, 5, 6, 7, 8}}[stage]
    assert {r["doc_id"] for r in rows} == want
    assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHES)
    assert of(docs.limit(0)).count() == 0


def test_unused_names(spark):
    assert unused(spark.createDataFrame([], "Cut int, cut_ int"), "cut") == "cut__"


def test_a_sample_of_any_corpus_is_not_empty(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 2)
    docs = table(spark, [f"ein der die und {k}" for k in range(4000)])
    names, _ = language_id.learn(docs)  # a share of 1 in 2000
    assert names in (["en"], [])
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 50)
    assert language_id.learn(docs)[0] == ["en"]


def test_a_repeated_document_does_not_swell_the_sample(spark):
    docs = table(spark, ["good text here"] * 40 + ["bad | text"] * 40).withColumn("doc_id", F.when(F.col("doc_id") < 40, 1).otherwise(2).cast("long"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = quality_classifier.quality_scores(docs, labels).collect()
    assert len(rows) == 80 and len({r["score"] for r in rows}) <= 2


def test_candidates_of_both_searches_are_judged_in_one_pass(spark, monkeypatch):
    seen, alike = [], near_copies._alike

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(near_copies, "_alike", counted)
    base = [_long(f"p{k}", 1500) for k in range(3)]
    texts = [" ".join([*words, f"end{i}"]) for words in base for i in range(2)]  # few bits apart
    texts += [" ".join([*_long(f"b{k}", 200), *(["more"] * 12 if i else [])]) for k in range(3) for i in range(2)]
    keeper = dict(near_copies.kept_copies(table(spark, texts)).collect())
    assert sorted(set(keeper.values())) == list(range(0, 12, 2)) and len(seen) == 1 and seen[0] >= 6
