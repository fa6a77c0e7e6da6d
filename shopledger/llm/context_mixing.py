"""Language-model scores by logistic context mixing.

A text is coded as its words, each ended by a space, and one end; every byte is a few binary decisions
along a prefix code. A word's first byte is predicted from the last two bytes before it, the others from
the bytes of the word so far, with and without the kind of text that the past of the text shows: frequent
words that share documents form ``KINDS`` groups, and the group met most so far names the kind. Each of ``CONTEXTS`` contexts is hashed, with the node of the code, to a
slot of one table of ``1 << SLOT_BITS`` that counts zeros and ones over the whole training corpus. The
slots' log odds are added up with weights that a gate selects (how far into the word, how often the
word's beginning was seen), learned online by worker passes over all training words whose states are
averaged. Each word is predicted without its own occurrence while the weights are learned. A table
of observed rates by gate and log odds then corrects the mixed probability.

While a document is scored, what the corpus predicts for a token is mixed with what the document's own
past does, and the share of the latter is refined after each block from how well it did: the
probability of a text is a product of what was predicted before each token.

The corpus enters as counts by distinct word, which grow with it and are shuffled, so a word costs
the same however often it comes. The model itself has a fixed size, whatever the corpus.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, materialise, partitions_for, runs_to_index

CONTEXTS, SLOT_BITS = 6, 23
#: The context, of those, whose count tells how often the word's beginning was seen in texts of the kind.
SURE = 4
#: Of so many frequent words those in the most documents are grouped by the documents they share.
FREQUENT_WORDS, ANCHORS, KINDS = 400, 160, 6
#: Axes of the correlations, and the length on them from which a word speaks for a kind.
DIMENSIONS, CLEAR = 4, 0.3
PLACES, SEEN, STEPS = 7, 8, 33
GATES = PLACES * SEEN
BLOCK_BITS = 13
#: A worker learns from about so many distinct words.
WORKER_UNITS = 500_000
#: Words of over 1 / ``FREQUENT`` of all training tokens, fewer than that many, are looked up in place.
FREQUENT = 1_000_000
#: Distinct words that a task holds at a time.
HELD_WORDS = 450_000
#: Steps of words that are decided at a time; while texts are scored, so few that what is known of them stays in a core's cache.
AT_ONCE, SCORED_AT_ONCE = 100_000, 20_000
RATE, FIRST_WEIGHT = 0.1, 0.3
#: Log odds are kept in a byte, in steps of this, up to 127 of them.
ODDS_STEP = 0.1
OWN_SHARE, OWN_WEIGHT, BLOCK = 0.1, 20.0, 32
END, SPACE = 0x0A, 0x20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


class Code(NamedTuple):
    """A prefix code of the bytes: the decisions of byte b are node[first[b]:first[b] + length[b]], bit[...].

    ``slot_bits`` is the size of the table that counts them."""

    slot_bits: int
    first: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def prefix_code(counts: np.ndarray, slot_bits: int = SLOT_BITS) -> Code:
    """The Huffman code for how often each byte occurs; a byte that does not has a code too."""
    heap = [(float(c) + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = {}
    for node in range(255):
        (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (node, 0), (node, 1)
        heapq.heappush(heap, (x + y, 256 + node, 256 + node))
    paths = []
    for b in range(256):
        path, at = [], b
        while at in parent:
            node, bit = parent[at]
            path.append((node, bit))
            at = 256 + node
        paths.append(path[::-1])
    length = np.array([len(p) for p in paths])
    flat = np.array([x for p in paths for x in p])
    return Code(slot_bits, np.cumsum(length) - length, length, flat[:, 0].astype(np.uint64), flat[:, 1].astype(bool))


class Decisions(NamedTuple):
    """Binary decisions of some units: which unit, the bit, the slot of each context, the place in the word."""

    unit: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]
    place: np.ndarray


def _decide(code: Code, contexts: list[np.ndarray], symbols: np.ndarray, unit: np.ndarray, place: np.ndarray) -> Decisions:
    n = code.length[symbols]
    of = np.repeat(np.arange(len(symbols)), n)
    flat = runs_to_index(code.first[symbols], n)
    node = code.node[flat]
    part, low = node >> _U(4), node & _U(15)
    odd = np.flatnonzero(part != _U(15))  # all but the first steps of a byte, or so
    of_odd = of[odd]
    place_of = lambda c, p: ((c ^ p) * _U(0xC2B2AE3D27D4EB4F)) >> _U(68 - code.slot_bits) << _U(4) | c & _U(15)
    slots = []
    with np.errstate(over="ignore"):
        most, others = _U(15) * _U(0xD6E8FEB86659FD93), part[odd] * _U(0xD6E8FEB86659FD93)
        for k, c in enumerate(contexts):  # a context's nodes lie side by side, sixteen at a time
            mixed = (c + _U(k + 1)) * _U(_BASE)
            mixed ^= mixed >> _U(29)
            at = np.take(place_of(mixed, most), of)
            at[odd] = place_of(np.take(mixed, of_odd), others)
            at ^= low
            slots.append(at.view(np.int64))
    return Decisions(unit[of], code.bit[flat], slots, place[of])


class Steps(NamedTuple):
    """The distinct steps of some words from a beginning to its next byte, and the word and the step of each byte."""

    contexts: list[np.ndarray]
    symbols: np.ndarray
    place: np.ndarray
    word: np.ndarray
    step: np.ndarray

    def decisions(self, code: Code, part: slice = slice(None)) -> Decisions:
        """Those of some of the steps, which are the units."""
        symbols = self.symbols[part]
        return _decide(code, [c[part] for c in self.contexts], symbols, np.arange(len(symbols)), self.place[part])


def _laid(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the words, each ended by a space, where each word starts, and its length."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8), np.cumsum(lengths + 1) - lengths - 1, lengths


def _alike_steps(key: np.ndarray, symbols: np.ndarray, place: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's step, and a byte of each step: ``key`` is a hash of what makes a step, ``heads`` has it for first bytes.

    Should one hash ever stand for several steps, which the steps before and the bytes show, none are shared.
    """
    step, every = pd.factorize(key)
    some = np.empty(len(every), dtype=np.int64)
    some[step[::-1]] = np.arange(len(key) - 1, -1, -1)  # the first byte of each
    before = np.concatenate([[0], step[:-1]])
    before = np.where(place == 1, heads, before)
    first = some[step]
    if ((before == before[first]) & (symbols == symbols[first]) & (place == place[first])).all():
        return step, some
    return np.arange(len(key)), np.arange(len(key))


def word_steps(words: list[bytes], kinds: np.ndarray) -> Steps:
    """All of each word but its first byte, and the space that ends it; ``kinds`` tells of the text before it.

    Words that begin alike share the steps of their common beginning, as all contexts lie in it.
    """
    raw, starts, lengths = _laid(words)
    at = runs_to_index(starts + 1, lengths)
    unit = np.repeat(np.arange(len(words)), lengths)
    place = at - starts[unit]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(raw), _BASE, dtype=np.uint64))
        back = np.cumprod(np.full(len(raw), _INVERSE, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + _U(1)) * powers)])
        begun, shift, kind = sums[starts][unit], back[starts][unit], ((kinds.astype(np.uint64) + _U(1)) << _U(48))[unit]
        step, some = _alike_steps((sums[at + 1] - begun) * shift + kind, raw[at], place, (raw[starts].astype(np.int64) << 8 | kinds)[unit])
        at, place, kind = at[some], place[some], kind[some]
        whole = (sums[at] - begun[some]) * shift[some]  # of the word so far
        before = [np.where(place >= d, raw[np.maximum(at - d, 0)], 0).astype(np.uint64) << _U(8 * (d - 1)) for d in range(1, 5)]
        two = before[0] | before[1]
        three = two | before[2]
        contexts = [before[0] | kind, two | kind, three | kind, three | before[3], whole + kind, whole]
    return Steps(contexts, raw[at], np.minimum(place, PLACES - 1), unit, step)


def first_decisions(keys: np.ndarray, code: Code) -> Decisions:
    """The first byte of a word, or the end: the key's lowest byte, after the last two of the word before, in a kind of text."""
    kind, other, last = keys >> 24, (keys >> 16) & 0xFF, (keys >> 8) & 0xFF
    pair, kind = (keys >> 8) & 0xFFFF, (kind + 1) << 48
    contexts = [last | kind, last, pair, kind, pair | kind, other | kind]
    contexts = [(c | 1 << 40).astype(np.uint64) for c in contexts]  # apart from those within words
    return _decide(code, contexts, keys & 0xFF, np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64))


def tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, by their place among the distinct ones, and how many each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    split = pc.ascii_split_whitespace(trimmed)
    blank = pc.equal(pc.binary_length(trimmed), 0)  # such a text is split into one empty word
    words, n = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    if pc.any(blank).as_py():
        words = words.filter(pc.not_equal(pc.binary_length(words), 0))
        n -= blank.to_numpy(zero_copy_only=False)
    return words.dictionary_encode(), n


def listed(words: pa.Array) -> list[bytes]:
    """Words as bytes; several times as fast as ``to_pylist``."""
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def kinds_before(group: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each token, ends included, the group of frequent words met most before it in its text; 0 if none was.

    ``group`` has the group of each word, 0 for most words.
    """
    at = np.zeros(len(group) + len(n), dtype=np.int8)
    is_word = np.ones(len(at), dtype=bool)
    is_word[np.cumsum(n + 1) - 1] = False
    at[is_word] = group
    starts = np.cumsum(n + 1) - n - 1
    best, most = np.zeros(len(at), dtype=np.int8), np.zeros(len(at), dtype=np.int32)
    for g in range(1, KINDS + 1):
        so_far = np.cumsum(at == g, dtype=np.int32)
        met = so_far - (at == g)
        met -= np.repeat(met[starts], n + 1)
        more = met > most
        best[more] = g
        np.maximum(met, most, out=most)
    return best.astype(np.int64)


class Numbered(dict):
    """Words with numbers from 0, given as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


class Vocabulary:
    """The words that a task has met, with the group of each; emptied when there are many."""

    def __init__(self, groups: dict[bytes, int]):
        self.groups = groups
        self.clear()

    def clear(self) -> None:
        self.known, self.group = Numbered(), np.zeros(0, dtype=np.int8)
        self.first_byte, self.last_bytes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def ids(self, words: pa.DictionaryArray) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the words, and the words that are new."""
        before = len(self.known)
        ids = np.take(self.known.of(listed(words.dictionary)), words.indices.to_numpy())
        fresh = list(islice(self.known, before, None))
        raw, starts, lengths = _laid(fresh)
        ends = starts + lengths
        last_bytes = raw[ends - 1] | np.where(lengths > 1, raw[ends - 2], 0).astype(np.int64) << 8
        self.group = np.concatenate([self.group, np.fromiter(map(self.groups.get, fresh, repeat(0)), dtype=np.int8, count=len(fresh))])
        self.first_byte = np.concatenate([self.first_byte, raw[starts]])
        self.last_bytes = np.concatenate([self.last_bytes, last_bytes])
        return ids, fresh

    def keys(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token, ends included, its first byte after the last two of the word before, and whether it is a word."""
        ends = np.cumsum(n + 1) - 1
        is_word = np.ones(len(ids) + len(n), dtype=bool)
        is_word[ends] = False
        keys, before = np.full(len(is_word), END, dtype=np.int64), np.zeros(len(is_word) + 1, dtype=np.int64)
        keys[is_word] = self.first_byte[ids]
        before[1:][is_word] = self.last_bytes[ids]  # an end leaves nothing to the next text
        return before[:-1] << 8 | keys, is_word


#: ``kind`` is for words that of the text before them, from 0 to ``KINDS``.
_UNITS = "kind int, unit binary, n long"
FIRST, ENDS = 100, 101


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``FREQUENT_WORDS`` words that are met most in a task's texts, of each ``HELD_WORDS`` or so different ones."""
    words: Counter[bytes] = Counter()

    def most() -> pa.RecordBatch:
        found = words.most_common(FREQUENT_WORDS)
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

    for batch in batches:
        found, _ = tokens(batch.column(0))
        words.update(dict(zip(listed(found.dictionary), np.bincount(found.indices, minlength=len(found.dictionary)).tolist(), strict=True)))
        if len(words) > HELD_WORDS:
            yield most()
            words.clear()
    yield most()


def frequent_words(docs: DataFrame) -> list[bytes]:
    """About the ``FREQUENT_WORDS`` most frequent words: the sums of what is most frequent in the parts of the corpus."""
    found = docs.select("text").mapInArrow(_often, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in found.orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).collect()]


def _count_units(groups: dict[bytes, int]):
    """Distinct words and first bytes of a task's texts by kind of text, counted, ``HELD_WORDS`` or so at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Vocabulary(groups)
        counts = np.zeros((0, KINDS + 1), dtype=np.int64)
        firsts: Counter[int] = Counter()
        ends = 0

        def units() -> pa.RecordBatch:
            id_, kind = np.nonzero(counts)
            other = [k.to_bytes(4, "big") for k in firsts] + [b"\n"]
            kinds = np.concatenate([kind, np.repeat([FIRST, ENDS], [len(firsts), 1])]).astype(np.int32)
            named = pa.concat_arrays([pa.array(list(met.known), pa.binary()).take(pa.array(id_)), pa.array(other, pa.binary())])
            n = np.concatenate([counts[id_, kind], np.fromiter(firsts.values(), dtype=np.int64, count=len(firsts)), [ends]])
            return pa.RecordBatch.from_arrays([pa.array(kinds), named, pa.array(n)], names=["kind", "unit", "n"])

        for batch in batches:
            words, n = tokens(batch.column(0))
            ids, fresh = met.ids(words)
            keys, is_word = met.keys(ids, n)
            kinds = kinds_before(met.group[ids], n)
            counts = np.concatenate([counts, np.zeros((len(fresh), KINDS + 1), dtype=np.int64)])
            np.add.at(counts.reshape(-1), ids * (KINDS + 1) + kinds[is_word], 1)
            codes, every = pd.factorize(kinds << 24 | keys)
            firsts.update(dict(zip(every.tolist(), np.bincount(codes).tolist(), strict=True)))
            ends += len(n)
            if len(met.known) > HELD_WORDS:
                yield units()
                met.clear()
                firsts.clear()
                counts, ends = counts[:0], 0
        if ends:
            yield units()

    return of


def unit_counts(docs: DataFrame, groups: dict[bytes, int]) -> DataFrame:
    """(kind, unit, n) over all texts of ``docs``: words and first bytes, each after the kind of text before, and ends.

    In no order, which online learning needs: by a hash within each partition.
    """
    counts = docs.select("text").mapInArrow(_count_units(groups), _UNITS).groupBy("kind", "unit").agg(F.sum("n").alias("n"))
    return counts.sortWithinPartitions(F.xxhash64("unit", "kind"), "unit", "kind")


def word_groups(docs: DataFrame, anchors: list[bytes]) -> dict[bytes, int]:
    """The group, from 1 to ``KINDS``, of the ``ANCHORS`` words in most documents, by how many documents two of them share.

    The words' correlations over documents are reduced to their main axes, where the directions of words
    are grouped around means; a word that the axes say little of is in no group.
    """
    at = {w: i for i, w in enumerate(anchors)}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = np.zeros((len(at) + 1, len(at) + 1), dtype=np.int64)  # the last stands for any text
        for batch in batches:
            found = np.zeros((batch.num_rows, len(at) + 1))
            found[:, -1] = 1
            words, n = tokens(batch.column(0))
            every = listed(words.dictionary)
            anchor = np.fromiter(map(at.get, every, repeat(-1)), dtype=np.int64, count=len(every))[words.indices.to_numpy()]
            found[np.repeat(np.arange(len(n)), n)[anchor >= 0], anchor[anchor >= 0]] = 1
            shared += (found.T @ found).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shared.size)), pa.array(shared.reshape(-1))], names=["pair", "n"])

    if not anchors:
        return {}
    rows = docs.select("text").mapInArrow(of, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # FREQUENT_WORDS squared
    shared = np.zeros((len(at) + 1) ** 2)
    shared[[r["pair"] for r in rows]] = [r["n"] for r in rows]
    shared = shared.reshape(len(at) + 1, -1)
    shared, texts = shared[:-1, :-1], shared[-1, -1]
    kept = np.sort(np.argsort(-np.diag(shared), kind="stable")[:ANCHORS])
    anchors, shared = [anchors[i] for i in kept], shared[np.ix_(kept, kept)]
    often = np.diag(shared)
    spread = np.sqrt(np.maximum(often * (texts - often), 1))
    alike = (shared * texts - np.outer(often, often)) / np.outer(spread, spread)
    values, vectors = np.linalg.eigh(alike)
    main = vectors[:, -DIMENSIONS:] * np.sqrt(np.maximum(values[-DIMENSIONS:], 0))
    size = np.sqrt((main**2).sum(axis=1))
    clear = size > CLEAR
    main = main / np.maximum(size, 1e-9)[:, None]
    if not clear.any():
        return {}
    heads = [int(np.argmax(np.where(clear, often, -1)))]
    while len(heads) < min(KINDS, clear.sum()):
        near = (main @ main[heads].T).max(axis=1)
        heads.append(int(np.argmax(np.where(clear, np.sqrt(often) * (1 - near), -1))))
    middles = main[heads]
    for _ in range(20):
        group = np.argmax(main @ middles.T, axis=1)
        sums = (np.eye(len(heads))[group] * (often * clear)[:, None]).T @ main
        length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        middles = np.where(length > 0, sums / np.maximum(length, 1e-9), middles)
    return {w: int(g) + 1 for w, g, ok in zip(anchors, group, clear, strict=True) if ok}


class Words(NamedTuple):
    """Words with the kinds of text they stand in."""

    words: list[bytes]
    kinds: np.ndarray


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[Words | np.ndarray, np.ndarray]]:
    """The words, then the first bytes of a batch of units, each with counts."""
    kinds = np.asarray(batch.column(0))
    units, n = listed(batch.column(1)), np.asarray(batch.column(2)).astype(float)
    at = np.flatnonzero(kinds <= KINDS)
    if len(at):
        yield Words([units[i] for i in at.tolist()], kinds[at]), n[at]
    at = np.flatnonzero(kinds == FIRST)
    if len(at):
        yield np.array([int.from_bytes(units[i], "big") for i in at.tolist()], dtype=np.int64), n[at]


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256)
    for batch in batches:
        for units, n in _parts(batch):
            if isinstance(units, Words):
                raw, starts, lengths = _laid(units.words)
                total += np.bincount(raw[runs_to_index(starts + 1, lengths)], weights=np.repeat(n, lengths), minlength=256)
            else:
                total += np.bincount(units & 0xFF, weights=n, minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])


def _weighed(units: Words | np.ndarray, n: np.ndarray, code: Code) -> Iterator[tuple[Decisions, np.ndarray]]:
    """The units' decisions, ``AT_ONCE`` steps of words or so at a time, each with its count."""
    if not isinstance(units, Words):
        d = first_decisions(units, code)
        yield d, n[d.unit]
        return
    steps = word_steps(*units)
    counts = np.bincount(steps.step, weights=n[steps.word], minlength=len(steps.symbols))
    for at in range(0, len(counts), AT_ONCE):
        d = steps.decisions(code, slice(at, at + AT_ONCE))
        yield d, counts[at : at + AT_ONCE][d.unit]


def _together(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The batches, some joined to about ``rows``: more words that begin alike."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(map(len, some)) >= rows:
            yield pa.concat_batches(some)
            some = []
    if some:
        yield pa.concat_batches(some)


def _fill(code: Code):
    """A worker's counts of zeros and ones by slot, as the filled places of blocks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 << code.slot_bits)
        for batch in _together(batches):
            for units, n in _parts(batch):
                for d, weight in _weighed(units, n, code):
                    for slots in d.slots:
                        np.add.at(table, slots * 2 + d.bit, weight)
        blocks = table.reshape(-1, 1 << BLOCK_BITS)
        for at in range(0, len(blocks), 64):
            some = [(b, np.flatnonzero(blocks[b])) for b in range(at, min(at + 64, len(blocks)))]
            some = [(b, i) for b, i in some if len(i)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in some], pa.int32()), pa.array([i.astype("<u2").tobytes() for _, i in some], pa.binary()), pa.array([blocks[b][i].astype("<f8").tobytes() for b, i in some], pa.binary())],
                names=["block", "at", "n"],
            )

    return of


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total.setdefault(b, np.zeros(1 << BLOCK_BITS))[np.frombuffer(at, dtype="<u2")] += np.frombuffer(n, dtype="<f8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in total.values()], pa.binary())], names=["block", "n"])


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))


def _seen(total: np.ndarray) -> np.ndarray:
    """0 for nothing, 1 for one, 2 for two or three, 3 for four to seven, ..."""
    return np.minimum(np.log2(total + np.float32(1)) + np.float32(1e-6), SEEN - 1).astype(np.uint8)


def _gate(place: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return place.astype(np.int32) * SEEN + seen


def _step(logit: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(logit, -8, 8) + 8) * ((STEPS - 1) / 16)).astype(np.int32)


def _learn(shared, code: Code):
    """A worker's online pass: (what, at, value, weight) of gated weights (0) and of observed ones by step (1)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        w = np.full((GATES, CONTEXTS), FIRST_WEIGHT)
        squares = np.zeros_like(w)
        mass = np.zeros(GATES)
        ones, all_ = np.zeros(GATES * STEPS), np.zeros(GATES * STEPS)
        for batch in batches:
            for units, n in _parts(batch):
                for d, weight in _weighed(units, n, code):
                    own = d.bit.astype(np.float32)
                    x, total = [], None
                    for slots in d.slots:  # without the occurrence that is predicted
                        zeros, one = np.maximum(table[slots * 2] - (1 - own), 0), np.maximum(table[slots * 2 + 1] - own, 0)
                        x.append(_odds(zeros, one))
                        if len(x) == SURE + 1:
                            total = zeros + one
                    gate = _gate(d.place, _seen(total))
                    logit = sum(w[gate, k] * x[k] for k in range(CONTEXTS))
                    step = gate * STEPS + _step(logit)
                    ones += np.bincount(step, weights=weight * own, minlength=len(ones))
                    all_ += np.bincount(step, weights=weight, minlength=len(ones))
                    error = weight * (own - 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
                    size = np.bincount(gate, weights=weight, minlength=GATES)
                    for k in range(CONTEXTS):
                        g = np.bincount(gate, weights=error * x[k], minlength=GATES) / np.maximum(size, 1)
                        squares[:, k] += g * g
                        w[:, k] += RATE * g / np.sqrt(squares[:, k] + 1e-4)
                    mass += size
        out = [(0, i, float(w.flat[i]), float(mass[i // CONTEXTS])) for i in range(w.size)] + [(1, i, float(ones[i]), float(all_[i])) for i in range(len(ones)) if all_[i]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["what", "at", "value", "weight"])

    return of


class Model(NamedTuple):
    """What scoring needs of the corpus; of a fixed size. ``odds`` are in steps; ``weights`` are by context and gate, for a step."""

    code: Code
    odds: np.ndarray
    seen: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    def log_probabilities(self, d: Decisions, units: int) -> np.ndarray:
        """The natural log probability of each unit."""
        gate = _gate(d.place, np.take(self.seen, d.slots[SURE]))
        logit = np.zeros(len(gate), dtype=np.float32)
        for k in range(CONTEXTS):
            logit += np.take(self.weights[k], gate) * np.take(self.odds, d.slots[k])  # in steps of ODDS_STEP, as the weights are
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        p = np.clip((p + np.take(self.refined, gate * STEPS + _step(logit))) / 2, 1e-7, 1 - 1e-7)
        return np.bincount(d.unit, weights=np.log(np.where(d.bit, p, 1 - p)), minlength=units)


def train(units: DataFrame, workers: int, slot_bits: int = SLOT_BITS) -> Model:
    """The model of the counted ``units``. The driver gets two numbers a slot and the workers' weights, summed."""
    spark = units.sparkSession
    dealt = units.coalesce(workers)
    counts = dealt.mapInArrow(_byte_counts, "byte long, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect()  # 256 rows
    by_byte = np.zeros(256)
    for r in counts:
        by_byte[r["byte"]] = r["n"]
    code = prefix_code(by_byte, slot_bits)
    table = np.zeros(2 << slot_bits, dtype=np.float32).reshape(-1, 1 << BLOCK_BITS)
    filled = dealt.mapInArrow(_fill(code), "block int, at binary, n binary").repartition("block").mapInArrow(_sum_blocks, "block int, n binary")
    for r in filled.toLocalIterator():
        table[r["block"]] = np.frombuffer(r["n"], dtype="<f4")
    table = table.reshape(-1)
    shared = spark.sparkContext.broadcast(table)  # two numbers for each of a fixed count of slots
    learned = dealt.mapInArrow(_learn(shared, code), "what int, at int, value double, weight double").groupBy("what", "at")
    learned = learned.agg(F.sum(F.col("value") * F.col("weight")).alias("mean"), F.sum("value").alias("value"), F.sum("weight").alias("weight")).collect()  # GATES * (CONTEXTS + STEPS) rows at most
    shared.destroy()
    weights = np.full((GATES, CONTEXTS), FIRST_WEIGHT)
    middle = 1 / (1 + np.exp(-(np.arange(STEPS) / ((STEPS - 1) / 16) - 8)))
    ones, all_ = np.zeros(GATES * STEPS), np.zeros(GATES * STEPS)
    for r in learned:
        if r["what"]:
            ones[r["at"]], all_[r["at"]] = r["value"], r["weight"]
        elif r["weight"]:
            weights.flat[r["at"]] = r["mean"] / r["weight"]
    refined = (ones + 4 * np.tile(middle, GATES)) / (all_ + 4)
    steps = np.clip(np.rint(_odds(table[::2], table[1::2]) / ODDS_STEP), -127, 127).astype(np.int8)
    return Model(code, steps, _seen(table[::2] + table[1::2]), np.ascontiguousarray(weights.T * ODDS_STEP, dtype=np.float32), refined.astype(np.float32))


def document_scores(lp: np.ndarray, earlier: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log probabilities of texts of ``n`` tokens each, from those of the tokens by corpus.

    ``earlier`` tells how often a token came before in its text, whose share of the past is the other
    prediction. The weight of that one starts at ``OWN_SHARE``, which counts as ``OWN_WEIGHT`` tokens, and
    follows what it was worth in the blocks before. Block b of all texts is worked on at once.
    """
    starts = np.cumsum(n) - n
    place = np.arange(len(lp)) - np.repeat(starts, n)
    with np.errstate(divide="ignore"):
        past = np.log(earlier / np.maximum(place, 1))
    out = np.zeros(len(n))
    order = np.argsort(-n, kind="stable")
    share = np.full(len(n), OWN_SHARE)
    worth = np.zeros(len(n))
    lengths = n[order]
    for at in range(0, int(n.max(initial=0)), BLOCK):
        active = order[: np.searchsorted(-lengths, -at, side="left")]
        index = starts[active, None] + at + np.arange(BLOCK)
        inside = at + np.arange(BLOCK) < n[active, None]
        index[~inside] = 0
        own = np.log(share[active])[:, None] + past[index]
        both = np.logaddexp(own, np.log1p(-share[active])[:, None] + lp[index])
        out[active] += np.where(inside, both, 0).sum(axis=1)
        worth[active] += np.where(inside, np.exp(own - both), 0).sum(axis=1)
        seen = np.minimum(at + BLOCK, n[active])
        share[active] = (OWN_WEIGHT * OWN_SHARE + worth[active]) / (OWN_WEIGHT + seen + 1)
    return out


class _Held(Vocabulary):
    """Words met, with their counts where they are frequent and, by kind of text, log probabilities."""

    def __init__(self, model: Model, frequent: dict[bytes, int], groups: dict[bytes, int]):
        self.model, self.frequent = model, frequent
        self.heads, self.firsts = np.zeros(0, dtype=np.int64), np.zeros(0)
        super().__init__(groups)

    def clear(self) -> None:
        super().clear()
        self.lp, self.count = np.zeros((0, KINDS + 1), dtype=np.float32), np.zeros(0, dtype=np.int64)

    def ids(self, words: pa.DictionaryArray) -> tuple[np.ndarray, list[bytes]]:
        ids, fresh = super().ids(words)
        self.lp = np.concatenate([self.lp, np.full((len(fresh), KINDS + 1), np.nan, dtype=np.float32)])
        self.count = np.concatenate([self.count, np.fromiter(map(self.frequent.get, fresh, repeat(-1)), dtype=np.int64, count=len(fresh))])
        return ids, fresh

    def rest(self, words: pa.DictionaryArray, ids: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Log probabilities of all but the first bytes."""
        held, at = self.lp.reshape(-1), ids * (KINDS + 1) + kinds
        lp = np.take(held, at)
        missing = np.flatnonzero(np.isnan(lp))
        if len(missing):
            _, some = np.unique(at[missing], return_index=True)
            missing = missing[some]
            for a in range(0, len(missing), 50_000):
                some = missing[a : a + 50_000]
                held[at[some]] = self.decided(listed(words.dictionary.take(words.indices.take(pa.array(some)))), kinds[some])
            lp = np.take(held, at)
        return lp

    def decided(self, words: list[bytes], kinds: np.ndarray) -> np.ndarray:
        steps = word_steps(words, kinds)
        lp = np.zeros(len(steps.symbols))
        for a in range(0, len(lp), SCORED_AT_ONCE):
            some = slice(a, a + SCORED_AT_ONCE)
            lp[some] = self.model.log_probabilities(steps.decisions(self.model.code, some), len(lp[some]))
        return np.bincount(steps.word, weights=lp[steps.step], minlength=len(words))

    def first(self, keys: np.ndarray) -> np.ndarray:
        place, every = pd.factorize(keys)
        new = np.sort(np.setdiff1d(every, self.heads, assume_unique=True))
        if len(new):
            at = np.searchsorted(self.heads, new)
            self.heads = np.insert(self.heads, at, new)
            self.firsts = np.insert(self.firsts, at, self.model.log_probabilities(first_decisions(new, self.model.code), len(new)))
        return self.firsts[np.searchsorted(self.heads, every)][place]


_ROWS = "uid long, doc_id long, n_tokens long, n_known long, base double, score double, bytes long, rare array<struct<word:string,n:long>>"


def _score(model, frequent, groups: dict[bytes, int], ends: int, base_of):
    """The result rows of texts but for the words that are not frequent, which come along with their counts."""

    def one(batch: pa.RecordBatch, held: _Held) -> pa.RecordBatch:
        texts = batch.column(2)
        words, n = tokens(texts)
        ids, _ = held.ids(words)
        keys, is_word = held.keys(ids, n)
        kinds = kinds_before(held.group[ids], n)
        lp = held.first(kinds << 24 | keys)
        lp[is_word] += held.rest(words, ids, kinds[is_word])
        text = np.repeat(np.arange(len(texts)), n)
        order = np.argsort(text * (len(held.known) + 1) + ids, kind="stable")  # equal words of a text stay in their order
        new = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (text[order][1:] != text[order][:-1])]) if len(ids) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([head, [len(ids)]]))
        earlier = np.zeros(len(keys))
        before = np.zeros(len(ids))
        before[order] = np.arange(len(ids)) - np.repeat(head, sizes)
        earlier[is_word] = before
        scores = document_scores(lp, earlier, n + 1) / np.log(10)
        count = held.count[ids]
        common = count >= 0
        base = np.bincount(text[common], weights=base_of(count[common]), minlength=len(texts)) + base_of(ends)
        known = np.bincount(text[common], minlength=len(texts)) + (ends > 0)
        rare = head[held.count[ids[order[head]]] < 0]
        at = order[rare]  # by text
        offsets = np.searchsorted(text[at], np.arange(len(texts) + 1)).astype(np.int32)
        uncommon = words.dictionary.take(words.indices.take(pa.array(at))).cast(pa.string())
        counted = pa.StructArray.from_arrays([uncommon, pa.array(sizes[np.searchsorted(head, rare)], pa.int64())], names=["word", "n"])
        lists = pa.ListArray.from_arrays(pa.array(offsets), counted)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(scores), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), lists],
            names=["uid", "doc_id", "n_tokens", "n_known", "base", "score", "bytes", "rare"],
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(model.value, dict(frequent.value), groups)
        for batch in batches:
            if batch.num_rows:
                yield one(batch, held)
            if len(held.known) > HELD_WORDS:
                held.clear()

    return of


def language_scores(docs: DataFrame, folds: int = 5, held: int = 1, slot_bits: int = SLOT_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of ``docs``.

    The model and the counts come from the rows outside the held fold, by crc32 of doc_id as text; a null
    doc_id is not held out. A null or empty text is one end; ``bits_per_byte`` (of the text's UTF-8) is
    null for it. Rows that repeat a doc_id are texts of their own, each learned from and scored; equal
    texts have equal scores. Without rows to learn from all counts are zero, and the base score is 0 by
    its formula. Texts of any length are read whole; an empty table gives no rows; other columns are left
    out, whatever their names.
    """
    spark = docs.sparkSession
    importable(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    out_of = F.coalesce(fold == held, F.lit(False))
    learned = docs.filter(~out_of)
    groups = word_groups(learned, frequent_words(learned))
    units = materialise(unit_counts(learned, groups))
    words = units.filter(F.col("kind") <= KINDS).groupBy(F.col("unit").cast("string").alias("word")).agg(F.sum("n").alias("c"))
    words = materialise(words)
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = units.filter(F.col("kind") == ENDS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    smooth = total + 0.5 * (distinct + 1)
    limit = max(1, total // FREQUENT)
    frequent = [(r["word"].encode(), r["c"]) for r in words.filter(F.col("c") > limit).collect()]  # at most FREQUENT
    model = train(units, partitions_for(units.count(), WORKER_UNITS), slot_bits)
    shared = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(frequent)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = materialise(rows.mapInArrow(_score(*shared, groups, ends, lambda c: np.log10((c + 0.5) / smooth)), _ROWS))
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.n")
    rare = rare.join(words.filter(F.col("c") <= limit), "word", "left")
    c = F.coalesce("c", F.lit(0))
    rest = rare.groupBy("uid").agg(F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(float(smooth)))).alias("more"), F.sum(F.when(c > 0, F.col("n"))).alias("met"))
    return scored.drop("rare").join(rest, "uid", "left").select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        F.when(F.col("bytes") > 0, -F.col("score") * np.log2(10.0).item() / F.col("bytes")).alias("bits_per_byte"),
    )
