"""Simple-8b word-aligned coding of token ids, vectorised over blocks.

A 64-bit word holds a selector in its upper 4 bits and as many values as its selector says in the
lower 60, the first value lowest. Values above 60 bits take an escape word, followed by the value as
it is. Each block of ids is coded by itself; its first word's place is stored, so that blocks
can be decoded alone and all blocks of a file at once.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: Fixed values: (ids in a word, bits of each), by selector.
SELECTORS = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
ESCAPE = 15
#: Blocks coded at once, for bounded memory.
AT_ONCE = 512
MAGIC = b"S8BTOK01"
HEADER = struct.Struct("<8sQQQQQ")
HEADER_BYTES = HEADER.size


_LENGTHS = np.array([v.bit_length() for v in range(1 << 16)], dtype=np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 61 standing for more than 60."""
    top = min(int(values.max(initial=0)).bit_length(), 61)
    if top <= 16:
        return _LENGTHS[values.astype(np.uint16)]
    bits = _LENGTHS[(values & np.uint64(0xFFF)).astype(np.uint16)]
    for at in range(12, top, 12):
        part = (values >> np.uint64(at)) & np.uint64(0xFFF) if at < 60 else np.minimum(values >> np.uint64(at), np.uint64(1))
        more = _LENGTHS[part.astype(np.uint16)]
        bits = np.where(more > 0, more + np.uint8(at), bits)
    return bits


def encode(ids: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and their number at the end)."""
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    values = np.zeros((blocks, block + SELECTORS[0][0]), dtype=np.uint64)
    padded = np.zeros(blocks * block, dtype=np.uint64)
    padded[:n] = ids
    values[:, :block] = padded.reshape(blocks, block)
    bits = _bit_lengths(values)

    # the widest value among the c from each place on, for the counts of the selectors
    widest = {1: bits}
    for count in sorted(c for c, _ in SELECTORS)[1:]:
        half = max(c for c in widest if 2 * c >= count and c < count)
        out = widest[half].copy()  # two windows of the next smaller count cover it
        shift = count - half
        out[:, :-shift] = np.maximum(out[:, :-shift], widest[half][:, shift:])
        widest[count] = out

    # what fits a selector fits all further ones, so the first that fits is the count of those that do not
    chosen = np.zeros((blocks, block), dtype=np.uint8)
    for count, width in SELECTORS:
        chosen += widest[count][:, :block] > width
    chosen[chosen == len(SELECTORS)] = ESCAPE
    counts = np.array([c for c, _ in SELECTORS] + [1, 1], dtype=np.int64)

    # follow the words of all blocks at once
    starts = np.zeros((blocks, block), dtype=bool)
    lengths = np.full(blocks, block, dtype=np.int64)
    lengths[-1] = n - (blocks - 1) * block
    row, place = np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    while len(row):
        starts[row, place] = True
        place = place + counts[chosen[row, place]]
        on = place < lengths[row]
        row, place = row[on], place[on]

    rows, places = np.nonzero(starts)
    selectors = chosen[rows, places].astype(np.int64)
    width_in_words = np.where(selectors == ESCAPE, 2, 1)
    ends = np.cumsum(width_in_words)
    at = ends - width_in_words
    words = np.zeros(int(ends[-1]), dtype=np.uint64)
    words[at] = selectors.astype(np.uint64) << np.uint64(60)
    flat, first = values.ravel(), rows * values.shape[1] + places
    for selector in np.unique(selectors[selectors != ESCAPE]).tolist():
        count, width = SELECTORS[selector]
        of = np.flatnonzero(selectors == selector)
        packed = np.zeros(len(of), dtype=np.uint64)
        for k in range(count):
            packed |= flat[first[of] + k] << np.uint64(k * width)
        words[at[of]] |= packed
    of = np.flatnonzero(selectors == ESCAPE)
    words[at[of] + 1] = values[rows[of], places[of]]
    firsts = np.searchsorted(rows, np.arange(blocks))
    return words, np.append(at[firsts], ends[-1]).astype(np.uint64)


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = 1024) -> np.ndarray:
    """The n ids of ``encode``'s result, as uint64."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(selectors == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    counts = np.array([c for c, _ in SELECTORS] + [1, 1], dtype=np.int64)[selectors]
    counts[raw] = 0
    before = np.concatenate([[0], np.cumsum(counts)])
    offsets = offsets.astype(np.int64)
    of_block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = before[:-1] - before[offsets[of_block]] + of_block * block
    inside = np.minimum(counts, np.minimum((of_block + 1) * block, n) - place)  # a block's last word may hold fewer
    for selector in np.unique(selectors[~raw & (selectors != ESCAPE)]).tolist():
        count, width = SELECTORS[selector]
        mask = np.uint64((1 << width) - 1)
        of = np.flatnonzero((selectors == selector) & ~raw)
        short = inside[of] < count
        for k in range(count):
            some = of if k < inside[of].min(initial=count) else of[~short | (inside[of] > k)]
            out[place[some] + k] = (words[some] >> np.uint64(k * width)) & mask
    of = np.flatnonzero((selectors == ESCAPE) & ~raw)
    out[place[of]] = words[of + 1]
    return out


@dataclass
class TokenFile:
    """One file: documents in order, their ids end to end."""

    doc_ids: np.ndarray  # int64
    known: np.ndarray  # bool; false where the doc_id is null
    lengths: np.ndarray  # int64
    ids: np.ndarray

    def to_bytes(self, block: int = 1024) -> bytes:
        parts = [encode(self.ids[at : at + AT_ONCE * block], block) for at in range(0, len(self.ids), AT_ONCE * block)]
        words = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, np.uint64)
        first = np.cumsum([0, *[len(w) for w, _ in parts]]).astype(np.uint64)
        offsets = np.concatenate([*[o[:-1] + f for (_, o), f in zip(parts, first, strict=False)], first[-1:]])
        head = HEADER.pack(MAGIC, len(self.doc_ids), len(self.ids), block, len(offsets), len(words))
        parts = (self.doc_ids.astype("<i8"), self.known.astype("u1"), self.lengths.astype("<i8"), offsets.astype("<u8"), words.astype("<u8"))
        return head + b"".join(p.tobytes() for p in parts)

    @staticmethod
    def n_ids(header: bytes) -> int:
        """The count of ids that a file's first ``HEADER_BYTES`` bytes state."""
        magic, _, n, _, _, _ = HEADER.unpack_from(header)
        if magic != MAGIC:
            raise ValueError("not a token file")
        return n

    @staticmethod
    def from_bytes(data: bytes) -> TokenFile:
        magic, docs, n, block, n_offsets, n_words = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at, parts = HEADER.size, []
        for kind, count in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<u8", n_offsets), ("<u8", n_words)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        doc_ids, known, lengths, offsets, words = parts
        return TokenFile(doc_ids, known.astype(bool), lengths, decode(words, offsets, n, block))
