"""Token ids of whole texts by the ``tokenizers`` library, each distinct piece encoded once a worker.

A byte-level vocabulary cuts a text before its merges, and never joins what stands on both sides of
the start of white space that follows a visible character, nor a letter or digit and the
punctuation behind it. Texts are therefore cut at both, and each distinct piece is encoded by the
library itself and remembered. A text with white space outside ASCII is encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import runs_to_index

#: Ranges of characters that Unicode, an older version of it or Python counts as
#: white space outside the ASCII six, or that are drawn as nothing.
UNUSUAL_SPACE = (
    (0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x2029),
    (0x202F, 0x202F), (0x205F, 0x2060), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
)
_UNUSUAL_ARROW = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in UNUSUAL_SPACE) + "]"
_UNUSUAL = re.compile("[" + "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in UNUSUAL_SPACE) + "]")
#: Texts that are encoded at once: more cost memory, fewer time.
TEXTS_AT_ONCE = 200
#: A text with either is cut by Python, not by Arrow.
NOT_PLAIN = r"[ \t\n\r\v\f][ \t\n\r\v\f]|" + _UNUSUAL_ARROW
PIECE = re.compile(r"[ \t\n\r\v\f]*[^ \t\n\r\v\f]+|[ \t\n\r\v\f]+")
#: Begins a piece that stands as it is; other pieces follow a space, unless they begin a line.
AS_IS = "\x1f"
#: Punctuation between a letter or digit and white space or the end.
MARKS = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-/:-@\[-`{-~]+)( |$)"


def _concat(*arrays: pa.Array) -> pa.Array:
    return pa.concat_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays])


class CachedEncoder:
    """Encodes texts to one flat array of ids.

    Pieces are remembered in Arrow memory from batch to batch and task to task; beyond ``most_bytes``
    the memory is emptied, which costs time and changes no result.
    """

    #: How byte-level vocabularies write a space; pieces that are encoded at once.
    SPACE_BYTE, JOINED = "Ġ", 500

    def __init__(self, path: str, most_bytes: int = 12_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most_bytes = most_bytes
        self.after_space = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.after_space[i] = token.startswith(self.SPACE_BYTE)
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        #: Whether this vocabulary cuts before punctuation, as byte-level ones do.
        self.cuts_marks = all(whole(a + b) == whole(a) + whole(b) for a in ("a", "é", "Ōa", "7", " the") for b in (",", ".", '."', ");", "'", "-"))
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, new: pa.Array) -> None:
        """Encode pieces that are new: those after a space many at a time, the others singly.

        In joined pieces only a first token can begin with a space, so these tokens mark the
        pieces; should their count ever differ from the pieces', each is encoded by itself.
        """
        alone = pc.match_substring_regex(new, r"^$|^[\n\x1f]|[ \t\n\r\v\f]$").to_numpy(zero_copy_only=False)
        joined, single = np.flatnonzero(~alone), np.flatnonzero(alone).tolist()
        names = new.take(pa.array(joined)).to_pylist()
        groups = [slice(i, i + self.JOINED) for i in range(0, len(names), self.JOINED)]
        found = self.tokenizer.encode_batch_fast([" " + " ".join(names[g]) for g in groups], add_special_tokens=False)
        order, flat, lengths = [], [], []
        for g, encoding in zip(groups, found, strict=True):
            ids = np.array(encoding.ids, dtype=np.uint32)
            first = np.flatnonzero(self.after_space[ids])
            if len(first) != len(joined[g]):
                single += joined[g].tolist()
                continue
            order.append(joined[g])
            flat.append(ids)
            lengths.append(np.diff(np.append(first, len(ids))))
        texts = [p if p[:1] == "\n" else p[1:] if p[:1] == AS_IS else " " + p for p in new.take(pa.array(single, pa.int64())).to_pylist()]
        singly = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        order.append(np.array(single, dtype=np.int64))
        flat.append(np.array([i for ids in singly for i in ids], dtype=np.uint32))
        lengths.append(np.array([len(ids) for ids in singly], dtype=np.int64))
        self.known = _concat(self.known, new.take(pa.array(np.concatenate(order))))
        self.flat = np.concatenate([self.flat, *flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(lengths))])

    @staticmethod
    def _cut(text: str) -> list[str]:
        if _UNUSUAL.search(text):
            return [AS_IS + text]
        return [p[1:] if p[0] == " " and p[1:2] != "\n" else AS_IS + p for p in PIECE.findall(text)]

    def _places(self, pieces: pa.Array, first: int) -> np.ndarray:
        """Each distinct piece's place among the known ones from ``first`` on, else -1; the known ones are looked up in the pieces, of which fewer need a hash table."""
        found = pc.index_in(self.known.slice(first), value_set=pieces)
        places = np.full(len(pieces), -1, dtype=np.int64)
        places[found.drop_null().to_numpy()] = first + np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        return places

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """Each piece's place among the known ones, after learning those that are new."""
        own = pieces.dictionary_encode()
        at = self._places(own.dictionary, 0)
        if (at < 0).any():
            first = len(self.known)
            self._learn(own.dictionary.filter(pa.array(at < 0)))
            at = np.maximum(at, self._places(own.dictionary, first))
        return at[own.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array | list, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, their count by text); ``end_id`` ends each text if given."""
        if self.known.nbytes + self.flat.nbytes > self.most_bytes:
            self._forget()
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, NOT_PLAIN).to_numpy(zero_copy_only=False)
        plain = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n")
        if self.cuts_marks:
            plain = pc.replace_substring_regex(plain, MARKS, r"\1 \x1f\2\3".replace(r"\x1f", AS_IS))
        even = pc.binary_join_element_wise(pa.scalar(AS_IS, pa.large_string()), plain, pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(even, " ")
        cut = [self._cut(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        codes = self._codes(_concat(lists.flatten(), pa.array([p for c in cut for p in c], pa.large_string())))
        del plain, even  # the ids are about to take as much
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        counts[odd] = [len(c) for c in cut]
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        firsts = np.zeros(len(texts), dtype=np.int64)
        firsts[order] = np.concatenate([[0], np.cumsum(counts[order])])[:-1]
        codes = codes[runs_to_index(firsts, counts)]
        lengths = np.diff(self.ends)[codes]
        ids = self.flat[runs_to_index(self.ends[codes], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        by_text = np.diff(sums[np.concatenate([[0], np.cumsum(counts)])])
        if end_id is None:
            return ids, by_text
        ended = np.full(len(ids) + len(texts), end_id, dtype=np.uint32)
        ended[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), by_text)] = ids
        return ended, by_text + 1


def release() -> None:
    """Give Arrow's free memory back, after each slice of texts: an executor's other tasks need it."""
    pa.default_memory_pool().release_unused()


@lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    """This worker's encoder for a vocabulary file."""
    return CachedEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
