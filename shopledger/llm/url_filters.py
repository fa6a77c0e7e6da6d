"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into multiword Shift-And masks: a bit for each place of each rule, a star
keeps its place. Each byte of a canonical URL moves the states of all rules at once, for all URLs of
a batch. A canonical URL is a dot, the host, a divider byte that no UTF-8 text has, and the path; so
``*.host`` fits the host and all its subdomains, and no star of a host can reach into a path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER

DIVIDER = b"\xff"
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: What judges a URL that no rule fits: globs over the path, first match first; else ``DEFAULT``.
FALLBACK = (("block", "*.exe"), ("block", "*.zip"), ("block", "*/login*"), ("block", "*/wp-admin/*"))
DEFAULT = "allow"
_LOWER = str.maketrans(UPPER, UPPER.lower())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for a null or a URL without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:at], rest[at:]
    at = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host.translate(_LOWER), path[:at]


def canonical(host: str, path: str) -> bytes:
    return b"." + host.encode("utf-8", "surrogatepass") + DIVIDER + path.encode("utf-8", "surrogatepass")


class GlobAutomaton:
    """Which globs (bytes; ``*`` any run, ``?`` one byte) fit whole strings."""

    def __init__(self, globs: list[bytes]):
        bits = sum(len(g.replace(b"*", b"")) + 1 for g in globs)
        self.words = max(1, -(-bits // 64))
        self.accepts = np.zeros((256, self.words), dtype=np.uint64)
        self.stays, self.starts = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.ends: list[int] = []
        at = 0
        for g in globs:
            self._set(self.starts, at)
            for byte in g:
                if byte == ord("*"):
                    self._set(self.stays, at)
                else:
                    for c in range(256) if byte == ord("?") else (byte,):
                        self._set(self.accepts[c], at)
                    at += 1
            self.ends.append(at)
            at += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << (bit % 64))

    def matches(self, strings: list[bytes]) -> np.ndarray:
        """A row for each string, a column for each glob."""
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        lengths = np.array([len(strings[i]) for i in order], dtype=np.int64)
        flat = np.frombuffer(b"".join(strings[i] for i in order) or b"\0", dtype=np.uint8)
        firsts = np.cumsum(lengths) - lengths
        state = np.tile(self.starts, (len(strings), 1))
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(lengths.max(initial=0))):
            on = int(np.searchsorted(-lengths, -step, side="left"))  # strings longer than step
            now = state[:on]
            moved = now & self.accepts[flat[firsts[:on] + step]]
            shifted = moved << one
            shifted[:, 1:] |= moved[:, :-1] >> top
            state[:on] = shifted | (now & self.stays)
        out = np.zeros((len(strings), len(self.ends)), dtype=bool)
        for k, bit in enumerate(self.ends):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one == one
        return out


def judge_urls(pages: DataFrame, rules=RULES, fallback=FALLBACK, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url).

    The longest rule that fits wins, and of equal ones the first; a null or odd url fits no rule
    and takes the default. Repeated rows give repeated results, an empty table none.
    """
    rules = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    star = lambda x: x.encode().replace(b"*", b"").replace(b"?", b"")  # noqa: E731  rules are plain
    globs = [b"*." + star(h) + DIVIDER + star(p) + b"*" for _, h, p in rules] + [b"*" + DIVIDER + g.encode() for _, g in fallback]
    automaton = GlobAutomaton(globs)
    verdicts = [v for v, *_ in (*rules, *fallback)] + [default]
    names = [h + p for _, h, p in rules] + [None] * (len(fallback) + 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            fits = automaton.matches([canonical(h, p) for h, p in parts])
            first = np.where(fits.any(axis=1), fits.argmax(axis=1), len(globs)) if len(parts) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], [names[i] for i in first], [verdicts[i] for i in first])]],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def oracle_sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " " + " ".join(f"WHEN path LIKE '{g.replace('*', '%')}' THEN '{v}'" for v, g in FALLBACK)
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE '{DEFAULT}' END AS verdict FROM c
"""
