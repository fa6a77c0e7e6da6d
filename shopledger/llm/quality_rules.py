"""Quality rules: simple counts of each text, and lines that too many documents of a host share.

Lines are normalised and hashed; each host's documents that hold a line are counted, copies of one
text once; lines above the host's limit are removed, and a document that loses too much is
rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
#: A line is common in a host if more than so many of its texts hold it; in the verdicts' SQL, more than both.
LINE_TEXTS = 20
#: A document is depleted below both: words that remain, and their share of its words.
LEAST_WORDS, LEAST_SHARE = 10, 0.3
#: Common lines, and texts with lines to cut, go to all tasks up to so many; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
#: Common lines in more texts than this are joined without a shuffle.
HOT_TEXTS = 10_000
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def repeated_words(words: list) -> int:
    """Words inside any window of five that the text holds twice or more."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    numbers = {w: i for i, w in enumerate(set(words), 1)}
    if len(numbers) == len(words):
        return 0
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        keys = reduce(lambda a, j: (a ^ (a >> np.uint64(31))) * _MIX[j] + ids[j : j + n], range(1, REPEAT_WINDOW), ids[:n] * _MIX[0])
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + REPEAT_WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text has none."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = raw.translate(_SPACES).count(b" ")
    seen: set = set()
    n_dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n_dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(text) - spaces, sum(text.count(c) for c in SYMBOLS), n_dup, repeated_words(words)


def normalised_lines(text: str | None) -> dict[bytes, int]:
    """Words of each distinct line that has any; lower-cased, single spaces, digits as zeros."""
    out: dict[bytes, int] = {}
    for line in (text or "").lower().encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if words:
            key = re.sub(rb"[0-9]+", b"0", b" ".join(words))
            out[key] = out.get(key, 0) + len(words)
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for at in range(0, len(batch), 1000):
            some = batch.slice(at, 1000)
            texts = some.column(0).to_pylist()
            lines = [normalised_lines(t) for t in texts]
            counts = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
            pairs = [[{"line": xxhash.xxh3_64_intdigest(k) - (1 << 63), "n": n} for k, n in own.items()] for own in lines]
            yield pa.RecordBatch.from_arrays(
                [*[some.column(i) for i in range(1, some.num_columns)], *[pa.array(counts[:, j]) for j in range(5)], pa.array(pairs, pa.list_(pa.struct([("line", pa.int64()), ("n", pa.int64())])))],
                names=[*some.schema.names[1:], *[x.split()[0] for x in BASE.split(", ")], "lines"],
            )


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit(""))


def _profiled(docs: DataFrame, host: str) -> DataFrame:
    rows = docs.select("text", F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), _host(host).alias("host"), F.xxhash64("text").alias("copy"))
    return materialise(rows.mapInArrow(_profile, f"uid long, doc_id long, host string, copy long, {BASE}, lines array<struct<line:long,n:long>>"))


def _common(profiled: DataFrame) -> DataFrame:
    """(host, line, texts) of the lines that are common in their host: over LINE_TEXTS of its distinct texts hold them."""
    texts = profiled.groupBy("host", "copy").agg(F.first("lines").alias("lines"))
    lines = texts.select("host", F.explode("lines").alias("x")).groupBy("host", F.col("x.line").alias("line")).agg(F.count("*").alias("texts"))
    return materialise(lines.filter(F.col("texts") > LINE_TEXTS).select("host", "line", "texts"))


def _holding(lines: DataFrame, common: DataFrame) -> DataFrame:
    """The rows of ``lines`` (host, line, ...) whose line is common.

    A small common table goes to all tasks. Of a larger one, the lines that many texts hold do, if
    these are few, so that none of them gathers its texts in one task; the others are shuffled.
    """
    small = lambda df: df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = common.select("host", "line")
    if small(keys):
        return lines.join(F.broadcast(keys), ["host", "line"])
    hot = common.filter(F.col("texts") > HOT_TEXTS).select("host", "line")
    if not small(hot):
        return lines.join(keys, ["host", "line"])
    cold = lines.join(F.broadcast(hot), ["host", "line"], "left_anti").join(keys, ["host", "line"])
    return lines.join(F.broadcast(hot), ["host", "line"]).unionByName(cold)


def _verdicts(profiled: DataFrame, common: DataFrame) -> DataFrame:
    lost = profiled.select("uid", "host", F.explode("lines").alias("x")).select("uid", "host", F.col("x.line").alias("line"), F.col("x.n").alias("n"))
    lost = _holding(lost, common).groupBy("uid").agg(F.sum("n").alias("lost"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (left < LEAST_WORDS) | (left < LEAST_SHARE * F.col("n_words"))
    return (
        profiled.drop("lines")
        .join(lost, "uid", "left")
        .withColumns({"base_failed": failed, "kept": ~failed & ~depleted})
        .select("uid", "host", "copy", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    )


def quality_verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the five counts, base_failed and kept, with a row number ``uid`` of each row.

    A null text has no words and fails; a null host is a host of its own; a null doc_id is judged like
    any other; repeated rows get repeated results, and their text counts once; an empty table gives no
    rows; a line at a limit is not above it; other columns, whatever their names, are left out.
    """
    profiled = _profiled(docs, host)
    return _verdicts(profiled, _common(profiled)).drop("host", "copy")


def cut_lines(text: str, common: set[int]) -> str:
    """``text`` without the lines whose normal form's hash is in ``common``."""
    import xxhash

    normal = text.lower().encode("utf-8", "surrogatepass").split(b"\n")
    key = lambda line: xxhash.xxh3_64_intdigest(re.sub(rb"[0-9]+", b"0", b" ".join(line.split()))) - (1 << 63)
    return "\n".join(line for line, n in zip(text.split("\n"), normal, strict=True) if not n.strip() or key(n) not in common)


def _cut(docs: DataFrame, profiled: DataFrame, common: DataFrame, host: str) -> DataFrame:
    texts = profiled.groupBy("host", "copy").agg(F.first("lines").alias("lines"))
    own, cut = unused(docs, "of"), unused(docs, "cut")
    held = _holding(texts.select("host", "copy", F.explode("lines.line").alias("line")), common)
    held = materialise(held.groupBy(F.struct("host", "copy").alias(own)).agg(F.collect_list("line").alias(cut)))
    few = held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    key = F.col(own)
    rows = docs.join(F.broadcast(held) if few else held, (_host(host) == key["host"]) & (F.xxhash64("text") == key["copy"]), "left")
    columns = docs.columns
    text_at, cut_at = columns.index("text"), len(columns)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(i) for i in range(cut_at)]
            own = batch.column(cut_at).to_pylist()
            new = [cut_lines(t, set(lines)) if lines else t for t, lines in zip(arrays[text_at].to_pylist(), own, strict=True)]
            arrays[text_at] = pa.array(new, pa.string())
            if "n_chars" in columns:
                old = arrays[columns.index("n_chars")]
                arrays[columns.index("n_chars")] = pa.array([len(t) if lines else n for t, lines, n in zip(new, own, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return rows.select(*[F.col(f"`{c}`") for c in columns], cut).mapInArrow(of, docs.schema)


def without_common_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` with the lines that are common in their host cut out of ``text``; ``n_chars`` follows.

    Other lines keep their bytes and order; a null text stays; repeated rows stay repeated and count
    once; a null host is a host of its own; other columns stay, whatever their names; an empty table stays
    empty.
    """
    profiled = _profiled(docs, host)
    return _cut(docs, profiled, _common(profiled), host)


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep, without their host's common lines.

    The verdict follows from host and text, so rows of one doc_id are judged one by one, and rows
    without a doc_id like any others; repeated rows stay repeated; a null host is a host of its own; all
    other columns stay as they are, whatever their names; an empty table stays empty.
    """
    profiled = _profiled(docs, host)
    common = _common(profiled)
    rejected = materialise(_verdicts(profiled, common).filter(~F.col("kept")).select(F.struct("host", "copy").alias(unused(docs, "of"))).distinct())
    few = rejected.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    key = F.col(rejected.columns[0])
    good = docs.join(F.broadcast(rejected) if few else rejected, (_host(host) == key["host"]) & (F.xxhash64("text") == key["copy"]), "left_anti")
    return _cut(good, profiled, common, host)


#: The contract and the method's verdict in SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, '') AS host, text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, s, array_to_string(w[s:s + 4], ' ') AS run FROM (SELECT r, w, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) AS s FROM d WHERE len(w) > 4)),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(s, s + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, run) AS k FROM win) WHERE k > 1) GROUP BY r),
dup AS (
  SELECT r, sum(k - 1) AS n FROM (
    SELECT r, line, count(*) AS k FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY r),
t AS (SELECT DISTINCT host, text FROM d),
l AS (
  SELECT host, text, regexp_replace(array_to_string(x, ' '), '[0-9]+', '0', 'g') AS line, sum(len(x)) AS words FROM (
    SELECT host, text, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda y: y <> '') AS x FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS line FROM t))
  WHERE len(x) > 0 GROUP BY ALL),
c AS (SELECT host, line FROM l GROUP BY host, line HAVING count(*) > LINE_TEXTS),
lost AS (SELECT l.host, l.text, sum(words) AS n FROM l SEMI JOIN c ON l.host = c.host AND l.line = c.line GROUP BY ALL),
f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(coalesce(d.text, '')) - length(regexp_replace(coalesce(d.text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(w) - coalesce(lost.n, 0) AS rest
  FROM d LEFT JOIN rep ON rep.r = d.r LEFT JOIN dup ON dup.r = d.r LEFT JOIN lost ON lost.host = d.host AND lost.text = d.text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND rest >= LEAST_WORDS AND rest >= LEAST_SHARE * n_words AS kept
FROM f
""".replace("LINE_TEXTS", str(LINE_TEXTS)).replace("LEAST_WORDS", str(LEAST_WORDS)).replace("LEAST_SHARE", str(LEAST_SHARE))
