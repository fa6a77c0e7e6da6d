"""Token files: whole texts as ids in Simple-8b files, in ascending doc_id order, and their reader."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch_dir
from .simple8b import HEADER_BYTES, TokenFile
from .tokens import TEXTS_AT_ONCE, encoder, release

MANIFEST = "path string, part int, number int, n_docs long, n_ids long"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, file_ids: int = 4_000_000, block: int = 1024) -> DataFrame:
    """Encode ``docs`` (doc_id, text) to files in ``folder``; returns their manifest, already written.

    Rows are range-sorted by doc_id; each task writes files of at least ``file_ids`` ids (the last one
    fewer) under names of their own, so a repeated or lost task leaves at most files that no
    manifest names. A null text has only the end id; rows of one doc_id stay together, ordered
    by text; a null doc_id comes first. An empty table gives an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            ids, known, lengths, tokens = (np.concatenate([h[i] for h in held]) for i in range(4))
            held = []
            path = f"{root}/part-{part:05d}-{number:05d}-{uuid.uuid4().hex}.s8b"
            with store.open_output_stream(path) as out:
                out.write(TokenFile(ids, known, lengths, tokens).to_bytes(block))
            number += 1
            return pa.RecordBatch.from_pydict(
                {"path": [path], "part": pa.array([part], pa.int32()), "number": pa.array([number - 1], pa.int32()), "n_docs": [len(ids)], "n_ids": [len(tokens)]}
            )

        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                tokens, lengths = encoder(vocabulary).encode(some.column(1), end_id)
                doc = some.column(0)
                known = doc.is_valid().to_numpy(zero_copy_only=False)
                held.append((doc.fill_null(0).to_numpy(zero_copy_only=False), known, lengths, tokens))
                if sum(len(h[3]) for h in held) >= file_ids:
                    yield flush()
                release()
        if held:
            yield flush()
            release()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(write, MANIFEST))


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    The manifest only says which files count and in which order. ``start`` is the count of ids in all
    documents before it, from the files' headers. Each task opens one file at a time. A null doc_id is
    read back as null, rows of one doc_id each for itself; an empty manifest gives no rows.
    """

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(folder)
        for frame in frames:
            sizes = []
            for path in frame["path"]:
                with store.open_input_file(path) as source:
                    sizes.append(TokenFile.n_ids(source.read(HEADER_BYTES)))
            yield frame.assign(n_ids=sizes)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(folder)
        for frame in frames:
            for path, first in zip(frame["path"], frame["first"], strict=True):
                with store.open_input_file(path) as source:
                    file = TokenFile.from_bytes(source.read())
                ids = file.ids.astype("<u4")
                ends = np.cumsum(file.lengths)
                sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, file.lengths, strict=True)]
                doc_ids = pd.array(file.doc_ids.tolist(), dtype="Int64")
                doc_ids[~file.known] = pd.NA
                yield pd.DataFrame({"doc_id": doc_ids, "start": first + ends - file.lengths, "n_tokens": file.lengths, "ids_crc32": np.array(sums, dtype=np.int64)})

    # offsets are known before the files are opened, so no decoded row is joined
    spread = max(4, 2 * manifest.sparkSession.sparkContext.defaultParallelism)
    named = manifest.select("path", "part", "number").repartition(spread, "path")
    sized = materialise(named.mapInPandas(measure, "path string, part int, number int, n_ids long"))
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    files = sized.select("path", "part", F.coalesce(before, F.lit(0)).alias("in_part"))
    parts = sized.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(earlier, F.lit(0)).alias("earlier"))  # a row for each task that wrote
    rows = files.join(parts, "part").select("path", (F.col("earlier") + F.col("in_part")).alias("first"))
    return rows.repartition(spread, "path").mapInPandas(read, DECODED)


def token_file_digest(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` (doc_id, text) to token files in the shared folder and return what the files hold.

    Nulls, repeated rows, empty texts and empty tables as in ``write_token_files``; texts of any
    length are one document of one file; other columns, whatever their names, are left out.
    """
    folder = scratch_dir(docs.sparkSession)
    return read_token_files(folder, write_token_files(docs, folder, vocabulary, end_id))
