"""What a worker holds at once while it encodes texts, and batches of texts in the session."""

import os
import subprocess
import sys
from pathlib import Path

from shopledger.llm.common import importable

ROOT = str(Path(__file__).resolve().parents[2])
#: A worker that knows many pieces packs 1000 texts; prints by how many MB its memory rose.
WORKER = """
import random
from types import SimpleNamespace
import pyarrow as pa
from shopledger.llm import packing, tokens

packing.TaskContext = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))


def peak():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmHWM")).split()[1]) * 1024


rng = random.Random(3)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(200_000)]
tokens.encoder(tokens.default_vocabulary()).encode([" ".join(words)])
docs = pa.record_batch({"doc_id": pa.array(range(1000), pa.int64()), "text": [" ".join(rng.choices(words, k=700)) for _ in range(1000)]})
taken = SimpleNamespace(select=lambda *a: SimpleNamespace(mapInArrow=lambda cut, schema: cut))
packing.F = SimpleNamespace(col=lambda c: SimpleNamespace(cast=lambda k: None))
tokens.release()
open("/proc/self/clear_refs", "w").write("5")  # the peak counts from here
before = peak()
cut = packing.cut_documents(taken, tokens.default_vocabulary(), 2048, 0)
rows = sum(len(b) for b in cut(iter([docs])))
print(rows, (peak() - before) // 1_000_000)
"""


def test_a_worker_that_knows_many_pieces_packs_in_little_memory():
    out = subprocess.run([sys.executable, "-c", WORKER], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True, timeout=120)
    rows, megabytes = map(int, out.stdout.split())
    assert rows >= 1000
    assert megabytes <= 31  # 38 when all known pieces were hashed for every 500 texts


def test_readers_hold_few_texts_at_once(spark):
    setting = "spark.sql.parquet.columnarReaderBatchSize"
    old = spark.conf.get(setting)
    try:
        spark.conf.unset(setting)
        importable(spark)
        assert spark.conf.get(setting) == "512"
        spark.conf.set(setting, "2000")  # a user's own choice stays
        importable(spark)
        assert spark.conf.get(setting) == "2000"
    finally:
        spark.conf.set(setting, old)
