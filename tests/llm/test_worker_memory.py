"""A worker process serves the pipeline's stages one after the other: what it holds must not add up."""

import pathlib
import subprocess
import sys

import pytest

_WORKER = """
import random, re
from pathlib import Path
import pyarrow as pa
from tidemark.llm import packing, quality_rules, shared
from tidemark.llm.chunks import vocabulary

def mb(kind):
    return int(re.search(kind + r":\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

rng = random.Random(5)
def texts():
    for _ in range(4):
        rows = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(40_000):x}" for _ in range(500)) for _ in range(1_000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(rows)], names=["doc_id", "text"])

def served(made):
    return sum(batch.num_rows for batch in made)

path = vocabulary("byte_bpe_50k.json")
assert served(quality_rules._measured(texts(), "text", ["doc_id"])) == 4_000
before = mb("RssAnon")
Path("/proc/self/clear_refs").write_text("5")
start = mb("VmHWM")
assert served(packing._pieces(texts(), path, 1, 2048, False)) >= 4_000
peak = mb("VmHWM") - start
assert served(quality_rules._measured((b for b in list(texts())[:1]), "text", ["doc_id"])) == 1_000
print(peak, mb("RssAnon") - before)
"""


@pytest.mark.skipif(not pathlib.Path("/proc/self/clear_refs").exists(), reason="reads memory from /proc")
def test_memory_of_packing_is_bounded_and_given_back():
    top = pathlib.Path(__file__).parents[2]
    run = subprocess.run([sys.executable, "-c", _WORKER], cwd=top, capture_output=True, text=True, timeout=300, check=True)
    peak, stays = map(float, run.stdout.split()[-2:])
    assert peak < 220 and stays < 80, (peak, stays)
