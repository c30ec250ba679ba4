"""Python workers keep little between partitions."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import ctypes, random, re
import pandas as pd
from bandloom.llm import packing, substrings
from bandloom.llm.catalogue import TOKENIZER

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def partition():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(250)) for _ in range(3000)]
    yield pd.DataFrame({"id": range(3000), "place": range(3000), "text": texts})

step = {"pack": lambda: packing._pieces(TOKENIZER, 4096, 1, False), "pieces": lambda: substrings._piece_rows(20, 6)}[STEP]
for _ in range(2):
    for _ in step()(partition()):
        pass
left = held()
ctypes.CDLL(None).malloc_trim(0)
print(left - held())
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read from /proc")
@pytest.mark.parametrize("step", ["pack", "pieces"])
def test_freed_memory_is_given_back(step):
    done = subprocess.run([sys.executable, "-c", f"STEP = {step!r}\n{RUN}"], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True)
    assert float(done.stdout) < 10
