"""What an operator leaves in a worker when another one follows."""

import subprocess
import sys
from pathlib import Path

LEAVES = """
import re
import pyarrow as pa
from corpus_audit.llm.common import worker_cache

def held():
    text = open("/proc/self/smaps_rollup").read()
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", text))) // 1024

worker_cache("first")["pieces"] = list(range(1_000_000))
worker_cache("second")
before = held()
lists = [pa.array([{"score": 1.0, "ids": b"x" * 300}] * 5) for _ in range(40_000)]
full = held()
del lists
worker_cache("third")
print(before, full, held())
"""


def test_a_new_operator_returns_what_arrow_holds():
    run = subprocess.run([sys.executable, "-c", LEAVES], capture_output=True, text=True, timeout=120, check=True, cwd=Path(__file__).parents[2])
    before, full, after = map(int, run.stdout.split())
    assert full > before + 60 and after < before + 70
