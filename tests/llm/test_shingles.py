import ctypes
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from tracklake.llm import shingles


def test_a_worker_keeps_one_table_of_powers():
    """Slices of different sizes take their powers from the largest table so far."""
    shingles.powers(1 << 10)
    large = shingles.powers((1 << 20) + 5)
    small = shingles.powers(1 << 10)
    assert all(np.shares_memory(a, b) for a, b in zip(small, large))
    up, down = shingles.powers((1 << 20) + 5)
    at = [0, 1, 2, 1000, (1 << 20) + 4]
    assert [int(up[k]) for k in at] == [pow(shingles.BASE, k, 1 << 64) for k in at]
    assert all(int(u) * int(d) & shingles.MASK == 1 for u, d in zip(up[at], down[at]))


def test_freed_memory_goes_back():
    """What a task has freed between blocks it holds doesn't stay with the worker when its batches end."""
    code = """
import os
import numpy as np
import pyarrow as pa
from tracklake.llm.columns import slices

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

batch = pa.record_batch([pa.array(["a b", None])], names=["text"])
list(slices(iter([batch]), 1 << 19))
before = resident()
blocks = [np.ones(12_000) for _ in range(2000)]
last = np.ones(100)
held = [bytearray(600) for _ in range(2000)]
del blocks
assert len(list(slices(iter([batch]), 1 << 19))) == 1
print(resident() - before)
"""
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("only glibc gives back")
    grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout
    assert int(grown) < 60
