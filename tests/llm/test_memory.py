"""What a Python task holds besides its rows."""

import ctypes
import tracemalloc

import numpy as np
import psutil
import pytest

from quietlake.llm import common
from quietlake.llm import paragraph_dedup as P


def test_a_block_is_compared_in_bounded_memory():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 40, 40)) for _ in range(200)]
    sets = [np.unique(np.append(base[i % 200], rng.integers(0, 1 << 40, i % 7))) for i in range(1024)]
    tracemalloc.start()
    edges = P.forest(list(range(1024)), sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(edges) == 824  # each base has one class
    assert peak < 30_000_000  # 1024 x 1024 numbers of 4 bytes, as they are and once more, and their columns


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="not glibc")
def test_freed_memory_goes_back():
    process = psutil.Process()
    held = [bytearray(1000) for _ in range(100_000)]
    last = held[-1]  # what is above stays, so that the rest is not given back by itself
    del held
    before = process.memory_info().rss
    common.release()
    assert len(last) == 1000 and before - process.memory_info().rss > 50_000_000
