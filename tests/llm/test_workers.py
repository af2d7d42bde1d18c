"""What Python workers hold, while they work and afterwards."""

import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.wordbytes import words
from tessera.llm.workers import freeing, freeing_group


def test_words_of_a_long_column_are_hashed_in_little_memory():
    column = pa.array(["word another words " * 100] * 2000)  # 3.8 MB
    next(words(pa.array(["x " * 100_000]))).hashes()  # the tables of powers are kept
    tracemalloc.start()
    total = sum(len(part.hashes(lower=True)) for part in words(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 2000 * 300 and peak < 16 << 20


def _resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_memory_goes_back_at_the_end_of_a_task():
    last = []

    def task(batches):
        for _ in batches:
            held = [np.ones(8000) for _ in range(3000)]  # 190 MB in pieces that the C allocator keeps
            last.append(held[-1])  # and the end of its heap is in use
            yield held[0].sum()

    def held_by(run):
        before = _resident()
        assert list(run(iter([None]))) == [8000]
        return _resident() - before

    assert held_by(freeing(task)) < 60 << 20 < held_by(task)
    assert freeing_group(lambda x: x + 1)(1) == 2


def test_tasks_travel_without_the_package(tmp_path):
    """A worker on a cluster has no install of the package."""
    import subprocess

    from pyspark import cloudpickle

    (tmp_path / "task").write_bytes(cloudpickle.dumps(freeing(lambda batches: batches)))
    read = f"import pickle; print(list(pickle.load(open({str(tmp_path / 'task')!r}, 'rb'))(iter([1]))))"
    out = subprocess.run([sys.executable, "-c", read], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip() == "[1]", out.stderr
