"""What tasks leave in the workers that outlive them."""

import subprocess
import sys
from pathlib import Path

import pytest

from tailrace.llm import workers

ROOT = Path(__file__).resolve().parents[2]
# 24 MB of texts go through a task in a process of its own; it prints the MB that stay afterwards.
LEFT = """
import re, sys
import numpy as np, pyarrow as pa
from tailrace.llm import decontamination, jaccard, toxicity

def held():
    smaps = open("/proc/self/smaps_rollup").read()
    return sum(map(int, re.findall(r"\\nAnonymous:\\s+(\\d+)", smaps))) / 1024

def batches():
    rng = np.random.default_rng(1)
    for first in (0, 4000, 8000):
        texts = [" ".join(map(str, rng.integers(0, 9999, 400))) for _ in range(4000)]
        ids = pa.array(range(first, first + 4000), pa.int64())
        label = pa.array([0] * 4000, pa.int32())
        yield pa.RecordBatch.from_arrays([ids, label, pa.array(texts)], ["doc_id", "label", "text"])

tasks = {
    "counted": jaccard._counted,
    "prefixes": jaccard._prefixes(np.zeros(0, np.uint64), np.zeros(0, np.int64), 20, 24),
    "needed": jaccard._needed_sets(np.full(1 << 13, 255, np.uint8), 16),
    "training": toxicity._training_words,
}
before = held()
for _ in tasks[sys.argv[1]](batches()):
    pass
del _
print(held() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="memory is read from /proc")
@pytest.mark.parametrize("task", ["counted", "prefixes", "needed", "training"])
def test_tasks_give_back_memory(task):
    ran = subprocess.run([sys.executable, "-c", LEFT, task], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert float(ran.stdout) < 70, ran.stderr


def test_giving_back_passes_batches_and_runs_at_the_end(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda: calls.append("end"))

    @workers.giving_back
    def doubled(batches):
        for batch in batches:
            yield 2 * batch

    assert list(doubled(iter([1, 2]))) == [2, 4] and calls == ["end"]
    rest = doubled(iter([1, 2]))
    assert next(rest) == 2
    rest.close()  # a task that a limit ends
    assert calls == ["end", "end"]
