"""Words of many documents at once beside plain Python, and the memory they take meanwhile."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from panoloom.llm import words as wd


def texts_of(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(["word", "ÄRGER", "Éa", " ", " ", ", ", "\n", "7"]) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_slices_change_no_word(monkeypatch):
    texts = [*texts_of(300), "", "x" * 5000 + " end"]
    column = pa.array([None, *texts], pa.string()).slice(1)                    # an array that begins inside its buffers

    def found():
        return [(w.first + int(d), w.data[s:e].tobytes().decode(), int(h)) for w in wd.words(column, wd.LETTERS) for d, s, e, h in zip(w.doc, w.start, w.end, w.hash)]
    whole = found()
    assert [x[:2] for x in whole] == [(i, m) for i, t in enumerate(texts) for m in re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())]
    monkeypatch.setattr(wd, "WORD_BYTES", 200)
    assert found() == whole


def test_memory_follows_the_slice():
    """No more than the words of a slice are held; lower-casing does not copy the whole batch."""
    column = pa.array([("some words of a text " * 50)] * 8000, pa.string())      # 8 MB
    next(iter(wd.words(column.slice(0, 500), wd.LETTERS)))                       # powers are kept
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    most = 0
    for w in wd.words(column, wd.LETTERS):
        most = max(most, pa.total_allocated_bytes() - before)
        assert len(np.unique(w.doc)) == len(w.offsets) - 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 << 20
    assert most < 4 << 20
