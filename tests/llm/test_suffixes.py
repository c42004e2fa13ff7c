"""Two-stage suffix sorting beside plain sorting."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panoloom.llm import suffixes as sx

TEXT = st.text(alphabet="ab\x00é", max_size=40).map(str.encode)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.sampled_from([8, 11, 16]))
def test_order_and_repeats(strings, depth):
    text, start = sx.joined(strings, depth)
    n = len(text) - depth - 8
    order = sx.suffix_array(text, depth)
    assert sorted(order) == list(range(n))
    shown = []
    for p in order:
        end = p + int(np.argmin(text[p:]))            # up to the separator
        shown.append(bytes(text[p:end])[:depth])
    assert shown == sorted(shown)
    starts = [max(0, len(s) - depth + 1) for s in strings]
    seen = Counter(s[i:i + depth] for s, k in zip(strings, starts) for i in range(k))
    flags, classes = sx.repeated(strings, starts, depth)
    assert [list(f) for f in flags] == [[seen[s[i:i + depth]] > 1 for i in range(k)] for s, k in zip(strings, starts)]
    assert len(set(classes)) == len(seen)


@pytest.mark.parametrize("depth", [200])
def test_long_repeats(depth):
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 123, 900).astype(np.uint8))
    strings = [base[:600], b"x" + base[100:500] + b"y", b"z" * 500, base[650:], base[:600]]
    starts = [max(0, len(s) - depth + 1) for s in strings]
    seen = Counter(s[i:i + depth] for s, k in zip(strings, starts) for i in range(k))
    flags, _ = sx.repeated(strings, starts, depth)
    assert [list(f) for f in flags] == [[seen[s[i:i + depth]] > 1 for i in range(k)] for s, k in zip(strings, starts)]
