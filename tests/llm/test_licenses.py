"""License scans beside full alignment of every template at every place."""

import random

import numpy as np
import pytest

from panoloom.llm import licenses
from panoloom.llm.license_texts import TEMPLATES


def found(df, **options):
    return sorted(tuple(r) for r in licenses.scan(df, **options).collect())


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = row[:], row
        for j, y in enumerate(b):
            row[j + 1] = max(row[j], old[j + 1], old[j] + (x == y))
    return row[-1]


def test_alignment_is_optimal_in_a_wide_band():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        pairs = licenses.align(np.array(a), np.array(b), -len(a), len(b))
        assert len(pairs) == longest(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_winnowing_leaves_no_gap():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 50, 500).astype(np.uint64)
    kept = licenses.winnowed(g)
    assert np.diff(np.concatenate([[-1], kept, [len(g)]])).max() <= licenses.WINDOW
    assert all(any(i <= k < i + licenses.WINDOW for k in kept) for i in range(len(g) - licenses.WINDOW + 1))


@pytest.mark.parametrize("k", range(len(TEMPLATES)))
def test_every_template_is_found_whole(documents, k):
    name, text = TEMPLATES[k]
    before = "Éa ß words come first. "
    rows = found(documents([(5, before + text.upper() + " and after"), (6, "nothing here")]))
    mine = [r for r in rows if r[1] == k]
    assert len(mine) == 1 and mine[0][0] == 5 and mine[0][2] == name and mine[0][6] == 1.0
    assert mine[0][3] == len(before)
    assert (before + text)[mine[0][3]:mine[0][4]].rstrip("./") == text.rstrip("./")     # a span ends with its last word


def test_edits_gaps_and_repeats(documents):
    text = TEMPLATES[3][1]
    words = text.split()
    edited = " ".join(w if i % 9 else "changed" for i, w in enumerate(words))
    half = " ".join(words[:len(words) // 2])
    rows = found(documents([(1, edited), (2, half), (3, TEMPLATES[0][1] + " x " + TEMPLATES[0][1]), (3, TEMPLATES[2][1])]))
    assert [(r[0], r[1]) for r in rows] == [(1, 3), (3, 0), (3, 0), (3, 2)]
    assert 0.8 <= rows[0][6] < 1


def test_real_documents(documents, real):
    rows = found(documents(real))
    lines = {t: k for k, (_, t) in enumerate(TEMPLATES)}
    want = sorted((d, lines[line]) for d, t in real for line in (t or "").split("\n") if line in lines)
    assert sorted((r[0], r[1]) for r in rows) == want


def test_corner_cases(documents):
    notice = TEMPLATES[2][1]
    rows = [(1, None), (2, ""), (3, "x" * 70_000), (4, "w " * 60_000 + notice), (7, notice), (7, notice), (8, "under the"), (9, notice[:20]), (10, notice[20:])]
    df = documents(rows).withColumnRenamed("lang", "license")
    assert [r[0] for r in found(df)] == [4, 7, 7]
    assert found(documents([])) == []
    assert found(df, templates=(("none", ""), ("short", "x"), ("null", None))) == []


HEADER = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free "
          "Software Foundation; either version {} of the License, or (at your option) any later version.")
BSD3 = TEMPLATES[8][1] + (" Neither the name of Acme Inc. nor the names of its contributors may be used to endorse or promote products "
                           "derived from this software without specific prior written permission.")
NEIGHBOURS = [
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under the GNU General Public License.", ["GPL"]),
    (HEADER.format("General Public License", "2"), ["GPL-2.0"]), (HEADER.format("General Public License", "3"), ["GPL-3.0"]),
    (HEADER.format("Lesser General Public License", "2.1"), ["LGPL-2.1"]), (HEADER.format("Library General Public License", "2"), ["LGPL-2.0"]),
    (HEADER.format("General Public License", "2").replace("program", "library"), ["GPL-2.0"]),
    (HEADER.format("Lesser General Public License", "2.1").replace("program", "library"), ["LGPL-2.1"]),
    (HEADER.format("Affero General Public License", "3"), ["AGPL-3.0"]),
    *((f"Licensed under CC {k} {v}.", [f"CC-{k}-{v}"]) for k in ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")),
    ("This work is licensed under a Creative Commons Attribution-Non-Commercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
    (BSD3, ["BSD-3-Clause"]), (TEMPLATES[8][1], ["BSD-2-Clause"]),
    ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]), ("Licensed under the Apache License 2.0.", ["Apache-2.0"]),
    (TEMPLATES[1][1], ["Apache-2.0"]), ("Released under the ISC License.", ["ISC"]), ("Released under the Foo License.", []),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.  If a copy of the MPL was not distributed with "
     "this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
    (TEMPLATES[0][1] + " " + TEMPLATES[2][1], ["Apache-2.0", "MIT"]), (TEMPLATES[3][1] + "\n" + BSD3, ["BSD-3-Clause", "MIT"]),
]


def test_neighbouring_licenses_and_versions(documents):
    rows = found(documents([(k, "Some words. " + t + " Others follow.") for k, (t, _) in enumerate(NEIGHBOURS)]))
    got = [sorted(r[2] for r in rows if r[0] == k) for k in range(len(NEIGHBOURS))]
    assert [(t, g) for (t, _), g in zip(NEIGHBOURS, got)] == NEIGHBOURS
