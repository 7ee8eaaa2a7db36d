"""Alignment in bands against the whole table, and its memory on a long pair."""

import random
import subprocess
import sys

import numpy as np
import pytest

from foliant.operators import collate
from foliant.operators.collate import align_long, align_many, alignments


@pytest.mark.parametrize("cells", [1, 40, 300, 10_000])
def test_bands_equal_the_whole_table(cells):
    r = random.Random(cells)
    for n in (0, 1, 2, 17, 60, 211):
        for m in (0, 1, 3, 40, 190):
            for letters in ("ab", "abcdefgh"):
                a, b = (np.array([ord(r.choice(letters)) for _ in range(k)], np.uint32) for k in (n, m))
                if m > 20:  # a copy with edits, as pages have
                    b = np.array([c for c in a.tolist() if r.random() > 0.1] + [97] * r.randint(0, 4), np.uint32)
                ((i, j),) = align_many([a], [b])
                got = align_long(a, b, cells)
                assert np.array_equal(got[0], i) and np.array_equal(got[1], j)


def test_long_pairs_take_the_other_way_with_the_same_rows(spark, monkeypatch):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdé字") for _ in range(n))
    rows = [(k, t := text(r.randint(0, 120)), t[:30] + text(7) + t[35:]) for k in range(20)] + [(90, None, "a"), (91, "", ""), (92, "a", None)]
    pairs = spark.createDataFrame(rows, "id long, a string, b string")
    whole = sorted(alignments(pairs).collect(), key=str)
    monkeypatch.setattr(collate, "CELLS", 500)
    assert sorted(alignments(pairs).collect(), key=str) == whole


def test_thirty_thousand_characters_stay_under_half_a_gigabyte():
    code = (
        "import numpy as np, resource; from foliant.operators.collate import align_long\n"
        "r = np.random.default_rng(1); a = r.integers(97, 123, 30000).astype(np.uint32); b = np.delete(a, r.integers(0, 30000, 900)); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "i, j = align_long(a, b); both = (i >= 0) & (j >= 0); assert (a[i[both]] == b[j[both]]).sum() >= 29000 and len(set(i[i >= 0])) == 30000 and len(set(j[j >= 0])) == len(b)\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert float(out.stdout) < 500
