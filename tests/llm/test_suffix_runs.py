"""Suffixes in order by groups and neighbours compared by runs: the same as by brute force, wherever groups and runs are cut."""

import random
from collections import Counter

import numpy as np
import pytest

from episodeframe.llm import suffix_dedup, suffix_sort


@pytest.mark.parametrize(("together", "compared"), [(1, 1), (3, 40), (1 << 12, 1 << 22)])
def test_repeats_by_runs(monkeypatch, together, compared):
    monkeypatch.setattr(suffix_sort, "TOGETHER", together)
    monkeypatch.setattr(suffix_sort, "COMPARED", compared)
    r = random.Random(together)
    for length in (1, 5, 8, 9, 20):
        base = bytes(r.choice(b"ab") for _ in range(150))
        bodies = [base[i : i + length + r.randrange(30)] for i in (r.randrange(90) for _ in range(6))] + [bytes(r.choice(b"abc") for _ in range(length + 5))] * 2
        times = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
        found = suffix_dedup.repeated_windows(bodies, length)
        assert [[i for a, b in ranges for i in range(a, b)] for ranges in found] == [[i for i in range(len(b) - length + 1) if times[b[i : i + length]] > 1] for b in bodies]
        text = np.frombuffer(b"\xff".join(bodies), np.uint8)
        order = suffix_sort.suffix_array(text, length)
        raw = text.tobytes()
        heads = [raw[i : i + length] for i in order]
        assert heads == sorted(heads)
        assert suffix_sort.common_to(text, order, length).tolist() == [False] + [a == b and len(a) == length for a, b in zip(heads, heads[1:])]


def test_a_byte_of_a_run_is_compared_once(monkeypatch):
    """Two copies of 2000 bytes: their 1801 windows are one run, however deep the windows are."""
    body = random.Random(2).randbytes(2000).replace(b"\xff", b"x")
    text = np.frombuffer(body + b"\xff" + body + b"\xff", np.uint8)
    order = suffix_sort.suffix_array(text, 200)
    asked = []
    monkeypatch.setattr(suffix_sort.np, "repeat", lambda *a, _repeat=np.repeat: asked.append(1) or _repeat(*a))
    # The separator after both copies agrees as well.
    assert suffix_sort.common_to(text, order, 200).sum() == 1802
    assert 0 < len(asked) < 20
