"""Repeats inside one document, found in parts, against plain code; and what they take in memory."""

import tracemalloc

import numpy as np
import pytest

from helixtally.llm import suffixes


def plain(raw):
    seen, flag = {}, np.zeros(len(raw), bool)
    for i in range(len(raw) - suffixes.WINDOW + 1):
        w = raw[i : i + suffixes.WINDOW].tobytes()
        if seen.setdefault(w, i) < i:
            flag[i : i + suffixes.WINDOW] = True
    return flag


def texts():
    rng = np.random.default_rng(12)
    word = lambda n, k=4: rng.integers(97, 97 + k, n).astype(np.uint8)
    long = word(700)
    yield np.tile(word(2), 900)
    yield np.tile(word(37), 50)
    yield np.zeros(1500, np.uint8)
    yield word(3000, 2)
    yield np.concatenate([long, word(300), long, word(10), long[100:400], long[350:], long[:99], long[:100], word(3), long[:101]])
    yield np.concatenate([np.append(long[k : k + 200], word(5)) for k in rng.integers(0, 500, 15)])
    yield np.concatenate([np.concatenate([word(60), long[:32], word(60)]) for _ in range(20)] * 2)  # one hot anchor
    yield word(99)
    yield word(100)
    yield word(0)


@pytest.mark.parametrize("part", [101, 333, 1 << 20])
def test_repeats_inside_a_document(monkeypatch, part):
    monkeypatch.setattr(suffixes, "PART", part)
    for raw in texts():
        flag = np.zeros(len(raw), bool)
        suffixes.inner_repeats(raw, flag)
        assert (flag == plain(raw)).all()


def test_memory_of_a_periodic_text():
    """64 MB of a text of two letters in turn: the peak is below 1 GB, and all but the first two windows repeat."""
    raw = np.tile(np.frombuffer(b"ab", np.uint8), 1 << 25)
    tracemalloc.start()
    flag = np.zeros(len(raw), bool)
    suffixes.inner_repeats(raw, flag)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not flag[:2].any() and flag[2:].all() and peak < 1 << 30
