"""A passage that very many documents hold, each with words of its own around it."""

import brute
import numpy as np
import pytest

from helixtally.llm import passages, suffixes


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(21)
    words = lambda n: " ".join(f"{''.join(rng.choice(list('abcdefghijkl'), 5))}" for _ in range(n))
    passage, near = words(60), words(30)
    out = {k: f"{words(40)} {passage} {words(40)}" for k in range(24)}
    out |= {k: f"{words(40)} {near} {passage} {words(40)}" for k in range(24, 30)}
    other = words(60)
    return out | {k: f"{words(40)} {other} {words(40)}" for k in (30, 31)} | {32: words(100)}


@pytest.mark.parametrize("module, order, want", [(passages, "remove_passages", brute.passages), (suffixes, "remove_substrings", brute.suffixes)])
def test_contexts_of_a_hot_anchor(spark, rows, monkeypatch, module, order, want):
    monkeypatch.setattr(suffixes, "BLOCK", 5)  # its group is split into several blocks, which are merged
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in getattr(module, order)(docs).collect()}
    plain = want(list(rows.items()))
    assert {d: r.n_removed for d, r in got.items()} == {d: p[1] for d, p in plain.items()}
    assert {d: r.kept_sha256 for d, r in got.items()} == {d: (p[3] if module is suffixes else brute.sha(p[2])) for d, p in plain.items()}
    assert sum(p[1] > 0 for p in plain.values()) == 30


def test_blocks_are_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "BLOCK", 10)
    blocks = np.repeat(np.arange(40), np.random.default_rng(1).integers(1, 9, 40))
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], ["block"]) for x in np.array_split(blocks, 7)]
    seen = [t["block"].to_numpy() for t in suffixes.blocks_of(iter(batches))]
    assert np.concatenate(seen).tolist() == blocks.tolist()
    assert all(a[-1] != b[0] for a, b in zip(seen, seen[1:], strict=False)) and max(map(len, seen)) < 40


def test_contexts_are_fetched_in_parts(monkeypatch):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("block", pa.int64()), ("key", pa.int64()), ("split", pa.bool_()), ("code", pa.int64()), ("ctx", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("lo", pa.int64())]))
    text = "".join(chr(97 + k % 26) for k in range(3000))
    wanted = [[{"block": 1, "key": 2, "split": False, "code": k, "ctx": k, "at": k % 3, "n": 1 + k % 5, "lo": 7 * k} for k in range(50)], [], [{"block": 1, "key": 2, "split": True, "code": 99, "ctx": 9, "at": 0, "n": 2, "lo": 5}]]
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5, 6]), pa.array([text, None, text[::-1]]), pa.array(wanted, kind)], ["id", "text", "wanted"])
    for size in (1 << 26, 500):
        monkeypatch.setattr(suffixes, "FETCH", size)
        parts = list(suffixes.fetch_batches(iter([batch])))
        rows = [r for b in parts for r in b.to_pylist()]
        assert len(parts) == 1 if size > 500 else len(parts) > 5
        assert [r["first"] for r in rows] == [4] * 50 + [6]
        for r, w in zip(rows, wanted[0] + wanted[2], strict=True):
            source = text if r["first"] == 4 else text[::-1]
            assert r["bytes"].decode() == source[w["lo"] + w["at"] :][: w["n"] + 99] and r["code"] == w["code"]
