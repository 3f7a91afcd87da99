"""Phrases, vectors and lexical search against plain code: nulls, ties, copies, clashing columns, small bounds."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixtally.llm import lexical, neardup, phrases, vectors

# --- phrases ---


def plain_phrases(rows, least, top):
    f, n, cands = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q[i : i + k] for q, a in cands.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if a >= cands[q[i : i + k]]}
        rows = []
        for p, a in cands.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(3)
    words = ["The", "of", "été", "x\x01", " ", "a" * 50, "Zug", "und", "1", "-"]
    text = lambda n: "".join(f"{words[i]}{rng.choice([' ', '  ', chr(9), '. ', ', ', chr(10)], p=[.6, .1, .1, .1, .05, .05])}" for i in rng.integers(0, len(words), n) % rng.integers(1, 11, n))
    rows = [(["en", "de", None, "und"][k % 4], text(int(rng.integers(0, 120)))) for k in range(60)]
    return [*rows, *[("en", "the of the of the of")] * 30, ("en", None), (None, ""), ("fr", "seul"), ("de", text(40000))]


def test_phrases(spark, monkeypatch):
    """Both ways to hold the dictionary, and steps and ranges of a few words."""
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, word string, n int").repartition(5)
    want = plain_phrases(rows, 5, 30)
    assert len(want) > 50
    for step, sent in ((1 << 21, 1 << 20), (3000, 0)):
        monkeypatch.setattr(phrases, "STEP", step)
        got = sorted(map(tuple, phrases.collocations(df, least=5, top=30, sent_words=sent).collect()))
        assert got == want


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([("en", None), ("en", "lonely")], "lang string, text string")
    assert phrases.collocations(df).count() == phrases.collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    word = spark.createDataFrame([("en", "a", 9 * 10**15, 1), ("en", "b", 8 * 10**15, 2)], "lang string, word string, n long, id long")
    key = bytes([0, 0, 0, 1, 0, 0, 0, 2])
    got = phrases.scored(spark.createDataFrame([(bytearray(key), 7 * 10**15)], "key binary, a long"), word, spark.createDataFrame([("en", 9 * 10**17)], "lang string, n long")).first()
    assert got.score == 1000 * 7 * 10**15 * 9 * 10**17 // (9 * 10**15 * 8 * 10**15)


def test_radix_order():
    keys = np.random.default_rng(0).integers(0, 2**32, (5000, 5), dtype=np.uint64).astype(np.uint32)
    keys[::3, 0] = 7
    assert np.array_equal(keys[phrases.radix_order(keys)], keys[np.lexsort(keys.T[::-1])])


# --- vectors ---


def plain_search(rows, k, every):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked, out = set(), []
    for at, (i, v) in enumerate(ok):
        if i % every or (i, tuple(v)) in asked:
            continue
        asked.add((i, tuple(v)))
        got = [(-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), j) for n, (j, w) in enumerate(ok) if n != at and len(w) == len(v)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(got)[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_vectors(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(vectors, "PART", 50)
    monkeypatch.setattr(vectors, "STEP", 16)
    monkeypatch.setattr(vectors, "QUERY_BYTES", 400)
    monkeypatch.setattr(vectors, "HELD", 100)
    vec = lambda n: rng.normal(0, 0.2, n).astype(np.float32).tolist()
    rows = [(int(i), vec(8)) for i in range(300)]
    hot = vec(8)
    rows += [(int(i), hot) for i in range(300, 420)] + [(300, hot)] * 3 + [(10, vec(8)), (None, vec(8)), (20, None), (30, [1.0, None] * 4), (40, [float("nan")] * 8), (50, [float("inf")] * 8)]
    rows += [(60, vec(3)), (61, vec(3)), (70, []), (80, []), (90, [3e38] * 8), (91, [-3e38] * 8), (92, [1e-30, -0.0, *[0.0] * 6]), (-10, vec(8))]
    df = spark.createDataFrame([(*r, "x", 0.0) for r in rows], "vec_id long, embedding array<float>, qk string, score double").repartition(4)
    got = [tuple(r) for r in vectors.search(df, k=5, every=10).collect()]
    assert sorted(got) == plain_search(rows, 5, 10)


def test_vectors_of_nothing(spark):
    df = spark.createDataFrame([(50, [1.0]), (51, None)], "vec_id long, embedding array<float>")
    assert vectors.search(df).count() == vectors.search(df.limit(0)).count() == 0


# --- lexical search ---


def plain_ranked(docs, items, k):
    terms = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for at, (i, c) in enumerate(held):
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, i is None, i, at))
        out += [(item, r + 1, i, -s) for r, (s, _, i, _) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def test_lexical(spark, monkeypatch):
    """Copies beyond k, equal scores, null texts and ids, repeated items, several turns, small buffers."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(lexical, "HELD", 40)
    monkeypatch.setattr(lexical, "LIST", 16)
    words = [*"abcdefghij", "été", "Ünd", "x9"]
    text = lambda n: "".join(words[i] + rng.choice([" ", ". ", "-"]) for i in (rng.zipf(1.5, n) - 1) % len(words))
    docs = [(int(i), text(int(rng.integers(0, 60)))) for i in rng.permutation(200)] + [(1000 + i, "a b B c") for i in range(50)]
    docs += [(7, "j j j"), (7, "x9 é"), (None, "j x9"), (None, "a b c b"), (5000, None), (5001, ""), (5002, "..."), (5003, text(20000))]
    items = [(i, text(int(rng.integers(1, 12)))) for i in range(12)] + [(50, "A a B"), (50, "zzz"), (None, "j"), (51, None), (52, "x9 j Été")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item string, t int").repartition(6)
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, score int")
    order = lambda rows: sorted(rows, key=str)
    want = plain_ranked(docs, items, 7)
    for pairs in (1 << 18, 20):
        assert order(tuple(r) for r in lexical.search(d, b, k=7, pairs=pairs).collect()) == order(want)


def test_lexical_of_nothing(spark):
    d, b = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(d.limit(0), b).count() == lexical.search(d, b.limit(0)).count() == 0


# --- the screen of near-dedup ---


@pytest.mark.parametrize("n", [6, 7, 13, 20, 40, 100, 400])
def test_links_pass_bands_and_screen(n):
    """Pairs of sets at the threshold, by size: none of 20,000 is lost by the screen, and none shares no band."""
    rng, pairs = np.random.default_rng(n), 20000 if n < 100 else 2000
    less = next(k for k in range(n, 0, -1) if 100 * k < 85 * n) + 1  # of n shingles, a set without n - less is still linked
    code = rng.integers(0, 2**61, (pairs, n), dtype=np.uint64)
    row = np.repeat(np.arange(pairs), n)
    one = neardup.signatures(row, code.ravel(), pairs)
    two = neardup.signatures(np.repeat(np.arange(pairs), less), np.ascontiguousarray(code[:, :less]).ravel(), pairs)
    same = one == two
    low = ((one & np.uint64(255)) == (two & np.uint64(255))).mean(axis=1)
    assert (low >= neardup.LEAST_EQUAL[min(less, len(neardup.LEAST_EQUAL) - 1)]).all()
    assert same.reshape(pairs, neardup.BANDS, neardup.ROWS).all(axis=2).any(axis=1).all()
