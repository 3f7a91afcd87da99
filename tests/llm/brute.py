"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def base_rules(text):
    t = text or ""
    w, lines, c = SPACED.findall(t), [x for x in t.split("\n") if SPACED.search(x)], collections.Counter()
    c.update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def shingles(text):
    w = SPACED.findall((text or "").translate(LOW))
    return frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(docs):
    sets, root = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def suffixes(docs):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for a in range(len(t) - 99):
            if t[a : a + 100] in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(t[a : a + 100])
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(t), sum(gone), spans, sha(bytes(x for x, g in zip(t, gone) if not g)))
    return out


def passages(docs):
    words, first, out = {d: SPACED.findall(t or "") for d, t in docs}, {}, {}
    for d in sorted(words):
        w = words[d]
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), d)
    for d, w in words.items():
        gone = {j for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < d for j in range(a, a + 50)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def leaks(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        if 0 < len(w) < 10:
            windows[tuple(w)].add(str(i))
        for a in range(len(w) - 9):
            windows[tuple(w[a : a + 10])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = ALNUM.findall((t or "").translate(LOW)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit.update(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def best_fit_bins(lengths, capacity=2048):
    """How many bins best fit in descending order takes, and the least that can be."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room), math.ceil(sum(lengths) / capacity)
