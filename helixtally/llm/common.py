"""What the operators share: tables, checkpoints, and vectorised word and byte fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from helixtally.functions.arrow import STEP_BYTES, buffers, steps  # noqa: F401  for the operators
from helixtally.sources.store import discard, scratch, settle, stored  # noqa: F401  for the operators

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a sum of products depends on all of them."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


#: Runs are fingerprinted by polynomials over the field of integers modulo this prime: modulo 2 ** 64, regular texts of two
#: letters would collide whatever the base.
PRIME = (1 << 61) - 1
BASE, WORD_BASE = 0xA342543DE82EF95, 0x761D6478BD642F9
_P, _LOW, _31, _32, _61 = U64(PRIME), U64((1 << 31) - 1), U64(31), U64(32), U64(61)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it."""
    low = U64(0xFFFFFFFF)
    a1, a0, b1, b0 = a >> _32, a & low, b >> _32, b & low
    middle, least = a1 * b0 + a0 * b1, a0 * b0
    x = ((a1 * b1) << U64(3)) + (middle >> U64(29)) + ((middle & U64((1 << 29) - 1)) << _32) + (least & _P) + (least >> _61)
    return reduced(x)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo PRIME, for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size, made = 1 << max(12, (n - 1).bit_length()), []
        for b in (base, pow(base, -1, PRIME)):
            p, k = np.ones(size, U64), 1
            while k < size:
                p[k : 2 * k], k = product(p[:k], U64(pow(b, k, PRIME))), 2 * k
            made.append(p)
        if size > 2 * STEP_BYTES:  # for one long document only
            return tuple(made)
        _powers[base] = tuple(made)
    return _powers[base]


def prefix_sums(codes: np.ndarray, base: int) -> np.ndarray:
    """sums[i]: the weighted sum of the first i codes (bytes, or numbers below PRIME); see grams."""
    p = powers(base, len(codes) + 1)[0][: len(codes)]
    if codes.dtype == np.uint8 and len(codes) < 1 << 22:
        c = codes + U64(1)
        high, low = (p >> _31) * c, (p & _LOW) * c
    else:
        t = product(codes.astype(U64) + U64(codes.dtype == np.uint8), p)
        high, low = t >> _31, t & _LOW
    high, out = reduced(np.cumsum(high)), np.zeros(len(codes) + 1, U64)
    out[1:] = reduced((high >> U64(30)) + ((high & U64((1 << 30) - 1)) << _31) + reduced(np.cumsum(low)))
    return out


def grams(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the runs start..end, which depend on nothing but the codes in them."""
    inverse = powers(base, len(sums))[1]
    return mix(product(reduced(sums[end] + (_P - sums[start])), inverse[start]) + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def fixed_grams(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k bytes (a power of two from 8 on), by doubling: cheap, for choosing places."""
    x, size = data.astype(U64), 1
    while size < 8 and len(x) > size:
        x, size = x[:-size] | x[size:] << U64(8 * size), 2 * size
    while size < k and len(x) > size:
        x = x[:-size] * U64(0x9FB21C651E98DF25) + x[size:] * U64(0xD6E8FEB86659FD93)
        x, size = x ^ (x >> U64(29)), 2 * size
    return mix(x) if size == k else x[:0]


def designated(gram: np.ndarray, ends: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): each run of k + w - 1 units has one anchor, the first of its least k-grams; an anchor's runs
    start from `first` to `last`. Equal runs have their anchors at the same place. gram, ends: as for `selected`.
    """
    bits = U64(max(20, len(gram).bit_length()))
    least = sliding(gram >> bits << bits | np.arange(len(gram), dtype=U64), w, np.minimum)
    at = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    start = np.flatnonzero(np.arange(len(at)) + (k + w - 1) <= ends[: len(at)])
    at = at[start]
    new = np.append(True, at[1:] != at[:-1])[: len(at)]
    return at[new], start[new], start[np.append(new[1:], True)[: len(at)]]


def once(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Places of the first of each pair (row, code)."""
    order = np.lexsort((code, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (code[order][1:] != code[order][:-1])
    return np.sort(order[new])


class Words:
    """Words of a run of documents: start, end (in bytes), doc (row), first (word at which a row starts), code."""

    def __init__(self, data: np.ndarray, off: np.ndarray, wordly: np.ndarray):
        inside = wordly[data]
        new = np.zeros(len(data) + 1, bool)
        new[off] = True
        before = np.empty_like(inside)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
        self.start = np.flatnonzero(inside & (~before | new[:-1]))
        after = np.empty_like(inside)
        if len(data):
            after[-1], after[:-1] = False, inside[1:]
        self.end = np.flatnonzero(inside & (~after | new[1:])) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.bytes = prefix_sums(data, BASE)
        self.code = grams(self.bytes, BASE, self.start, self.end) & U64(PRIME >> 1)
        self.sums = prefix_sums(self.code, WORD_BASE)

    def grams(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return grams(self.sums, WORD_BASE, start, end)


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op (minimum or maximum) over each run of w values, by doubling."""
    if len(x) < w:
        return x[:0]
    out, size = x, 1
    while 2 * size <= w:
        out, size = op(out[:-size], out[size:]), 2 * size
    n = len(x) - w + 1
    return op(out[:n], out[w - size : w - size + n]) if size < w else out


def selected(gram: np.ndarray, ends: np.ndarray, k: int, w: int) -> np.ndarray:
    """Starts of the k-grams that are the least of some run of w neighbours in one document (all of them, on a tie).

    gram[i]: of the k units from i; ends[i]: the unit at which i's document ends. Two equal runs of k + w - 1 units
    select the same k-grams inside them, wherever they stand.
    """
    least = sliding(gram, w, np.minimum)
    at = np.arange(len(least))
    whole = at + k + w - 1 <= ends[: len(least)]
    if not whole.any():
        return at[:0]
    held = np.zeros(len(gram) + w - 1, U64)
    held[w - 1 : w - 1 + len(least)] = np.where(whole, least, 0)
    return np.flatnonzero((sliding(held, w, np.maximum) == gram) & (gram > 0))


def whole_groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by a long `key`."""
    held = None
    for b in it:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        keys = held["key"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None:
        yield held.combine_chunks()
