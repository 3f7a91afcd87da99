"""Restriction enzymes, strands and marker hashes as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from helixtally.functions.arrow import buffers

N = "[ACGT]"


@dataclass(frozen=True)
class Enzyme:
    enzyme_id: int
    name: str
    tag_length: int
    patterns: tuple[str, ...]

    @property
    def regex(self) -> str:
        return "|".join(self.patterns)


def _e(enzyme_id: int, name: str, length: int, *motifs: str) -> Enzyme:
    return Enzyme(enzyme_id, name, length, motifs)


# The recognition sites of the sixteen type-IIB enzymes.
ENZYMES = (
    _e(1, "CspCI", 33, "[ACGT]{11}CAA[ACGT]{5}GTGG[ACGT]{10}", "[ACGT]{10}CCAC[ACGT]{5}TTG[ACGT]{11}"),
    _e(2, "AloI", 27, "[ACGT]{7}GAAC[ACGT]{6}TCC[ACGT]{7}", "[ACGT]{7}GGA[ACGT]{6}GTTC[ACGT]{7}"),
    _e(3, "BsaXI", 27, "[ACGT]{9}AC[ACGT]{5}CTCC[ACGT]{7}", "[ACGT]{7}GGAG[ACGT]{5}GT[ACGT]{9}"),
    _e(4, "BaeI", 28, "[ACGT]{10}AC[ACGT]{4}GTA[CT]C[ACGT]{7}", "[ACGT]{7}G[AG]TAC[ACGT]{4}GT[ACGT]{10}"),
    _e(5, "BcgI", 32, "[ACGT]{10}CGA[ACGT]{6}TGC[ACGT]{10}", "[ACGT]{10}GCA[ACGT]{6}TCG[ACGT]{10}"),
    _e(6, "CjeI", 28, "[ACGT]{8}CCA[ACGT]{6}GT[ACGT]{9}", "[ACGT]{9}AC[ACGT]{6}TGG[ACGT]{8}"),
    _e(7, "PpiI", 27, "[ACGT]{7}GAAC[ACGT]{5}CTC[ACGT]{8}", "[ACGT]{8}GAG[ACGT]{5}GTTC[ACGT]{7}"),
    _e(8, "PsrI", 27, "[ACGT]{7}GAAC[ACGT]{6}TAC[ACGT]{7}", "[ACGT]{7}GTA[ACGT]{6}GTTC[ACGT]{7}"),
    _e(9, "BplI", 27, "[ACGT]{8}GAG[ACGT]{5}CTC[ACGT]{8}"),
    _e(10, "FalI", 27, "[ACGT]{8}AAG[ACGT]{5}CTT[ACGT]{8}"),
    _e(11, "Bsp24I", 27, "[ACGT]{8}GAC[ACGT]{6}TGG[ACGT]{7}", "[ACGT]{7}CCA[ACGT]{6}GTC[ACGT]{8}"),
    _e(12, "HaeIV", 27, "[ACGT]{7}GA[CT][ACGT]{5}[AG]TC[ACGT]{9}", "[ACGT]{9}GA[CT][ACGT]{5}[AG]TC[ACGT]{7}"),
    _e(13, "CjePI", 27, "[ACGT]{7}CCA[ACGT]{7}TC[ACGT]{8}", "[ACGT]{8}GA[ACGT]{7}TGG[ACGT]{7}"),
    _e(14, "Hin4I", 27, "[ACGT]{8}GA[CT][ACGT]{5}[ACG]TC[ACGT]{8}", "[ACGT]{8}GA[CGT][ACGT]{5}[AG]TC[ACGT]{8}"),
    _e(15, "AlfI", 32, "[ACGT]{10}GCA[ACGT]{6}TGC[ACGT]{10}"),
    _e(16, "BslFI", 25, "[ACGT]{6}GGGAC[ACGT]{14}", "[ACGT]{14}GTCCC[ACGT]{6}"),
)
NOT_RECOMMENDED = ("HaeIV", "Hin4I")
RECOMMENDED = tuple(e for e in ENZYMES if e.name not in NOT_RECOMMENDED)


def enzyme(name: str) -> Enzyme:
    """By name in any case, else by numeric id."""
    key = name.strip()
    for e in ENZYMES:
        if e.name.lower() == key.lower() or (key.isdigit() and e.enzyme_id == int(key)):
            return e
    raise ValueError(f"unknown enzyme: {name!r}")


def enzyme_set(spec: str) -> list[Enzyme]:
    """`all`, `recommended`, or a comma list, in which duplicates stay: each digests once more."""
    if spec.strip().lower() == "all":
        return list(ENZYMES)
    if spec.strip().lower() == "recommended":
        return list(RECOMMENDED)
    found = [enzyme(x) for x in spec.split(",") if x.strip()]
    if not found:
        raise ValueError("no enzyme given")
    return found


def reverse_complement(seq: Column) -> Column:
    """Of upper-case bases; other characters stay as they are."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(tag: Column) -> Column:
    """The lesser of a tag and its reverse complement, in upper case."""
    up = F.upper(tag)
    return F.least(up, reverse_complement(up))


UPPER = np.arange(256, dtype=np.uint8)
UPPER[0x61:0x7B] -= 32
COMPLEMENT = np.arange(256, dtype=np.uint8)
COMPLEMENT[[65, 67, 71, 84]] = [84, 71, 67, 65]
#: Bases that are matched at once, so that a very long sequence takes no more memory than a short one.
CHUNK = 1 << 18


def motif(pattern: str) -> list[tuple[int, str]]:
    """(place, bases) of the places of a pattern that not every base fits."""
    out, at = [], 0
    for bases, times, letter in re.findall(r"\[([ACGT]+)\](?:\{(\d+)\})?|([ACGT])", pattern):
        size = int(times) if times else 1
        if bases != "ACGT":
            out += [(at + i, bases or letter) for i in range(size)]
        at += size
    return out


def one_of(x: np.ndarray, bases: str) -> np.ndarray:
    """For each byte of x, whether it is one of these bases: compared one by one, which is faster than a set."""
    out = x == ord(bases[0])
    for b in bases[1:]:
        out |= x == ord(b)
    return out


class Cutter:
    """Finds the sites of enzymes in many sequences at once, by comparing whole arrays of bases at the motifs' places."""

    def __init__(self, enzymes, letters: tuple[str, str] | None = None):
        """letters: characters, and the bases that they stand for (ASCII)."""
        bases = UPPER.copy()
        if letters:
            bases[np.frombuffer(letters[0].encode(), np.uint8)] = np.frombuffer(letters[1].encode(), np.uint8)
        self.bases = bases.tobytes()
        self.enzymes = [(e.enzyme_id, e.tag_length, [motif(p) for p in e.patterns]) for e in enzymes]

    def sites(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(enzyme_id, row, place in the row, tags as rows of bytes) of the sequences at off[i]..off[i + 1], in steps.

        Overlaps count; each enzyme gives a row at a place, whichever of its patterns fit.
        """
        most = max((n for _, n, _ in self.enzymes), default=1)
        for at in range(0, len(data), CHUNK):
            x = np.frombuffer(data[at : at + CHUNK + most - 1].tobytes().translate(self.bases), np.uint8)
            fits: dict[str, np.ndarray] = {}
            good = one_of(x, "ACGT")
            bad = None if good.all() else np.concatenate([[0], np.cumsum(~good)])
            for enzyme_id, size, patterns in self.enzymes:
                n = min(CHUNK, len(x) - size + 1)
                if n <= 0:
                    continue
                hit = np.zeros(n, bool)
                for p in patterns:
                    here = np.ones(n, bool)
                    for place, bases in p:
                        if bases not in fits:
                            fits[bases] = one_of(x, bases)
                        here &= fits[bases][place : place + n]
                    hit |= here
                start = np.flatnonzero(hit)
                if bad is not None:
                    start = start[bad[start + size] == bad[start]]
                row = np.searchsorted(off, start + at, "right") - 1
                inside = start + at + size <= off[row + 1]
                start, row = start[inside], row[inside]
                if len(start):
                    yield enzyme_id, row, start + at - off[row], x[start[:, None] + np.arange(size)]


def canonical_cells(tags: np.ndarray) -> np.ndarray:
    """The lesser of each tag and its reverse complement, as rows of bytes."""
    tags, other = np.ascontiguousarray(tags), np.ascontiguousarray(COMPLEMENT[tags][:, ::-1])
    text = lambda x: x.view(f"S{x.shape[1]}").ravel()
    return np.where((text(tags) <= text(other))[:, None], tags, other)


def _uint(s: pd.Series) -> np.ndarray:
    return s.to_numpy(dtype=np.int64, na_value=0).view(np.uint64)


@F.pandas_udf(LongType())
def fnv64(s: pd.Series) -> pd.Series:
    """64-bit FNV-1a of strings, as the signed number of the same bits; null of null."""
    data, off = buffers(pa.array(s, pa.string()))
    size, out = np.diff(off), np.full(len(s), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(-size, kind="stable")
    longer = len(s) - np.searchsorted(size[order][::-1], np.arange(int(size.max()) if len(s) else 0), "right")
    for k, n in enumerate(longer.tolist()):  # the n longest strings have a byte at k
        rows = order[:n]
        out[rows] = (out[rows] ^ data[off[rows] + k]) * np.uint64(0x100000001B3)
    return pd.Series(pd.arrays.IntegerArray(out.view(np.int64), s.isna().to_numpy()))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, of unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(LongType())
def splitmix64(s: pd.Series) -> pd.Series:
    """The finaliser that orders markers in sketches."""
    return pd.Series(mixed(_uint(s)).view(np.int64))


def unsigned_order(c: Column) -> Column:
    """A signed number that sorts as c's bits do without a sign."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def to_hex(marker: Column) -> Column:
    return F.lower(F.hex(marker))


def from_hex(text: Column) -> Column:
    """The marker of its hexadecimal text; null where it is none."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, -10).cast("long"))
