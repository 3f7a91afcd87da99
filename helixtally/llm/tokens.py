"""Token counts of a byte-level BPE, without ids: initial symbols minus merges.

A pre-token's merges are made with a heap of adjacent pairs and a doubly linked list of symbols: pop the pair of the
lowest rank (of equal ones, the leftmost), join it, and push the two new neighbours. Counts of pieces between single
spaces are kept in a bounded cache in each worker, so that a common word is merged once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Entries of a worker's cache; it starts afresh when full.
CACHE = 800_000
#: The pre-tokenizer's own pattern, which the vocabulary file names but does not hold.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Stands for a piece that cannot be counted by itself.
AWRY = 1 << 50


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next unused from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


def merges_of(sym: list[int], rank_of: Callable, made: list[int]) -> int:
    """How many merges a word's symbols (which it overwrites) go through.

    rank_of(left << 32 | right, -1) is the pair's rank, made[rank] the symbol it becomes.
    """
    n = len(sym)
    if n < 2:
        return 0
    rank = [rank_of(a << 32 | b, -1) for a, b in zip(sym, sym[1:])]  # of the pair that begins at i, -1: none
    heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
    if not heap:
        return 0
    rank.append(-1)
    left, right, done = list(range(-1, n - 1)), list(range(1, n + 1)), 0
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        i, r = x & 0xFFFFFFFF, x >> 32
        if rank[i] != r:
            continue  # the pair has gone since
        j = right[i]
        k = right[j]
        new = sym[i] = made[r]
        right[i], rank[j], done = k, -1, done + 1
        if k < n:
            left[k] = i
            rank[i] = r = rank_of(new << 32 | sym[k], -1)
            if r >= 0:
                push(heap, r << 32 | i)
        else:
            rank[i] = -1
        h = left[i]
        if h >= 0:
            rank[h] = r = rank_of(sym[h] << 32 | new, -1)
            if r >= 0:
                push(heap, r << 32 | h)
    return done


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.symbol = [vocab[x] for x in byte_letters()]
        ranks, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.rank_of = ranks.get
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = special
        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def word(self, w: str) -> int:
        n = self.words.get(w)
        if n is None:
            raw = w.encode("utf-8", "surrogatepass")
            symbol = self.symbol
            n = len(raw) - merges_of([symbol[b] for b in raw], self.rank_of, self.made)
            if len(self.words) >= CACHE:
                self.words.clear()
            if len(w) < 100:
                self.words[w] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text that holds no special string.

        Where every space stands alone between other characters, it belongs to the piece after it, and each piece can be
        counted by itself; other texts go through the pattern as a whole.
        """
        first, *rest = text.split(" ")
        if first and not first[-1].isspace() and rest:
            get, held = self.pieces.get, self.piece
            n = sum([get(p) or held(p) for p in rest])
            if n < AWRY:
                return n + sum(map(self.word, PATTERN.findall(first)))
        return sum(map(self.word, PATTERN.findall(text)))

    def piece(self, p: str) -> int:
        """Tokens of a piece and the space before it; AWRY if white space stands at either end."""
        n = AWRY if not p or p[0].isspace() or p[-1].isspace() else sum(map(self.word, PATTERN.findall(" " + p)))
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        if len(p) < 100:
            self.pieces[p] = n
        return n

    def __call__(self, text: str) -> int:
        if not any(x in text for x in self.special):
            return self.plain(text)
        between = self.split.split(text)
        return len(between) - 1 + sum(map(self.plain, between))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_batches(path: Callable[[], str], limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it):
        count = counter(path())
        for b in it:
            n = [count(t) for t in (x.as_py() or "" for x in b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def vocabulary_path(name: str) -> Callable[[], str]:
    """Finds the vocabulary file where the task runs."""

    def find() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return find


def token_counts(docs: DataFrame, path: Callable[[], str] | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id, text).

    A null or empty text has no bytes and no tokens; a null id and repeated rows stay as they are. Special strings of the
    vocabulary inside a text are one token each, as its tokenizer has them by default. Of equal ranks the leftmost pair is
    merged first. A very long text is one step of a task. Other columns of docs don't come out, so their names can't clash.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return slim.mapInArrow(count_batches(path or vocabulary_path(TOKENIZER), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
