"""Phrase collocation mining.

Words that occur often enough in a language get ids; all other words break pieces, as no candidate holds one. From each word
on, the ids of up to LONGEST words are packed into a key of fixed width, zeros after the end of the run. Keys are dealt to
ranges, radix-sorted and run-length counted: equal beginnings are neighbours, so that one sorted pass counts the phrases of
every length. Runs are summed within a step before they are dealt, and runs at the border of a range after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, buffers, discard, scratch, settle, stored, table

LONGEST, LEAST, COVER, TOP = 5, 100, 100, 2000
#: Bytes of an id in a key.
WIDTH = 4
#: Bytes of text that one step looks at, and words that a range of keys is meant to hold.
STEP, RANGE_WORDS = 1 << 21, 1 << 19
#: Ranges at most, and keys that are sampled for each, to place its border; the sample decides nothing else.
RANGES, SAMPLED = 1 << 15, 32
#: The dictionary goes to all tasks up to this many words and bytes; a larger one is joined with each document's words.
SENT_WORDS, SENT_BYTES = 1 << 20, 1 << 25
#: Parts of a language that are ranked by themselves first.
SALTS = 64

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORDLY = ~BREAK
WORDLY[[0x20, 0x09]] = False


def text_steps(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, lower-case bytes, offsets) of runs of rows of STEP bytes at most, or of one row."""
    data, off = buffers(b["text"])
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + STEP, "right")) - 1)
        yield i, j, LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        i = j


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, row, linked): every word, the row that it is in, and whether the next word stands in the same piece."""
    inside = WORDLY[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])[: len(data)]))
    end = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False)[: len(data)])) + 1
    row = np.searchsorted(off, start, "right") - 1
    piece = np.cumsum(BREAK[data])[start]
    linked = np.zeros(len(start), bool)
    linked[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    places = np.append(0, np.cumsum(end - start))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(data[inside])]), row, linked


def groups_of(lang: pa.Array) -> tuple[np.ndarray, list]:
    coded = lang.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def count_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each step."""
    for b in it:
        for i, j, data, off in text_steps(b):
            words, row, _ = words_of(data, off)
            group, names = groups_of(b["lang"].slice(i, j - i))
            coded = words.dictionary_encode()
            at = group[row] * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
            pair, n = np.unique(at, return_counts=True)
            k = max(1, len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(pair // k)), coded.dictionary.take(pa.array(pair % k)).cast(pa.binary()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])


def local_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, tid, word): the distinct words of each document."""
    for b in it:
        for i, _, data, off in text_steps(b):
            words, row, _ = words_of(data, off)
            coded = words.dictionary_encode()
            k = max(1, len(coded.dictionary))
            pair = np.unique(row * k + coded.indices.to_numpy(zero_copy_only=False))
            at = pa.array(pair // k + i)
            yield pa.RecordBatch.from_arrays([b["lang"].take(at), b["tid"].take(at), coded.dictionary.take(pa.array(pair % k)).cast(pa.binary())], ["lang", "tid", "word"])


def ids_of(words: pa.Array, group: np.ndarray, known: pa.Array, known_group: np.ndarray, known_id: np.ndarray) -> np.ndarray:
    """The id of each word in its group, 0 without one; words are compared by their bytes."""
    coded = pa.concat_arrays([words, known]).dictionary_encode()
    code, k = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    have = known_group * k + code[len(words) :]
    order = np.argsort(have, kind="stable")
    have, ids = np.append(have[order], -1), np.append(known_id[order], 0)
    want = group * k + code[: len(words)]
    at = np.searchsorted(have[:-1], want)
    return np.where(have[at] == want, ids[at], 0).astype(np.uint32)


def keys_of(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """A row of LONGEST ids for each place at which a run of two or more begins; zeros follow its end."""
    out = np.zeros((len(ids), LONGEST), np.uint32)
    out[:, 0] = ids
    for j in range(1, LONGEST):
        goes = linked[: len(ids) - j] if j == 1 else goes[: len(ids) - j] & linked[j - 1 : len(ids) - 1]
        goes = goes & (out[: len(ids) - j, j - 1] > 0)
        out[: len(ids) - j, j] = np.where(goes, ids[j:], 0)
    return out[out[:, 1] > 0]


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The places of rows of ids in their order: a radix sort by digits of 16 bits, the least first."""
    order = np.arange(len(keys))
    for column in reversed(range(keys.shape[1])):
        for digit in (keys[:, column] & np.uint32(0xFFFF), keys[:, column] >> np.uint32(16)):
            digit = digit.astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of sorted keys and the sums of their n."""
    new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))[: len(keys)]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(n, at) if len(at) else n[:0]


def packed(keys: np.ndarray) -> np.ndarray:
    """Keys of fixed width whose order as bytes is the order of their ids."""
    width = WIDTH * keys.shape[1]
    return np.ascontiguousarray(keys.astype(">u4")).view(f"S{width}").ravel() if len(keys) else np.zeros(0, f"S{width}")


def binary(keys: np.ndarray) -> pa.Array:
    cells = np.ascontiguousarray(keys.astype(">u4"))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH * keys.shape[1]), len(keys), [None, pa.py_buffer(cells)]).cast(pa.binary())


def step_keys(held):
    """The sorted keys of each step with their numbers. held: the dictionary that all tasks got, or None, where rows have their own."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in it:
            for i, j, data, off in text_steps(b):
                words, row, linked = words_of(data, off)
                if held is not None:
                    group, names = groups_of(b["lang"].slice(i, j - i))
                    lang, known, ids = held.value
                    number = {x: k for k, x in enumerate(names)}
                    own = np.array([number.get(x, -1) for x in lang[1]], np.int64)[lang[0]] if len(lang[1]) else np.zeros(0, np.int64)
                    use = np.flatnonzero(own >= 0)
                    got = ids_of(words, group[row], known.take(pa.array(use)), own[use], ids[use])
                else:
                    local = b["local"].slice(i, j - i)
                    size = np.diff(local.offsets.to_numpy())
                    flat = local.flatten()
                    got = ids_of(words, row, flat.field("word").cast(pa.large_binary()), np.repeat(np.arange(j - i), size), flat.field("id").to_numpy(zero_copy_only=False).astype(np.int64))
                keys = keys_of(got, linked)
                keys = keys[radix_order(keys)]
                yield run_lengths(keys, np.ones(len(keys), np.int64))

    return run


def sample_batches(held, rate: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = np.random.default_rng(0)
        for keys, _ in step_keys(held)(it):
            yield pa.RecordBatch.from_arrays([binary(keys[chance.random(len(keys)) < rate])], ["key"])

    return run


def deal_batches(held, borders: np.ndarray):
    """(range, n_keys, ids, counts): each step's runs, a row for each range of keys that it touches; ids lie by columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in step_keys(held)(it):
            at = np.concatenate([[0], np.searchsorted(packed(keys), borders), [len(keys)]])
            some = np.flatnonzero(np.diff(at))
            parts = [(keys[at[r] : at[r + 1]].T.tobytes(), n[at[r] : at[r + 1]].astype(np.uint32).tobytes()) for r in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([x for x, _ in parts], pa.binary()), pa.array([x for _, x in parts], pa.binary())], ["range", "ids", "counts"])

    return run


def range_batches(least: int):
    """(key, a) of the phrases of a range, which a task holds, that occur often enough, and of those at its borders."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.frombuffer(x, np.uint32).reshape(LONGEST, -1).T, np.frombuffer(y, np.uint32)) for b in it for x, y in zip(b["ids"].to_pylist(), b["counts"].to_pylist(), strict=True)]
        if not parts:
            return
        keys, n = np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]).astype(np.int64)
        del parts
        order = radix_order(keys)
        keys, n = run_lengths(keys[order], n[order])
        for size in range(2, LONGEST + 1):
            long = keys[:, size - 1] > 0
            head, a = run_lengths(keys[long][:, :size], n[long])
            keep = a >= least
            keep[:1] = keep[-1:] = True
            yield pa.RecordBatch.from_arrays([binary(head[keep]), pa.array(a[keep])], ["key", "a"])

    return run


def numbered(words: DataFrame) -> DataFrame:
    """words with ids from 1 on, frequent ones first."""
    at = settle(words.orderBy(F.desc("n"), "lang", "word").withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id() % (1 << 33)}))
    before = np.cumsum([0, *(r["count"] for r in sorted(at.groupBy("part").count().collect()))])  # a number per partition
    parts = sorted(r.part for r in at.select("part").distinct().collect())
    shift = at.sparkSession.createDataFrame([(p, int(before[k])) for k, p in enumerate(parts)], "part int, before long")
    return at.join(F.broadcast(shift), "part").select("lang", "word", "n", (F.col("before") + F.col("place") + 1).alias("id"))


def id_bytes(at: int, words: int = 1) -> Column:
    return F.substring("key", WIDTH * at + 1, WIDTH * words)


def counted_phrases(docs: DataFrame, counts: DataFrame, known: DataFrame, least: int, folder: str, sent_words: int) -> DataFrame:
    """(key, a) of all phrases of 2 to LONGEST words with a >= least."""
    spark = docs.sparkSession
    held, total = None, counts.agg(F.sum("n")).first()[0] or 0
    n, size = known.agg(F.count("*"), F.sum(F.octet_length("word") + F.octet_length("lang"))).first()
    if n >= 1 << 8 * WIDTH:
        raise ValueError(f"{n} frequent words need ids of more than {WIDTH} bytes")
    if n <= sent_words and (size or 0) <= SENT_BYTES:
        got = known.select("lang", "word", "id").toArrow()
        lang = groups_of(got["lang"].combine_chunks()) if got.num_rows else (np.zeros(0, np.int64), [])
        word = pa.concat_arrays(got["word"].chunks).cast(pa.large_binary()) if got.num_rows else pa.array([], pa.large_binary())
        held = spark.sparkContext.broadcast((lang, word, got["id"].to_numpy().astype(np.int64)))
        docs = docs.select("lang", "text")
    else:
        docs = docs.withColumn("tid", F.xxhash64("text"))
        own = docs.mapInArrow(local_batches, "lang string, tid long, word binary").distinct().join(known.select("lang", "word", "id"), ["lang", "word"])
        own = stored(own.groupBy("lang", "tid").agg(F.collect_list(F.struct("word", "id")).alias("local")), f"{folder}/local")
        docs = docs.join(own, ["lang", "tid"]).select("text", "local")
    ranges = int(min(RANGES, max(2 * spark.sparkContext.defaultParallelism, total // RANGE_WORDS)))
    target = SAMPLED * ranges
    some = min(1.0, 100 * target / max(1, total))
    keys = docs.sample(some, 0) if some < 1 else docs
    sample = keys.mapInArrow(sample_batches(held, min(1.0, target / max(1.0, total * some))), "key binary").toArrow()["key"].to_pylist()
    sample = np.sort(np.array(sample, f"S{WIDTH * LONGEST}"))
    borders = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges]) if len(sample) else sample
    dealt = docs.mapInArrow(deal_batches(held, borders), "range int, ids binary, counts binary")
    runs = dealt.repartitionById(len(borders) + 1, F.col("range")).mapInArrow(range_batches(least), "key binary, a long")
    return stored(runs.groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= least), f"{folder}/phrases")


def scored(phrases: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """phrases (key, a) with lang, l, r, n and score, by the cut of the lowest score, of equal ones the first."""
    word = known.select(F.unhex(F.lpad(F.hex("id"), 2 * WIDTH, "0")).alias("key"), "lang", F.col("n").alias("a"))
    every = word.select("key", "a").unionByName(phrases)
    words = (F.octet_length("key") / WIDTH).cast("int")
    cuts = phrases.select("key", "a", F.explode(F.sequence(F.lit(1), words - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", F.expr(f"substring(key, 1, {WIDTH} * k)").alias("left"), F.expr(f"substring(key, {WIDTH} * k + 1)").alias("right"))
    cuts = cuts.join(every.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(every.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    first = cuts.withColumn("first", id_bytes(0)).join(word.select(F.col("key").alias("first"), "lang"), "first").join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    first = first.withColumns({"over": (exact("a") * exact("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), "under": (exact("l") * exact("r")).cast("decimal(38,0)")})
    first = first.withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    return first.groupBy("key", "lang", "a", "n").agg(best).select("key", "lang", "a", "n", "b.l", "b.r", "b.score")


def covered(phrases: DataFrame, cover: int) -> DataFrame:
    """(key): the phrases that a candidate of one more word holds and that occur hardly more often than it.

    A longer one that covers a phrase covers those between them too, so that one word more is enough to look at.
    """
    longer = phrases.where(F.octet_length("key") > 2 * WIDTH)
    parts = F.array(F.expr(f"substring(key, 1, octet_length(key) - {WIDTH})"), F.expr(f"substring(key, {WIDTH + 1})"))
    most = longer.select(F.explode(parts).alias("key"), F.col("a").alias("f")).groupBy("key").agg(F.max("f").alias("f"))
    return phrases.join(most, "key").where(F.lit(100) * F.col("f") >= F.lit(cover) * F.col("a")).select("key")


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, sent_words: int = SENT_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases.

    A phrase is 2 to LONGEST neighbouring words of a piece that occur a >= least times; a null lang is `und`, and null and
    empty texts have no words. A phrase inside a longer one goes if 100 * f(longer) >= cover * a. Repeated rows count each,
    as does a document under several ids. Equal scores and counts rank in the order of the phrases' bytes. Documents of
    any length are counted whole, one longer than STEP as a step of its own. Other columns of docs aren't read, so that
    their names can't clash. Words that are no valid UTF-8 can't occur in a string column.
    """
    spark = docs.sparkSession
    folder = scratch(spark.sparkContext, "phrases")
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = docs.mapInArrow(count_batches, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts, f"{folder}/counts")
    totals = settle(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    known = stored(numbered(counts.where(F.col("n") >= least)), f"{folder}/words")
    phrases = counted_phrases(docs, counts, known, least, folder, sent_words)
    discard(spark.sparkContext, f"{folder}/counts")
    kept = scored(phrases, known, totals).join(covered(phrases, cover), "key", "left_anti")
    words = (F.octet_length("key") / WIDTH).cast("int")
    each = kept.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.conv(F.hex(F.substring(F.col("key"), F.lit(WIDTH) * i + 1, F.lit(WIDTH))), 16, 10).cast("long"))).alias("at", "id"))
    named = each.join(known.select("id", "word"), "id").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))  # LONGEST at most
    phrase = F.array_join(F.transform("w.word", lambda x: F.decode(x, "UTF-8")), " ")
    out = settle(kept.join(named.select("key", phrase.alias("phrase")), "key").drop("key"))
    discard(spark.sparkContext, folder)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = out.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")  # SALTS * top rows of a language at most
    return first.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH piece AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
gram AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, ws[i:i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM piece, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, g, any_value(phrase) AS phrase, count(*) AS a FROM gram GROUP BY lang, k, g),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
cut AS (SELECT c.lang, c.g, c.a, j, x.a AS l, y.a AS r, n.n, ((1000 * c.a::HUGEINT * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM (SELECT *, k AS size, unnest(range(1, k)) AS j FROM cand) AS c
  JOIN f AS x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN f AS y ON y.lang = c.lang AND y.g = c.g[j + 1:size] JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_ AS (SELECT lang, a, unnest(range(1, k - m + 2)) AS i, m, g FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)),
gone AS (SELECT DISTINCT c.lang, c.g FROM cand AS c JOIN inner_ AS x ON x.lang = c.lang AND x.g[x.i:x.i + x.m - 1] = c.g WHERE 100 * x.a >= 100 * c.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.lang, phrase, b.a, l, r, n, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, phrase) AS rank
  FROM best AS b JOIN cand AS c ON c.lang = b.lang AND c.g = b.g WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = b.lang AND gone.g = b.g)) WHERE rank <= 2000
"""
