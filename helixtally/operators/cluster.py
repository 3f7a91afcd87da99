"""Similarity of genomes, single linkage and marker classes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from helixtally.functions.dna import mixed, splitmix64, unsigned_order  # noqa: F401  sketches are by splitmix64 in unsigned order
from helixtally.operators.totals import with_totals
from helixtally.sources.store import discard, scratch, settle, stored

SIMILARITY, SKETCH, EXACT_UP_TO = 0.95, 2000, 96
#: Classes of set sizes for each doubling.
CLASSES = 8
#: Pairs of a group's members for each set that are compared at once; while there are more, stars come first, in so many rounds.
FEW, STARS = 16, 8
#: A set's shared markers as bits, in so many numbers.
SIGNS = ("s0", "s1", "s2", "s3")
#: Rows that a task holds before it leaves out those that are not among a genome's least.
BUFFER = 1 << 18


def sizes(genomes: DataFrame, markers: DataFrame, *scope: str) -> DataFrame:
    """(scope, gid, n) of every genome, 0 for one without markers."""
    return counted(genomes, markers.select(*scope, "gid", "marker").distinct().groupBy(*scope, "gid").agg(F.count("*").alias("n")), *scope)


def counted(genomes: DataFrame, n: DataFrame, *scope: str) -> DataFrame:
    """The same of counts (scope, gid, n) of those that have any."""
    return genomes.select(*scope, "gid").distinct().join(n, [*scope, "gid"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def similarities(genomes: DataFrame, markers: DataFrame, *scope: str) -> DataFrame:
    """(scope, a, b, shared, na, nb, jaccard, containment) of the pairs a < b that share a marker, or are both empty.

    Joined on the marker, so pairs that share nothing never arise; of the empty sets, only pairs with the first. Two empty sets have similarity 1, an empty one and
    another have 0.
    """
    held = markers.select(*scope, "gid", "marker").distinct()
    one, two = held.withColumnRenamed("gid", "a"), held.withColumnRenamed("gid", "b")
    shared = one.join(two, [*scope, "marker"]).where("a < b").groupBy(*scope, "a", "b").agg(F.count("*").alias("shared"))
    n = sizes(genomes, markers, *scope)
    na, nb = n.withColumnRenamed("gid", "a").withColumnRenamed("n", "na"), n.withColumnRenamed("gid", "b").withColumnRenamed("n", "nb")
    out = shared.join(na, [*scope, "a"]).join(nb, [*scope, "b"])
    none = F.lit(0).cast("long")
    chain = empties(genomes, markers, *scope).select(*scope, "a", "b", none.alias("shared"), none.alias("na"), none.alias("nb"))
    out = out.select(*scope, "a", "b", "shared", "na", "nb").unionByName(chain)
    both_empty = (F.col("na") == 0) & (F.col("nb") == 0)
    jaccard = F.when(both_empty, 1.0).otherwise(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    containment = F.when(both_empty, 1.0).when(F.least("na", "nb") == 0, 0.0).otherwise(F.col("shared") / F.least("na", "nb"))
    return out.withColumn("jaccard", jaccard).withColumn("containment", containment)


def least_batches(keys: list[str], k: int):
    """(keys, h, rows): the k least mixed markers of each key in each run of BUFFER rows, which is all that the k least of all of them can need.

    rows: in the first row of a key in a run, how many rows the run has of it; 0 in the others.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(t: pa.Table) -> pa.Table:
            if not t.num_rows:
                return t
            t = t.combine_chunks()
            codes = [pc.dictionary_encode(t[c].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in keys]
            h, n = t["h"].to_numpy(), t["rows"].to_numpy()
            order = np.lexsort((h, *codes))
            h, new = h[order], np.append(True, np.zeros(len(h) - 1, bool))
            for c in codes:
                new[1:] |= c[order[1:]] != c[order[:-1]]
            total = np.zeros(len(h), np.int64)
            total[new] = np.add.reduceat(n[order], np.flatnonzero(new))
            first = np.append(True, (h[1:] != h[:-1]) | new[1:])
            order, new, total = order[first], new[first], total[first]
            start = np.flatnonzero(new)
            some = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < k
            return t.take(pa.array(order[some])).set_column(len(keys) + 1, "rows", pa.array(total[some]))

        held, n = [], 0
        for b in it:
            h = mixed(b["marker"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)) ^ np.uint64(1 << 63)
            held.append(pa.Table.from_arrays([*(b[c] for c in keys), pa.array(h.view(np.int64)), pa.array(np.ones(b.num_rows, np.int64))], [*keys, "h", "rows"]))
            n += b.num_rows
            if n > BUFFER:
                held, before = [cut(pa.concat_tables(held))], n
                n = held[0].num_rows
                if n > before // 2:  # many keys with few rows each: nothing to gain by keeping them
                    yield from held[0].to_batches()
                    held, n = [], 0
        if held:
            yield from cut(pa.concat_tables(held)).to_batches()

    return run


def leasts(markers: DataFrame, *scope: str, k: int) -> DataFrame:
    """(scope, gid, h, rows): what each task keeps of a genome, of which a sketch is made; rows sum up to the genome's rows."""
    rows = markers.select(*scope, "gid", F.col("marker").cast("long").alias("marker"))
    schema = StructType([*(rows.schema[c] for c in (*scope, "gid")), StructField("h", LongType()), StructField("rows", LongType())])
    return rows.mapInArrow(least_batches([*scope, "gid"], k), schema)


def ranked(some: DataFrame, *scope: str, k: int) -> DataFrame:
    """(scope, gid, h, rank): the k least h of each genome; what is there twice has one rank, so that one shuffle is enough."""
    rank = F.dense_rank().over(Window.partitionBy(*scope, "gid").orderBy("h"))
    return some.select(*scope, "gid", "h", rank.alias("rank")).where(F.col("rank") <= k).distinct()


def sketch(markers: DataFrame, *scope: str, k: int = SKETCH) -> DataFrame:
    """(scope, gid, h, rank): the k least mixed markers of each genome, without sign.

    Each task keeps k of a genome before the shuffle; what tasks have kept is merged after it, and ranked. So a genome is
    never sorted whole, nor sent.
    """
    return ranked(leasts(markers, *scope, k=k), *scope, k=k)


def sketches(genomes: DataFrame, markers: DataFrame, *scope: str, k: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """(sketches, sizes) of all genomes: `sketch` and `sizes` from one pass over the markers."""
    some = settle(leasts(markers.select(*scope, "gid", "marker").distinct(), *scope, k=k))
    return ranked(some, *scope, k=k), counted(genomes, some.groupBy(*scope, "gid").agg(F.sum("rows").alias("n")), *scope)


def sketched(genomes: DataFrame, markers: DataFrame, *scope: str, k: int = SKETCH) -> DataFrame:
    """(scope, a, b, jaccard, containment) estimated from sketches, of the pairs that share a sketched marker.

    The join that finds the pairs gives what they share, a row a shared marker, and brings the sizes along: neither sketches
    nor sizes are joined to the pairs again.
    """
    s, n = sketches(genomes, markers, *scope, k=k)
    s = settle(s.withColumn("s", F.count("*").over(Window.partitionBy(*scope, "gid"))).join(n, [*scope, "gid"]))
    one, two = (s.select(*scope, F.col("gid").alias(x), "h", *(F.col(c).alias(f"{c[0]}{x}") for c in ("rank", "s", "n"))) for x in "ab")
    return rated(hits_of(one.join(two, [*scope, "h"]).where("a < b"), *scope, "a", "b", "na", "nb", "sa", "sb", k=k), *scope, k=k)


def estimates(pairs: DataFrame, s: DataFrame, n: DataFrame, *scope: str, k: int) -> DataFrame:
    """(scope, a, b, jaccard, containment) of pairs, from sketches s and set sizes n."""
    one = s.select(*scope, F.col("gid").alias("a"), "h", F.col("rank").alias("ra"))
    two = s.select(*scope, F.col("gid").alias("b"), "h", F.col("rank").alias("rb"))
    return scored(pairs.join(one, [*scope, "a"]).join(two, [*scope, "b", "h"]), s, n, *scope, k=k)


def scored(both: DataFrame, s: DataFrame, n: DataFrame, *scope: str, k: int) -> DataFrame:
    """The same of (scope, a, b, h, ra, rb), all markers that are in both sketches of each pair, with their ranks."""
    size = s.groupBy(*scope, "gid").agg(F.count("*").alias("s"))
    n = n.join(size, [*scope, "gid"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    x, y = (n.select(*scope, F.col("gid").alias(g), F.col("n").alias(f"n{g}"), F.col("s").alias(f"s{g}")) for g in "ab")
    return rated(hits_of(both, *scope, "a", "b", k=k).join(x, [*scope, "a"]).join(y, [*scope, "b"]), *scope, k=k)


def hits_of(both: DataFrame, *keys: str, k: int) -> DataFrame:
    """(keys, hits, common) of such rows; keys: scope, a, b, and what follows from them.

    Of the k least of a pair's union, the share in both. A marker in both sketches is among those k if fewer than k
    markers of the union are below it: rank_a + rank_b - (shared ones up to it) <= k.
    """
    common = F.row_number().over(Window.partitionBy(*keys[: keys.index("b") + 1]).orderBy("h"))
    both = both.withColumn("place", F.col("ra") + F.col("rb") - common)
    return both.groupBy(*keys).agg(F.sum((F.col("place") <= k).cast("long")).alias("hits"), F.count("*").alias("common"))


def rated(by: DataFrame, *scope: str, k: int) -> DataFrame:
    """The same of (scope, a, b, hits, common, na, nb, sa, sb): sizes of sets and sketches, and what the latter share."""
    j = F.col("hits") / F.least(F.lit(k), F.col("sa") + F.col("sb") - F.col("common"))
    shared = j * (F.col("na") + F.col("nb")) / (1 + j)
    return by.select(*scope, "a", "b", j.alias("jaccard"), (shared / F.greatest(F.least("na", "nb"), F.lit(1))).alias("containment"))


def compared(s: DataFrame, n: DataFrame, *scope: str, k: int, kind: str):
    """Comparison of pairs by estimates. Two sketches of k markers or fewer together share what is in both, whatever the ranks."""
    size = settle(s.groupBy(*scope, "gid").agg(F.count("*").alias("s"), F.array_sort(F.collect_list("h")).alias("set")).join(n, [*scope, "gid"]))
    long = not size.where(F.col("s") * 2 > k).isEmpty()

    def compare(pairs: DataFrame) -> DataFrame:
        one, two = (size.select(*scope, F.col("gid").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "s", "set"))) for x in "ab")
        if long:
            short = size.select(*scope, "gid", "s")
            pairs = settle(pairs.join(short.select(*scope, F.col("gid").alias("a"), F.col("s").alias("sa")), [*scope, "a"]).join(short.select(*scope, F.col("gid").alias("b"), F.col("s").alias("sb")), [*scope, "b"]).select(*scope, "a", "b", (F.col("sa") + F.col("sb") > k).alias("long")))
        few = pairs.where("NOT long").drop("long") if long else pairs
        both = few.join(one, [*scope, "a"]).join(two, [*scope, "b"]).withColumn("common", F.size(F.array_intersect("seta", "setb")).cast("long"))
        out = rated(both.where("common > 0").withColumn("hits", F.col("common")), *scope, k=k)
        if long:
            out = out.unionByName(estimates(pairs.where("long").drop("long"), s, n, *scope, k=k))
        return out.select(*scope, "a", "b", F.col(kind).alias("near"))

    return compare


def copies_of(rows: DataFrame, item: str, *scope: str, size: str = "n") -> DataFrame:
    """(scope, gid, rep): the first of the sets of rows (scope, gid, size, item) that hold the same items and have the same size."""
    mark = [F.bit_xor(F.xxhash64(F.lit(k), item)).alias(f"d{k}") for k in (1, 2)]
    digests = rows.groupBy(*scope, "gid", size).agg(F.count("*").alias("c"), *mark)
    return settle(digests.withColumn("rep", F.min("gid").over(Window.partitionBy(*scope, size, "c", "d1", "d2"))).select(*scope, "gid", "rep"))


def numbered(held: DataFrame, *scope: str) -> DataFrame:
    """(scope, gid, n, marker, freq): markers as numbers, without those of one set alone; n, all markers of a set; freq, all sets of a marker."""
    rows = settle(held.select(*scope, "gid", "marker", F.count("*").over(Window.partitionBy(*scope, "gid")).alias("n"), F.monotonically_increasing_id().alias("row")))
    by = Window.partitionBy(*scope, "marker")
    return settle(rows.select(*scope, "gid", "n", F.min("row").over(by).alias("marker"), F.count("*").over(by).alias("freq")).where("freq > 1"))


def groups_of(held: DataFrame, *scope: str, threshold: float, containment: bool = False) -> DataFrame:
    """(scope, marker, gid, n, rare, whole, spare, s0, ...): the groups in which every pair of this Jaccard similarity (or containment) meets.

    Such a pair shares threshold times the markers of the larger (smaller) set. So it shares one of the few rarest markers
    of both (or one of the smaller set's rarest, and any of the other's): a marker that very many sets hold is hardly
    ever among those, and makes no group. spare: how many shared markers the other set may lack; s0, ...: a bit a shared marker.
    """
    if "freq" not in held.columns:
        held = held.select(*scope, "gid", "marker", F.count("*").over(Window.partitionBy(*scope, "gid")).alias("n"))
        held = held.withColumn("freq", F.count("*").over(Window.partitionBy(*scope, "marker"))).where("freq > 1")
    by, mixed = Window.partitionBy(*scope, "gid"), F.xxhash64("marker")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(mixed, 8).bitwiseAND(63).cast("int"))
    signs = [F.bit_or(F.when(F.pmod(mixed, F.lit(len(SIGNS))) == k, bit).otherwise(F.lit(0).cast("long"))).over(by).alias(c) for k, c in enumerate(SIGNS)]
    spare = F.count("*").over(by) - F.ceil(threshold * F.col("n") - 1e-9)  # markers of one set alone are lacking in any other
    held = held.select(*scope, "marker", "gid", "n", "freq", spare.alias("spare"), *signs)
    rank = F.row_number().over(by.orderBy("freq", "marker"))
    held = held.select(*scope, "marker", "gid", "n", (rank <= F.col("spare") + 1).alias("rare"), F.lit(True).alias("whole"), "spare", *SIGNS)
    if not containment:
        return settle(held.where("rare"))
    held = settle(held)
    least = held.where("rare").groupBy(*scope, "marker").agg(F.min("n").alias("least"))
    return settle(held.join(least, [*scope, "marker"]).where("n >= least").drop("least"))


def size_classes(s: DataFrame, n: DataFrame, *scope: str, threshold: float, k: int = SKETCH) -> DataFrame:
    """The same groups for containment that is estimated from sketches s (of k), by classes of set sizes n.

    Of a smaller set a, only hashes up to the last one that a sketch in b's class has can be among the k least of both, and
    of those the estimate needs at least `hits` in b. So all but hits - 1 of them, the rarest in that class, are enough to meet b
    by. A class holds sets of nearly one size, so that the bounds are close; the larger the class, the fewer hashes of a count.

    Sets of up to k / (2 - threshold) markers are one class, and their sketches are whole: two of them have at most k
    markers beside those of a that b may lack, so that a link needs threshold times a's markers in b, whatever b's size.
    """
    level = F.when(F.col("n") <= k / (2 - threshold), 0).otherwise(1 + F.floor(CLASSES * F.log2(F.greatest("n", F.lit(1))))).cast("int")
    own = s.groupBy(*scope, "gid").agg(F.count("*").alias("s"), F.max("h").alias("top")).join(n, [*scope, "gid"]).withColumn("class", level)
    own = settle(own.withColumn("top", F.when(F.col("s") >= k, F.col("top")).otherwise(F.lit((1 << 63) - 1))))
    rows = settle(s.select(*scope, "gid", "h").join(own.select(*scope, "gid", "n", "s", "class"), [*scope, "gid"]))
    few = rows.where("class = 0").select(*scope, "gid", F.col("h").alias("marker"))
    few = groups_of(few, *scope, threshold=threshold, containment=True).withColumn("marker", F.struct(F.lit(0).alias("kind"), F.col("marker").alias("h")))
    if own.where("class > 0").isEmpty():
        return few
    kinds = own.where("class > 0").groupBy(*scope, "class").agg(F.max("top").alias("top"), F.min("s").alias("least"), F.max("n").alias("most"))
    kinds = kinds.groupBy(*scope).agg(F.collect_list(F.struct(F.col("class").alias("kind"), "top", "least", "most")).alias("kinds")) if scope else kinds.agg(F.collect_list(F.struct(F.col("class").alias("kind"), "top", "least", "most")).alias("kinds"))
    small = (rows.join(F.broadcast(kinds), list(scope)) if scope else rows.crossJoin(F.broadcast(kinds))).withColumn("c", F.explode(F.filter("kinds", lambda c: (c["kind"] >= F.col("class")) & (c["top"] >= F.col("h")))))
    small = small.select(*scope, "gid", "n", "s", "h", "c.kind", "c.least", "c.most")
    freq = rows.groupBy(*scope, F.col("class").alias("kind"), "h").agg(F.count("*").alias("freq"))
    small = small.join(freq, [*scope, "kind", "h"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    by = Window.partitionBy(*scope, "gid", "kind")
    j = threshold * F.col("n") / (F.col("n") + F.col("most") - threshold * F.col("n"))
    hits = F.greatest(F.ceil(j * F.greatest("s", "least") - 1e-9), F.lit(1))
    small = small.withColumns({"all": F.count("*").over(by), "place": F.row_number().over(by.orderBy("freq", "h"))}).where(F.col("place") <= F.col("all") - hits + 1).where("freq > 0")
    marker = lambda kind: F.struct(F.col(kind).alias("kind"), "h").alias("marker")
    small = small.select(*scope, marker("kind"), "gid", "n", F.lit(True).alias("rare"), F.lit(False).alias("whole"))
    large = rows.select(*scope, marker("class"), "gid", "n", F.lit(False).alias("rare"), F.lit(True).alias("whole")).join(small.select(*scope, "marker").distinct(), [*scope, "marker"], "left_semi")
    both = small.unionByName(large).groupBy(*scope, "marker", "gid", "n").agg(F.max("rare").alias("rare"), F.max("whole").alias("whole"))
    none = {"spare": F.col("n"), **{c: F.lit(0).cast("long") for c in SIGNS}}  # no bits, which rule out nothing
    return settle(both.withColumns(none).unionByName(few))


def may_link(x: str, y: str, threshold: float, containment: bool) -> Column:
    """Whether members x and y of a group need a look: which of them must hold the marker among its rarest, the sizes, and the bits."""
    nx, ny, rx, ry, wx, wy = (F.col(f"{p}.{c}") for c in ("n", "rare", "whole") for p in (x, y))
    # bits of p that q doesn't have stand for as many markers at least
    lacking = lambda p, q: reduce(add, (F.bit_count(F.col(f"{p}.{c}").bitwiseAND(F.bitwise_not(F.col(f"{q}.{c}")))) for c in SIGNS))
    if containment:
        return (rx & wy & (nx <= ny) & (lacking(x, y) <= F.col(f"{x}.spare"))) | (ry & wx & (ny <= nx) & (lacking(y, x) <= F.col(f"{y}.spare")))
    need = threshold * F.greatest(nx, ny) - 1e-9
    return rx & ry & (F.least(nx, ny) >= need) & (lacking(x, y) <= nx - need) & (lacking(y, x) <= ny - need)


def forest(groups: DataFrame, compare, *scope: str, threshold: float, containment: bool = False, metric: bool = False, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(links, tried): links (scope, a, b, near), enough of them to reach whatever all links would reach, and the pairs compared.

    In each round, the next member of a group is compared with those that it doesn't reach yet, and leaves the group; groups whose members all
    reach each other are closed, so that sets that are nearly alike cost about one comparison each. By containment, the next member is
    the smallest: it is in the most others. Once what is open has at most
    `few` pairs a set, it is compared pair by pair, between components only. There, if 1 - near is a distance (metric: that of
    Jaccard, but for estimates), pairs are left out that differ in their distances to a centre by more than links do.
    compare: (scope, a, b) -> (scope, a, b, near).
    """
    on = [*scope, "marker"]
    sc, folder = groups.sparkSession.sparkContext, scratch(groups.sparkSession.sparkContext, "forest")
    pair = lambda df, x, y: df.select(*scope, F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    first = [(~F.col("rare")).alias("late"), "n", "gid"] if containment else ["gid", "n"]
    member = F.struct(*first, "rare", "whole", "spare", *SIGNS, "root")
    nodes = settle(groups.select(*scope, "gid").distinct())
    enough, across, group = few * nodes.count(), None, Window.partitionBy(*on)
    root, rows, tried, link = nodes.withColumn("root", F.col("gid")), groups, None, lambda df: df.where(F.col("near") >= threshold)
    for k in range(STARS + 1):
        rows = rows.join(root, [*scope, "gid"]).withColumns({"low": F.min("root").over(group), "high": F.max("root").over(group), "some": F.max("rare").over(group)})
        rows = stored(rows.where("low < high AND some").drop("low", "high", "some"), f"{folder}/open{k}")
        for name in ("open", "centre"):
            discard(sc, f"{folder}/{name}{k - 1}")
        size = rows.groupBy(*on, "root").agg(F.count("*").alias("c"), F.sum(F.col("rare").cast("long")).alias("r")).groupBy(*on).agg((F.sum("c") * F.sum("r") - F.sum(F.col("c") * F.col("r"))).alias("c"))
        before, across = across, size.agg(F.sum("c")).first()[0]
        if not across:
            break
        star = k < STARS and across > 2 * enough and (before is None or across < before // 2)  # while stars close groups
        whole = rows.select(*on, F.col("root").alias("s"), member.alias("y"))
        if star:
            centre = stored(rows.groupBy(*on).agg(F.min(member).alias("x")), f"{folder}/centre{k}")
            found = whole.join(centre, on).where(F.col("s") != F.col("x.root"))
        else:
            parts = rows.select(*on, F.col("root").alias("r")).distinct()
            two = parts.join(parts.withColumnRenamed("r", "s"), on).where("r <> s" if containment else "r < s")
            found = rows.where("rare").select(*on, F.col("root").alias("r"), member.alias("x")).join(two, [*on, "r"]).join(whole, [*on, "s"])
        pairs = pair(found.where(may_link("x", "y", threshold, containment)), F.col("x.gid"), F.col("y.gid"))
        if not star and metric and tried is not None:
            pairs = apart(pairs, tried, *scope, threshold=threshold)
        if tried is not None:
            pairs = pairs.join(tried.select(*scope, "a", "b"), [*scope, "a", "b"], "left_anti")
        fresh = stored(compare(settle(pairs)), f"{folder}/tried{k}")
        tried = fresh if tried is None else tried.unionByName(fresh)
        if not star:
            break
        rows = rows.drop("root").join(centre.select(*on, F.col("x.gid").alias("last")), on).where("gid <> last").drop("last")  # it has met them all
        root = settle(merged(root, link(fresh), *scope))
    if tried is None:
        tried = compare(pair(groups.limit(0), F.col("gid"), F.col("gid")))
    tried = settle(tried)
    discard(sc, folder)
    return link(tried), tried


def merged(root: DataFrame, links: DataFrame, *scope: str) -> DataFrame:
    """(scope, gid, root) with what links (scope, a, b) join: components of the roots that they touch."""
    of = lambda x: root.select(*scope, F.col("gid").alias(x), F.col("root").alias(f"{x}_root"))
    edges = settle(links.select(*scope, "a", "b").join(of("a"), [*scope, "a"]).join(of("b"), [*scope, "b"]).where("a_root <> b_root").select(*scope, F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
    ends = edges.select(*scope, F.col("a").alias("gid")).union(edges.select(*scope, F.col("b").alias("gid")))
    top = components(ends, edges, *scope).select(*scope, F.col("gid").alias("root"), F.col("root").alias("top"))
    return root.join(top, [*scope, "root"], "left").select(*scope, "gid", F.coalesce("top", "root").alias("root"))


def apart(pairs: DataFrame, tried: DataFrame, *scope: str, threshold: float) -> DataFrame:
    """The pairs that a set compared with both doesn't show to be apart: |d(x, c) - d(y, c)| <= d(x, y) for distances."""
    far = tried.select(*scope, "a", "b", (1 - F.col("near")).alias("d"))
    both = far.unionByName(far.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    hub = both.groupBy(*scope, "b").agg(F.count("*").alias("k")).where("k > 1")  # a centre: compared with several
    near = both.join(hub.select(*scope, "b"), [*scope, "b"], "left_semi")
    first = near.groupBy(*scope, "a").agg(F.min(F.struct("b", "d")).alias("c"))  # one centre a set is enough
    seen = pairs.join(first.select(*scope, "a", F.col("c.b").alias("c"), F.col("c.d").alias("da")), [*scope, "a"], "left")
    seen = seen.join(near.select(*scope, F.col("a").alias("b"), F.col("b").alias("c"), F.col("d").alias("db")), [*scope, "b", "c"], "left")
    return seen.where(F.col("da").isNull() | F.col("db").isNull() | (F.abs(F.col("da") - F.col("db")) <= 1 - threshold + 1e-9)).select(*scope, "a", "b")


def linked(genomes: DataFrame, markers: DataFrame, *scope: str, threshold: float, containment: bool = False) -> DataFrame:
    """(scope, a, b): links between genomes of this exact similarity, enough of them to reach whatever all would reach.

    Genomes of equal sets are one from the start; candidates are compared by their whole sets.
    """
    held = settle(markers.select(*scope, "gid", "marker").distinct().withColumn("n", F.lit(0)))
    same = copies_of(held, "marker", *scope)
    own = numbered(held.join(same.where("gid = rep").select(*scope, "gid"), [*scope, "gid"]), *scope)
    found, _ = forest(groups_of(own, *scope, threshold=threshold, containment=containment), exactly(own, *scope, containment=containment), *scope, threshold=threshold, containment=containment, metric=not containment, few=FEW // 8 if containment else FEW)
    found = found.select(*scope, "a", "b")
    copies = same.where("gid <> rep").select(*scope, F.col("rep").alias("a"), F.col("gid").alias("b"))
    return found.unionByName(copies.unionByName(empties(genomes, same, *scope)).where(F.lit(threshold <= 1)))  # those of similarity 1


def exactly(held: DataFrame, *scope: str, containment: bool = False):
    """Comparison of pairs by their whole sets, or by their shared markers and their sizes n."""
    size = F.max("n") if "n" in held.columns else F.count("*")
    sets = settle(held.groupBy(*scope, "gid").agg(F.collect_list("marker").alias("set"), size.alias("n")))

    def compare(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(*scope, F.col("gid").alias(x), F.col("set").alias(f"set_{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        both, na, nb = F.size(F.array_intersect("set_a", "set_b")), F.col("na"), F.col("nb")
        near = both / F.least(na, nb) if containment else both / (na + nb - both)
        return pairs.join(one, [*scope, "a"]).join(two, [*scope, "b"]).select(*scope, "a", "b", near.alias("near"))

    return compare


def empties(genomes: DataFrame, markers: DataFrame, *scope: str) -> DataFrame:
    """(scope, a, b): the genomes without markers, each with the first of them, which links them as all their pairs would."""
    ids = lambda df: df.select(*scope, "gid").distinct()
    n = ids(genomes).join(ids(markers), [*scope, "gid"], "left_anti").withColumnRenamed("gid", "b")
    return with_totals(n, *scope, a=F.min("b")).where("a < b").select(*scope, "a", "b")


def sketch_linked(genomes: DataFrame, markers: DataFrame, *scope: str, threshold: float, containment: bool = False, k: int = SKETCH) -> DataFrame:
    """The same by estimates from sketches.

    For Jaccard similarity the sketches themselves are sets that a link needs to share `threshold` of. For containment see
    `size_classes`.
    """
    s, n = map(settle, sketches(genomes, markers, *scope, k=k))
    same = copies_of(s.join(n, [*scope, "gid"]), "h", *scope)  # of one sketch and size: estimates of them are equal
    s = settle(s.join(same.where("gid = rep").select(*scope, "gid"), [*scope, "gid"]))
    groups = size_classes(s, n, *scope, threshold=threshold, k=k) if containment else groups_of(s.select(*scope, "gid", F.col("h").alias("marker")), *scope, threshold=threshold)
    compare = compared(s, n, *scope, k=k, kind="containment" if containment else "jaccard")
    edges = forest(groups, compare, *scope, threshold=threshold, containment=containment, few=FEW // 8 if containment else FEW)[0].select(*scope, "a", "b")
    edges = edges.unionByName(same.where("gid <> rep").where(F.lit(threshold <= 1)).select(*scope, F.col("rep").alias("a"), F.col("gid").alias("b")))
    return edges if containment else edges.unionByName(empties(genomes, markers, *scope))  # sketches of two empty sets agree


def components(nodes: DataFrame, edges: DataFrame, *scope: str) -> DataFrame:
    """(scope, gid, root): the least node that each node reaches; isolated nodes are their own.

    Least labels pass along edges and are halved along their own labels. Each round is a table, which goes after the next.
    """
    sc = nodes.sparkSession.sparkContext
    folder, k = scratch(sc, "components"), 0
    both = stored(edges.select(*scope, "a", "b").union(edges.select(*scope, "b", "a")).distinct(), f"{folder}/edges")
    label = stored(nodes.select(*scope, "gid", F.col("gid").alias("root")).distinct(), f"{folder}/0")
    while True:
        near = both.join(label.withColumnRenamed("gid", "b"), [*scope, "b"]).groupBy(*scope, F.col("a").alias("gid")).agg(F.min("root").alias("near"))
        mid = label.join(near, [*scope, "gid"], "left").select(*scope, "gid", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("mid"))
        up = label.select(*scope, F.col("gid").alias("mid"), F.col("root").alias("top"))
        moved = stored(mid.join(up, [*scope, "mid"], "left").select(*scope, "gid", "old", F.least("mid", F.coalesce("top", "mid")).alias("root")), f"{folder}/{k + 1}")
        discard(sc, f"{folder}/{k}")
        label, k = moved.select(*scope, "gid", "root"), k + 1
        if moved.where("old <> root").isEmpty():
            discard(sc, f"{folder}/edges")
            return label


def single_linkage(genomes: DataFrame, markers: DataFrame, *scope: str, threshold: float = SIMILARITY, containment: bool = False, method: str = "auto") -> DataFrame:
    """(scope, gid, cluster_id, cluster): clusters numbered by their first member, named C0, C1, ...

    method: exact, minhash, or auto, which sketches in the scopes that have more than EXACT_UP_TO genomes. A threshold of
    0 or less links every pair.
    """
    if threshold <= 0:
        roots = with_totals(genomes.select(*scope, "gid").distinct(), *scope, root=F.min("gid"))
    else:
        options = {"threshold": threshold, "containment": containment}
        if method == "auto":
            n = settle(genomes.select(*scope, "gid").distinct().groupBy(*scope).agg((F.count("*") > EXACT_UP_TO).alias("many")))
            kinds = {r.many for r in n.select("many").distinct().collect()}
            if len(kinds) < 2:
                return single_linkage(genomes, markers, *scope, method="minhash" if True in kinds else "exact", **options)
            of = lambda df, many: df.join(n.where(F.col("many") == many).select(*scope), list(scope), "left_semi")
            edges = linked(of(genomes, False), of(markers, False), *scope, **options).unionByName(sketch_linked(of(genomes, True), of(markers, True), *scope, **options))
        else:
            edges = (linked if method == "exact" else sketch_linked)(genomes, markers, *scope, **options)
        roots = components(genomes, edges, *scope)
    by = Window.partitionBy(*scope).orderBy("root") if scope else Window.partitionBy(F.lit(1)).orderBy("root")
    ids = roots.select(*scope, "root").distinct().withColumn("cluster_id", (F.row_number().over(by) - 1).cast("long"))
    return roots.join(ids, [*scope, "root"]).select(*scope, "gid", "cluster_id", F.concat(F.lit("C"), F.col("cluster_id")).alias("cluster"))


def classify(markers: DataFrame, membership: DataFrame, *scope: str) -> DataFrame:
    """(scope, marker, class, owner): core, cluster_specific, strain_specific or partial, and whose it is."""
    held = markers.select(*scope, "gid", "marker").distinct().join(membership, [*scope, "gid"])
    n = membership.groupBy(*scope).agg(F.count_distinct("cluster_id").alias("n_clusters")) if scope else membership.agg(F.count_distinct("cluster_id").alias("n_clusters"))
    by = held.groupBy(*scope, "marker").agg(F.count("*").alias("gd"), F.count_distinct("cluster_id").alias("cd"), F.min("gid").alias("g"), F.min("cluster_id").alias("c"))
    by = by.join(n, list(scope)) if scope else by.crossJoin(F.broadcast(n))  # one row
    core = (F.col("cd") == F.col("n_clusters")) & (F.col("n_clusters") > 1)
    strain, cluster = (F.col("cd") == 1) & (F.col("gd") == 1), F.col("cd") == 1
    kind = F.when(core, "core").when(strain, "strain_specific").when(cluster, "cluster_specific").otherwise("partial")
    owner = F.when(~core & strain, F.col("g").cast("long")).when(~core & cluster, F.col("c").cast("long"))
    return by.select(*scope, "marker", kind.alias("class"), owner.alias("owner"))


def class_summary(classes: DataFrame, *scope: str) -> DataFrame:
    return classes.groupBy(*scope, "class").agg(F.count("*").alias("n"))


def cluster_db(single: DataFrame, full: DataFrame, membership: DataFrame, *scope: str) -> DataFrame:
    """(scope, unit, marker, degree, is_unique): clusters as units.

    A cluster holds the single-copy markers of its members. One is unique if no other cluster holds it in any number of
    copies; a scope without such markers falls back to degree 1.
    """
    name = membership.select(*scope, "gid", F.col("cluster").alias("unit"))
    rows = lambda df, own: df.select(*scope, "gid", "marker", F.lit(own).alias("own"))
    both = rows(single, 1).unionByName(rows(full, 0)).join(name, [*scope, "gid"]).repartition(*scope, "marker")  # for both steps below
    held = both.groupBy(*scope, "marker", "unit").agg(F.max("own").alias("own"), F.min("own").alias("seen"))
    by = Window.partitionBy(*scope, "marker")
    held = held.withColumns({"degree": F.sum("own").over(by), "alone": F.sum(1 - F.col("seen")).over(by) == 1}).where("own = 1")
    held = settle(held.select(*scope, "unit", "marker", "degree", "alone"))
    any_ = held.groupBy(*scope).agg(F.max("alone").alias("any")) if scope else held.agg(F.max("alone").alias("any"))
    any_ = F.broadcast(settle(any_))  # a row a scope
    held = held.join(any_, list(scope)) if scope else held.crossJoin(any_)
    return held.select(*scope, "unit", "marker", "degree", F.when(F.col("any"), F.col("alone")).otherwise(F.col("degree") == 1).alias("is_unique"))
