"""Groups of members that are linked by pairs, which are looked for among members that share a key.

First come the pairs of met_pairs(), whose number is in proportion to the members. They leave out
pairs of crowded keys, but join most of what is similar there. Then rest_pairs() compares all members
of crowded keys that are not joined yet, so in the end every two members that share a key and are
near each other are in one group or have been checked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, sized
from .components import components

#: Members of a bucket up to which all its pairs are looked at, and leaders with whom a larger one compares its members.
SMALL, LEADERS = 8, 2
#: Of more pairs than MANY one of EARLY is checked first, which joins most of a family; then pairs that are still apart.
MANY, EARLY = 1 << 16, 16
#: Members of a crowded bucket that one task compares at once with as many others, and numbers of a table of differences.
CHUNK, CELLS = 1024, 1 << 18


#: Of pairs, by their sizes and marks (one row each), whether checked() may leave them: false only where it surely doesn't.
Sieve = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def linked(keyed: DataFrame, far: int, similar: float, checked: Callable[[DataFrame], DataFrame], sieve: Sieve | None = None) -> DataFrame:
    """(node, root) of the members that are linked to others, over all pairs that share a key, are near as in met_pairs() and that checked() leaves.

    keyed: as in met_pairs(), from cut(), with marks array<long> of one length if there is a sieve; checked: of pairs (a, b) those that are linked.
    """
    first = met_pairs(keyed, far, similar)
    links = cut(checked(first))
    groups = cut(components(links))
    rest = rest_pairs(keyed, groups, first, far, similar, sieve)
    n = rest.count()
    for share in (EARLY, 1) if n > MANY else (1,) if n else ():
        part = rest.where(F.pmod(F.xxhash64("a", "b"), F.lit(share)) == 0)
        links = cut(links.unionByName(checked(part)))
        groups = cut(components(links))
        if share > 1:
            rest = cut(_apart(rest, groups))
    for table in (first, links, rest):
        release(table)
    return groups


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose members aren't in one group."""
    root = lambda c: sized(groups).select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    found = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return found.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def rest_pairs(keyed: DataFrame, groups: DataFrame, known: DataFrame, far: int, similar: float, sieve: Sieve | None = None) -> DataFrame:
    """All pairs (a, b), a < b, that share a key of more than SMALL members, are near, aren't in one group and aren't known.

    Every member is compared with every other one of its bucket, so the time grows with the square of
    a bucket; memory doesn't. Large buckets are dealt by size: members of which one is the share
    similar of the other are in the same band of sizes or in neighbouring ones. Bands are dealt into
    chunks of about CHUNK, and each two chunks make a row, which any task may take.
    """
    keys = F.array_distinct(F.concat("keys", "strong"))
    each = keyed.select("id", F.explode(keys).alias("k"))
    crowded = cut(each.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > SMALL))
    roots = groups.select(F.col("node").alias("id"), "root")
    told = ["id", "print", "size", *["marks"] * (sieve is not None)]
    members = keyed.join(roots, "id", "left").select(*told, F.coalesce("root", "id").alias("root"), F.explode(keys).alias("k")).join(sized(crowded), "k")
    band = F.when(F.col("n") > CHUNK, F.floor(F.log(F.greatest("size", F.lit(1))) / -math.log(similar))).otherwise(0).cast("int")
    # A member is compared in its own band, and as a lower one in the next, with those that own it.
    placed = cut(members.select(*told, "root", "k", band.alias("own"), F.explode(F.when(F.col("n") > CHUNK, F.array(band, band + 1)).otherwise(F.array(band))).alias("band")))
    bands = placed.groupBy("k", "band").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    dealt = placed.join(sized(cut(bands)), ["k", "band"], "left").withColumn("chunk", F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
    rows = dealt.select("*", F.explode(others).alias("other")).select("k", "band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), F.struct("root", (F.col("own") == F.col("band")).alias("own"), (F.col("chunk") == F.least("chunk", "other")).alias("left"), *told).alias("m"))
    met = rows.groupBy("k", "band", "i", "j").agg(F.collect_list("m").alias("m")).where(F.size("m") > 1)
    pairs = met.select((F.col("i") == F.col("j")).alias("same"), "m").mapInArrow(_compared(far, similar, sieve), "a long, b long").distinct()
    found = cut(pairs.join(known, ["a", "b"], "left_anti"))
    release(crowded)
    release(placed)
    return found


def _compared(far: int, similar: float, sieve: Sieve | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) that are near and in different groups, one of them at least in its own band. Rows: whether all members are compared, or those left with those not left, and the members."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            root, own, left, ids, prints, size, *marks = lists.flatten().flatten()
            marks = [m.flatten().to_numpy().reshape(len(ids), -1) for m in marks]
            root, own, left, ids, prints, size = (f.to_numpy(zero_copy_only=False) for f in (root, own, left, ids, prints, size))
            ends = np.cumsum(lists.value_lengths().to_numpy())
            for same, b, n in zip(batch.column(0).to_pylist(), ends.tolist(), lists.value_lengths().to_pylist(), strict=True):
                all_ = np.arange(b - n, b)
                x, y = (all_, all_) if same else (all_[left[all_]], all_[~left[all_]])
                if not len(x) or not len(y):
                    continue
                step = max(1, CELLS // len(y))
                for at in range(0, len(x), step):
                    u, v = np.nonzero(np.bitwise_count((prints[x[at : at + step], None] ^ prints[None, y]).view(np.uint64)) <= far)
                    u, v = x[at : at + step][u], y[v]
                    low, high = np.minimum(size[u], size[v]), np.maximum(size[u], size[v])
                    near = (root[u] != root[v]) & (own[u] | own[v]) & (low >= similar * high - 1e-9)
                    if same:
                        near &= u < v
                    u, v = u[near], v[near]
                    for m in marks:
                        possible = sieve(size[u], size[v], m[u], m[v])
                        u, v = u[possible], v[possible]
                    u, v = ids[u], ids[v]
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    return pairs


def met_pairs(keyed: DataFrame, far: int, similar: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members that share a key, whose fingerprints differ in at most far bits, and of whose sizes the less is the share similar of the other or more.

    keyed: (id long, print long, size int, keys array<long>, strong array<long>) with distinct ids. Of a key that
    up to SMALL members have all pairs are looked at. A key of more members, as of a passage that
    much of the corpus repeats, says little: members meet in it only together with another such key.
    Where that bucket is large too, or that of a strong key, which needs no other, its members are a
    family: each is paired with LEADERS of them, so n members cost n pairs, not n squared. What this leaves out rest_pairs() finds.
    """

    def near(x: Column, y: Column) -> Column:
        close = F.bit_count(x["print"].bitwiseXOR(y["print"])) <= far
        return close & (F.least(x["size"], y["size"]) >= similar * F.greatest(x["size"], y["size"]) - 1e-9)

    each = keyed.select("id", "print", "size", F.explode(F.array_distinct("keys")).alias("k"))
    shared = cut(each.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(each.join(sized(shared), "k"))
    hot = met.where(F.col("n") > SMALL).groupBy("id").agg(F.first("print").alias("print"), F.first("size").alias("size"), F.sort_array(F.collect_set("k")).alias("hot"))
    two = F.flatten(F.transform("hot", lambda h, i: F.transform(F.filter("hot", lambda _, j: j > i), lambda k: F.xxhash64(h, k))))
    double = cut(hot.select("id", "print", "size", F.explode(two).alias("k")).unionByName(keyed.select("id", "print", "size", F.explode("strong").alias("k"))))
    families = cut(double.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    kin = cut(double.join(sized(families), "k"))
    # The same order everywhere, from both ends, so that families of the same members have the same leaders.
    at = F.struct(F.xxhash64("id").alias("o"), "id", "print", "size")
    leaders = [least(at).alias(f"l{i}") for i, least in enumerate((F.min, F.max))]
    large = kin.where(F.col("n") > SMALL)
    led = cut(large.groupBy("k").agg(*leaders).select("k", F.array_distinct(F.array("l0", "l1")).alias("leaders")))
    star = large.join(sized(led, weight=F.lit(2 * LEADERS)), "k").select(F.struct("id", "print", "size").alias("m"), F.explode("leaders").alias("l")).where("m.id <> l.id")
    star = star.where(near(F.col("m"), F.col("l"))).select(F.least("m.id", "l.id").alias("a"), F.greatest("m.id", "l.id").alias("b"))
    small = kin.where(F.col("n") <= SMALL)
    pairs = cut(reduce(DataFrame.unionByName, (_all_pairs(met.where(F.col("n") <= SMALL), near), _all_pairs(small, near), star)).distinct())
    for table in (shared, met, double, families, kin, led):
        release(table)
    return pairs


def _all_pairs(rows: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (a, b) that are near, within the buckets of rows (id, print, size, k), of which none has more than SMALL members."""
    members = rows.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("id", "print", "size"))).alias("m"))
    others = lambda a, i: F.filter(F.slice("m", i + 2, F.lit(SMALL)), lambda b: near(a, b))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(others(a, i), lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b")))))
    return members.select(F.explode(pairs).alias("p")).select("p.*")
