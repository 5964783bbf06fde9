"""Packing of documents into training sequences of several permitted lengths, best fit first.

Lengths are cut to the largest permitted one, so the whole corpus has at most that many different
lengths, and the packing is decided on their histogram: what reaches the driver does not grow with
the corpus. Longer pieces are placed first, each into the fullest open bin that takes it; a new bin
gets the size that costs least per token when filled with such pieces; at the end every bin shrinks
to the smallest permitted size that holds its contents. Equal pieces and equal bins are placed
together as ranges: pieces number a to b of a length go to bins x to y.

Pieces get their numbers from a hash-dealt ranking, so that a length that a third of all pieces share is
numbered by many tasks, and look their bin up in the table of ranges.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, cut, without
from .token_counts import token_counts

#: Permitted sequence lengths in tokens. A bin costs its tokens and, for attention, a share that grows with its square.
SIZES, ATTENTION = (512, 1024, 2048, 4096), 1 / 8192
#: Pieces of a length that are numbered by one task.
SALTS = 256


class Placed(NamedTuple):
    """Pieces of a length numbered from first on go to bins from bin on, per_bin in each, starting at offset."""

    length: int
    first: int
    count: int
    bin: int
    per_bin: int
    offset: int


class Plan(NamedTuple):
    placed: list[Placed]
    #: (first bin, number of bins, size, tokens in each)
    bins: list[tuple[int, int, int, int]]


def cost(size: int) -> float:
    return size + ATTENTION * size * size


def opened(length: int, sizes: tuple[int, ...]) -> int:
    """The permitted size that costs least per token when filled with pieces of this length."""
    return min((s for s in sizes if s >= length), key=lambda s: (cost(s) / (s // length * length), s))


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES) -> Plan:
    """Best-fit decreasing over the numbers of pieces by length."""
    sizes = tuple(sorted(sizes))
    free: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room left -> (first bin, bins, tokens in each)
    rooms: list[int] = []  # the keys of free, in order
    placed: list[Placed] = []
    bins = 0

    def keep(room: int, first: int, n: int, used: int) -> None:
        if n:
            if not free[room]:
                bisect.insort(rooms, room)
            free[room].append((first, n, used))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, number = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n, used = free[room].pop()
                if not free[room]:
                    rooms.pop(at)
            else:
                room, used, first = opened(length, sizes), 0, bins
                n = -(-left // (room // length))
                bins += n
            fit = room // length
            full = min(n, left // fit)
            if full:
                placed.append(Placed(length, number, full * fit, first, fit, used))
                keep(room - fit * length, first, full, used + fit * length)
                number, left = number + full * fit, left - full * fit
            if full < n and left and left < fit:
                placed.append(Placed(length, number, left, first + full, left, used))
                keep(room - left * length, first + full, 1, used + left * length)
                full, left = full + 1, 0
            keep(room, first + full, n - full, used)
    closed = []
    for runs in free.values():
        closed += [(first, n, next(s for s in sizes if s >= used), used) for first, n, used in runs]
    return Plan(placed, sorted(closed))


def _numbered(pieces: DataFrame) -> DataFrame:
    """Adds number: 0, 1, ... within each length, by salt and then row; no task numbers more than a salt's share of a length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    order = W.partitionBy("length", "salt").orderBy("row", "piece", "key")
    inside = salted.withColumn("inside", F.row_number().over(order) - 1)
    return inside.join(before, ["length", "salt"]).select("key", "row", "piece", "length", (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("number"))


def _lookup(pieces: DataFrame, found: Plan) -> DataFrame:
    table = sorted(found.placed, key=lambda p: (p.length, p.first))
    cols = np.array(table, np.int64).reshape(-1, 6)
    # One sorted key for length and number: numbers stay below 2**48.
    keys = (cols[:, 0] << 48) + cols[:, 1]
    bins = np.array(found.bins, np.int64).reshape(-1, 4)
    sent = pieces.sparkSession.sparkContext.broadcast((keys, cols, bins))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cols, bins = sent.value
        for b in batches:
            length, number = np.asarray(b.column("length"), np.int64), np.asarray(b.column("number"), np.int64)
            hit = cols[np.searchsorted(keys, (length << 48) + number, side="right") - 1]
            nth = number - hit[:, 1]
            bin_ = hit[:, 3] + nth // hit[:, 4]
            box = bins[np.searchsorted(bins[:, 0], bin_, side="right") - 1]
            new = {"bin": bin_, "offset": hit[:, 5] + nth % hit[:, 4] * length, "size": box[:, 2], "used": box[:, 3]}
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "row": b.column("row"), "piece": b.column("piece"), "length": b.column("length"), **{k: pa.array(v) for k, v in new.items()}})

    kind = pieces.schema["key"].dataType.simpleString()
    return pieces.select("key", "row", "piece", "length", "number").mapInArrow(look, f"key {kind}, row long, piece int, length long, bin long, offset long, size long, used long")


def n_words(text: Column) -> Column:
    """Starts of words: characters that aren't white space after one that is."""
    return F.size(F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), lambda w: w != "")).cast("long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row per piece: (key, piece, start, length, bin, offset, size, used).

    A document of n tokens gives ceil(n / largest size) pieces; all but the last have the largest
    size. start is where a piece begins in its document, offset where in its bin; size is the bin's
    permitted length and used how much of it is filled. length names a column of token counts;
    without one, words are counted. Null and empty texts and counts below 1 take no room and give
    no rows. Repeated rows are packed each. An empty table gives no rows.
    """
    largest = max(sizes)
    counted = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row"), (F.col(length).cast("long") if length else n_words(F.col(text))).alias("n")).where("n > 0")
    each = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / largest).cast("int"))).alias("piece")
    pieces = cut(counted.select("key", "row", "n", each).select("key", "row", "piece", F.least(F.col("n") - F.col("piece").cast("long") * largest, F.lit(largest)).alias("length")))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().toLocalIterator()}  # at most as many rows as the largest size
    found = plan(histogram, sizes)
    return _lookup(_numbered(pieces), found).select(F.col("key").alias(key), "piece", (F.col("piece").cast("long") * largest).alias("start"), "length", "bin", "offset", "size", "used")


def pack_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """pack() with lengths and starts in tokens of a vocabulary, so that pieces begin and end between tokens."""
    return pack(token_counts(docs.select(key, text), model, text), key, text, "n_tokens", sizes)
