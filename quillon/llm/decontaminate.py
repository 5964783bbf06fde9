"""Benchmark passages in training documents, by winnowing.

Texts become sequences of words, and words become 64-bit hashes. Every GRAM consecutive words have a
hash, and of every SLIDE consecutive grams the least hash is a fingerprint. Two texts that share
GRAM + SLIDE - 1 = 10 words in a row share a fingerprint there, so each shared window of ten words is
met. A fingerprint that a document shares with an item is extended to the windows of ten words
around it, which are then compared word by word. Items of fewer than ten words are one window each
and are looked for at every position.

The fingerprints and windows of the items are sent to the tasks in blocks of bounded size. Most
benchmarks fit in one block; more blocks are further passes over the documents, with a checkpoint
after each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, without

WINDOW, GRAM = 10, 5
SLIDE = WINDOW - GRAM + 1
#: Bytes of item texts in a block; a task holds about five times as much of the items.
BLOCK_BYTES = 16 << 20
#: Bytes of documents that are hashed at once.
BATCH_BYTES = 1 << 19

#: Lower case, and a space for every byte that is no part of a word: words are digits, letters and bytes from 128 on.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(27))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """Words of several texts, one after the other: folded bytes, start and end of each word, its hash, first word of each text."""

    folded: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def window(self, at: int, n: int) -> list[bytes]:
        return [self.folded[a:b] for a, b in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True)]


#: Bytes for which the powers are kept; longer texts make theirs.
KEPT = 1 << 20


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _prefix_powers(KEPT)


def _prefix_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    return _powers(size), np.multiply.accumulate(inverse)


class Bytes(NamedTuple):
    """Folded bytes of several texts, one after the other, with what gives the hash of any run of them."""

    folded: bytes
    sums: np.ndarray
    inverse: np.ndarray

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each run the sum of its bytes, each plus one and times a power of the base that grows from its start."""
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def read_bytes(folded: bytes) -> Bytes:
    data = np.frombuffer(folded, np.uint8)
    powers, inverse = _kept_powers() if len(data) <= KEPT else _prefix_powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return Bytes(folded, sums, inverse)


def word_edges(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of anything but spaces."""
    inside = np.frombuffer(b" " + folded + b" ", np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def read_words(texts: list[bytes | None], fold: bytes = _FOLD) -> Words:
    """The words of the texts after each byte went through fold, which makes a space of whatever ends a word."""
    parts = [(t or b"").translate(fold) for t in texts]
    data = read_bytes(b" ".join(parts) + b" ")
    start, end = word_edges(data.folded)
    offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return Words(data.folded, start, end, data.hash(start, end), np.searchsorted(start, offsets))


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... length - 1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * _BASE + hashes[i : len(hashes) - n + 1 + i]
    return _mixed(out)


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Positions of the least gram of every SLIDE consecutive ones; of equal ones the last."""
    if len(grams) < SLIDE:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, SLIDE)
    last = SLIDE - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(np.arange(len(views)) + last)


class Windows(NamedTuple):
    """Windows of one length: sorted distinct hashes; from where in word and item the windows of each hash are listed; and those lists."""

    hash: np.ndarray
    first: np.ndarray
    word: np.ndarray
    item: np.ndarray


class Index(NamedTuple):
    """Of a block of items: their folded text with the places of all words, their ids, sorted fingerprints, and windows by length.

    It takes about 26 bytes a word besides the ids.
    """

    folded: bytes
    start: np.ndarray
    end: np.ndarray
    ids: list[list[str]]
    prints: np.ndarray
    windows: dict[int, Windows]

    def words(self, at: int, n: int) -> list[bytes]:
        return [self.folded[a:b] for a, b in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True)]

    def items(self, n: int, at: int, words: list[bytes]) -> list[int]:
        """Items with a window of these words, given where its hash is among those of its length."""
        w = self.windows[n]
        listed = range(int(w.first[at]), int(w.first[at + 1]))
        return [int(w.item[i]) for i in listed if self.words(int(w.word[i]), n) == words]


def build_index(rows: list[tuple[str, bytes]]) -> Index:
    same = defaultdict(set)  # items with the same words count as one until the end
    for item, text in rows:
        same[b" ".join(text.translate(_FOLD).split())].add(item)
    texts = sorted(t for t in same if t)
    w = read_words(texts)
    sizes = np.diff(w.first)
    windows, prints = {}, [np.zeros(0, np.uint64)]
    for n in sorted(set(np.minimum(sizes, WINDOW).tolist())):
        chosen = np.flatnonzero(np.minimum(sizes, WINDOW) == n)
        count = sizes[chosen] - n + 1
        at = np.repeat(w.first[chosen], count) + _ramp(count)
        hashes, item = runs(w.hash, n)[at], np.repeat(chosen, count)
        order = np.lexsort((item, hashes))
        distinct, first = np.unique(hashes[order], return_index=True)
        windows[n] = Windows(distinct, np.append(first, len(order)), at[order].astype(np.int32), item[order].astype(np.int32))
        if n == WINDOW:
            prints += [(g := runs(w.hash[w.first[i] : w.first[i + 1]], GRAM))[winnowed(g)] for i in chosen.tolist()]
    return Index(w.folded, w.start.astype(np.int32), w.end.astype(np.int32), [sorted(same[t]) for t in texts], np.unique(np.concatenate(prints)), windows)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def find_hits(texts: list[bytes | None], index: Index) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text its number of words, the hit spans of words (start, end) and the items found."""
    w = read_words(texts)
    starts = []
    if WINDOW in index.windows:
        grams = runs(w.hash, GRAM)
        spots = winnowed(grams)  # over the whole batch: windows within a text select the same as in the text alone
        spots = spots[_among(grams[spots], index.prints)]
        around = np.unique((spots[:, None] - np.arange(SLIDE)).ravel())
        starts.append((WINDOW, around[(around >= 0) & (around <= len(w.hash) - WINDOW)]))
    starts += [(n, np.arange(max(0, len(w.hash) - n + 1))) for n in index.windows if n < WINDOW]
    found: dict[int, tuple[list[tuple[int, int]], set[int]]] = defaultdict(lambda: ([], set()))
    for n, at in starts:
        known = index.windows[n].hash
        at = at[_among(runs(w.hash, n)[at], known)] if len(at) else at
        text = np.searchsorted(w.first, at, side="right") - 1
        inside = at + n <= w.first[np.minimum(text + 1, len(w.first) - 1)]
        at, text = at[inside], text[inside]
        where = np.searchsorted(known, runs(w.hash, n)[at]) if len(at) else at
        for k, p, i in zip(text.tolist(), at.tolist(), where.tolist(), strict=True):
            if items := index.items(n, i, w.window(p, n)):
                found[k][0].append((p - int(w.first[k]), p - int(w.first[k]) + n))
                found[k][1].update(items)
    sizes = np.diff(w.first).tolist()
    ids = lambda items: sorted({i for item in items for i in index.ids[item]})
    return [(sizes[k], _merged(found[k][0]), ids(found[k][1])) if k in found else (sizes[k], [], []) for k in range(len(texts))]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])
ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _hits(index: Broadcast, text: str) -> Column:
    @F.arrow_udf(HITS)
    def found(texts: pa.Array) -> pa.Array:
        rows, batch, size = [], [], 0
        for t in texts.cast(pa.binary()).to_pylist():
            batch.append(t)
            size += len(t or b"")
            if size >= BATCH_BYTES:
                rows += find_hits(batch, index.value)
                batch, size = [], 0
        rows += find_hits(batch, index.value) if batch else []
        return pa.array([{"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": items} for n, spans, items in rows], ARROW)

    return found(F.col(text))


def _parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts of about limit bytes; each starts with the WINDOW - 1 words before it, so that every window is in one of them."""
    while len(text) > 2 * limit:
        cut_at = text.rfind(b" ", 0, limit)
        head = text[: cut_at if cut_at > 0 else limit]
        before = head.split()[1 - WINDOW :]
        # A part without enough spaces for its window isn't split.
        if len(before) < WINDOW - 1 or cut_at <= 0 or sum(map(len, before)) > limit // 2:
            break
        yield head
        text = b" ".join(before) + text[cut_at:]
    yield text


def _blocks(items: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The distinct items in blocks of about limit bytes; longer ones are split. One partition of items is on the driver at a time."""
    kept = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").distinct()
    block, held, none = [], 0, True
    for r in kept.toLocalIterator():
        for part in _parts(b" ".join(r["t"].encode().translate(_FOLD).split()), limit):
            block.append((r["i"], part))
            held += len(part) + 64
            if held >= limit:
                yield block
                block, held, none = [], 0, False
    if block or none:
        yield block


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, hit_spans (array of start, end in words), item_ids (found items as strings) and contaminated to every row.

    A window is ten consecutive words of an item, or all words of a shorter item; words inside any
    occurrence of a window are hit. Null and empty texts have no words; items without words have no
    window; a null item id is the empty string. Repeated rows are searched each, repeated items
    count once by id. Without items nothing is hit. Columns with the names of the new ones are replaced.
    """
    new = ("n_words", "hit_spans", "item_ids", "contaminated")
    out = without(docs, new)
    names = out.columns
    spark, hits = docs.sparkSession, []
    for b, rows in enumerate(_blocks(items, item, text, block_bytes)):
        if b:
            out = cut(out)
        out = out.withColumn(f"__hits{b}", _hits(spark.sparkContext.broadcast(build_index(rows)), text))
        hits.append(f"__hits{b}")
    spans = F.array_distinct(F.flatten(F.array(*[F.col(h)["spans"] for h in hits])))
    ids = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(h)["items"] for h in hits]))))
    return out.select(*[F.col(f"`{c}`") for c in names], F.col(hits[0])["n_words"].alias("n_words"), F.sort_array(spans).alias("hit_spans"), ids.alias("item_ids"), (F.size(ids) > 0).alias("contaminated"))


def covered(spans: Column) -> Column:
    """Numbers inside any of an array of spans (start, end) in order of start."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", covered(F.col("hit_spans")).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
