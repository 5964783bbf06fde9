"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprints within the radius of two bits collide for certain in one of seven tables. Every bit has
one of the seven non-zero vectors of three bits; a table's mask holds the bits whose vector has an
odd product with the table's own vector. Two differing bits span at most a plane of the three
dimensions, so some table's vector is orthogonal to both, and its mask misses both bits.

Inside a bucket, fingerprints within two bits share a neighbour at one bit from either (or one is
itself at one bit from the other), and the differing bits lie outside the mask. So each fingerprint
of a shared bucket names itself and its neighbours in the free bits, and those that name the same
value form a group that lies within the radius. A bucket of n fingerprints costs n times a constant,
never n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, cut, sized, without, words_by_bytes
from .components import components, star
from .decontaminate import read_words, runs
from .linking import linked

BITS, SEED = 64, 42
#: Shingles that are hashed at once.
CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int) -> list[int]:
    """For each table the bits that its key keeps: fingerprints within the radius agree in one of 2**(radius + 1) - 1 tables."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


MASKS = covering_masks(2)


def fingerprint(text: bytes | None, size: int, seed: int = SEED) -> int:
    """Unsigned SimHash of the shingles of a UTF-8 text, repeats included; no words give zero."""
    words = text.lower().split() if text else []  # of bytes: both know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + size - 1] if n > 1 else words
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False)) if n > 1 else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the SimHash over shingles of so many words as a long; null and empty texts have zero."""

    @F.arrow_udf(T.LongType())
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(fingerprint(x, size)) for x in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return without(docs, (name,)).withColumn(name, hashed(F.col(text)))


def close_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within two bits of each other; prints: distinct (fingerprint)."""
    keyed = prints.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(_signed(m)).alias("key")) for t, m in enumerate(MASKS)])).alias("k")).select("fingerprint", "k.*")
    shared = keyed.groupBy("t", "key").count().where("count > 1").select("t", "key")
    free = F.element_at(F.array(*[F.lit(_signed(m ^ (1 << BITS) - 1)) for m in MASKS]), F.col("t") + 1)
    crowded = keyed.join(shared, ["t", "key"]).groupBy("fingerprint").agg(F.bit_or(free).alias("free"))
    bits = F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)])
    near = F.transform(F.filter(bits, lambda b: F.col("free").bitwiseAND(b) != 0), lambda b: F.col("fingerprint").bitwiseXOR(b))
    named = crowded.select("fingerprint", F.explode(F.concat(F.array("fingerprint"), near)).alias("named"))
    # At most 65 fingerprints name a value: itself and its neighbours.
    groups = named.groupBy("named").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"), F.collect_set("fingerprint").alias("members")).where("low <> high")
    return groups.select(F.explode(star(F.col("members"), F.col("low"))).alias("e")).select("e.*").distinct()


def near_groups(docs: DataFrame, size: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) of every row: the smallest key reachable over fingerprints within two bits.

    Rows with the same fingerprint are linked, also those without words, whose fingerprint is zero. A
    component whose keys are all null has a null id; null keys otherwise take their component's id.
    Repeated rows come out as often as they went in; an empty table gives no rows. Other columns are
    not looked at.
    """
    rows = cut(fingerprints(docs.select(key, text), size, text).select(key, "fingerprint"))
    prints = cut(rows.groupBy("fingerprint").agg(F.min(key).alias("least")))
    found = components(close_links(prints.select("fingerprint")))
    linked = found.join(prints, found["node"] == prints["fingerprint"]).select("root", "fingerprint", "least")
    whole = linked.groupBy("root").agg(F.min("least").alias("whole"))
    named = linked.join(whole, "root").select("fingerprint", "whole")
    labels = prints.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("whole", "least").alias("component_id"))
    return rows.join(labels, "fingerprint").select(key, "fingerprint", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: Near duplicates by shingles: words of a shingle, least Jaccard similarity, least hashes of a text that are kept and that are keys.
SHINGLE, SIMILAR, SAMPLE, KEYS = 5, 0.8, 32, 10
#: Of SAMPLE hashes of two texts together, shared ones that similar texts have for certain: 25.6 are expected at SIMILAR, with a deviation of 2.3.
SHARED = 14
#: Bits in which the fingerprints of similar texts may differ: 9.7 are expected at SIMILAR, with a deviation of 2.9.
FAR = 26
#: Bytes of texts that are hashed at once.
BATCH_BYTES = 1 << 19


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles; a shorter text is one shingle, a text without words has none."""
    for batch in batches(texts, BATCH_BYTES):
        w = read_words(batch, words_by_bytes())
        for a, b in pairwise(w.first.tolist()):
            yield np.unique(runs(w.hash[a:b], min(SHINGLE, b - a))) if b > a else w.hash[:0]


def _simhash(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view("<i8")[0])


SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("print", T.LongType()), T.StructField("least", T.ArrayType(T.LongType()))])
ARROW = pa.struct([("n", pa.int64()), ("print", pa.int64()), ("least", pa.list_(pa.int64()))])


@F.arrow_udf(SKETCH)
def _sketched(texts: pa.Array) -> pa.Array:
    """The number of distinct shingles, their SimHash and the least of their hashes in order."""
    rows = [{"n": len(s), "print": _simhash(s), "least": s[:SAMPLE].view(np.int64).tolist()} for s in shingle_sets(texts.cast(pa.binary()).to_pylist())]
    return pa.array(rows, ARROW)


@F.arrow_udf(T.BooleanType())
def _similar(x: pa.Array, y: pa.Array) -> pa.Array:
    """Whether the shingles of two texts reach the similarity, by whole sets."""
    pairs = zip(shingle_sets(x.cast(pa.binary()).to_pylist()), shingle_sets(y.cast(pa.binary()).to_pylist()), strict=True)
    return pa.array([bool(n := len(np.intersect1d(s, t, assume_unique=True))) and n >= SIMILAR * (len(s) + len(t) - n) - 1e-9 for s, t in pairs], pa.bool_())


def _likely(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs that the samples don't rule out: (a, b, sure), sure where the samples are the whole sets and reach the similarity."""
    x, y = (prints.select(F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("least").alias(f"l_{i}")) for i in ("a", "b"))
    both = F.size(F.array_intersect("l_a", "l_b"))
    # Unsigned order: the least of two samples together are the least of the texts together.
    flipped = lambda v: v.bitwiseXOR(F.lit(-(1 << 63)))
    union = F.slice(F.array_sort(F.transform(F.array_union("l_a", "l_b"), flipped)), 1, SAMPLE)
    shared = F.size(F.array_intersect(F.transform(F.array_intersect("l_a", "l_b"), flipped), union))
    whole = (F.col("n_a") <= SAMPLE) & (F.col("n_b") <= SAMPLE)
    close = F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b") - 1e-9
    reached = both >= SIMILAR * (F.col("n_a") + F.col("n_b") - both) - 1e-9
    found = pairs.join(x, "a").join(y, "b").where(close & (both > 0))
    return found.where(F.when(whole, reached).otherwise(shared >= SHARED)).select("a", "b", whole.alias("sure"))


#: The sample as a set of 256 bits, one for each hash by its low bits.
MARKS = "transform(sequence(0, 3), w -> aggregate(filter(least, h -> (shiftright(h, 6) & 3) = w), 0L, (s, h) -> s | shiftleft(1L, CAST(h & 63 AS INT))))"


def _possible(n_x: np.ndarray, n_y: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False only for pairs that _likely() rules out: shared hashes have shared bits, less those that fall together in one of the samples."""
    bits = lambda m: np.bitwise_count(m.view(np.uint64)).sum(axis=1, dtype=np.int64)
    lost = np.minimum(np.minimum(n_x, SAMPLE) - bits(x), np.minimum(n_y, SAMPLE) - bits(y))
    whole = (n_x <= SAMPLE) & (n_y <= SAMPLE)
    return bits(x & y) + lost >= np.where(whole, SIMILAR / (1 + SIMILAR) * (n_x + n_y) - 1e-9, SHARED)


def similar_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, root) of the distinct texts, by hash, that are linked to others.

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more, which is
    checked on the whole sets. Texts are compared if their fingerprints collide in a covering table,
    or if they share one of their KEYS least shingle hashes and their fingerprints aren't far apart.
    Of two texts of that similarity each of the least hashes of both together is shared with a
    chance of 0.8, so they share none with a chance below 1e-6.
    """
    told = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("id"), F.col(text).alias("text"))
    sketched = told.select("id", _sketched("text").alias("s")).groupBy("id").agg(F.min("s").alias("s"))
    prints = cut(sketched.where("s.n > 0").select("id", "s.*"))
    covering = [F.xxhash64(F.lit(t), F.col("print").bitwiseAND(_signed(m))) for t, m in enumerate(MASKS)]
    keyed = cut(prints.select("id", "print", F.col("n").alias("size"), F.slice("least", 1, KEYS).alias("keys"), F.array(*covering).alias("strong"), F.expr(MARKS).alias("marks")))

    def similar(pairs: DataFrame) -> DataFrame:
        likely = cut(_likely(pairs, prints))
        unsure = likely.where("NOT sure").select("a", "b")
        wanted = cut(unsure.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        texts = cut(told.join(sized(wanted), "id").groupBy("id").agg(F.min("text").alias("text")))
        x, y = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
        checked = unsure.join(x, "a").join(y, "b").where(_similar("x", "y")).select("a", "b")
        return likely.where("sure").select("a", "b").unionByName(checked)

    return linked(keyed, FAR, SIMILAR, similar, _possible)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows less all but one of each group of equal or similar texts; the one with the least key (nulls last) stays.

    Equal texts are one group, null and empty ones together. Of repeated rows one stays. Texts
    without words are similar to equal ones only. Of texts of any length the whole is compared. An
    empty table stays empty; columns don't change, whatever their names.
    """
    rows = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("id"), F.col(key).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    groups = similar_texts(docs, text)
    keys = rows.select("id", F.struct(F.col("key").isNull().alias("none"), "key", "id").alias("at")).groupBy("id").agg(F.min("at").alias("at"))
    stays = keys.join(groups, keys["id"] == groups["node"], "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("at").alias("at")).select("at.id", F.col("at.key").alias("first"))
    kept = rows.join(stays, "id").where(F.col("key").eqNullSafe(F.col("first"))).dropDuplicates(["id", "key"])
    return kept.select("doc.*")
