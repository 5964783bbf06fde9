"""Small helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a computed value once for an expression that uses it several times."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, *values: Column) -> DataFrame:
    """Adds computed columns through a generator, which filters and projections above don't copy: each value is computed once a row."""
    return df.select("*", F.inline(F.array(F.struct(*values))))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drops columns whose names an operator is about to write, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def words(text: Column) -> Column:
    """Words of a text (runs of anything but white space); null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_by_bytes() -> bytes:
    """For each byte what it becomes before words are told by spaces: lower case A-Z, and a space for white space."""
    return _SPACED


_SPACED = bytes(32 if chr(b) in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Numbers that are summed at once.
BLOCK = 256


def sums_before(numbers: Column) -> Column:
    """For each long of an array the sum of those before it; in blocks, so that long arrays don't take quadratic time."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    last = F.floor((F.size(numbers) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(numbers, b * BLOCK + 1, BLOCK))

    def inside(part: Column, at: Column) -> Column:
        return F.transform(part, lambda _, j: at + total(F.slice(part, F.lit(1), j)))

    def placed(parts: Column) -> Column:
        return let(F.transform(parts, total), lambda sums: F.flatten(F.transform(parts, lambda part, i: let(total(F.slice(sums, F.lit(1), i)), lambda at: inside(part, at)))))

    return let(blocks, placed)


def count_where(spans: Column, field: str, value: object) -> Column:
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")


def joined_spans(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def batches(texts: list[bytes | None], size: int) -> Iterator[list[bytes | None]]:
    """The texts in order, about size bytes at once and one text at least."""
    batch, held = [], 0
    for t in texts:
        batch.append(t)
        held += len(t or b"")
        if held >= size:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows go to a Parquet table below spark.checkpoint.dir, which outlives lost executors.

    A table that is read again has its own size and no history; a checkpoint would hand on the
    estimated sizes and constraints of its plan, and these multiply from round to round of a loop.
    Only where that setting is absent (tests on one machine) a temporary folder stands in. The tables
    of an application go when Python ends, or earlier by release().
    """
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or os.path.join(tempfile.gettempdir(), "quillon-checkpoints")
    folder = f"{top.rstrip('/')}/quillon-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


#: Rows, or elements of arrays in them, that are sent to all tasks at most: some tens of MB.
SENT = 1 << 21


def sized(table: DataFrame, weight: Column | None = None) -> DataFrame:
    """A side of a join, to be sent to all tasks if it is small, else shuffled as any other. table: from cut(), rows of a few longs; weight: elements of the arrays in a row."""
    n = table.agg(F.sum(1 + weight) if weight is not None else F.count("*")).first()[0] or 0
    return F.broadcast(table) if n <= SENT else table


def release(table: DataFrame) -> None:
    """Deletes the files of a table that cut() wrote and nobody reads any more."""
    _delete(table.sparkSession, table.written_to)


_FOLDERS: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    if jvm := spark.sparkContext._jvm:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
