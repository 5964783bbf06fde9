"""Statistics of blocks of rows, and which blocks a predicate can skip.

Each column of a block has bounds both as text and as numbers, so that a comparison prunes by the
bounds that its own literal calls for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import literal_number, number
from ..plans.predicates import And, Cmp, Like, Missing, Not, Or, Predicate
from .table import Table

#: A column is numeric if at least this share of its filled cells in the first block are numbers.
NUMERIC_SHARE = (4, 5)


#: What a task says of the rows of a column that belong to one block and one split.
PART = "block long, split int, place int, start_row long, end_row long, min_str string, max_str string, min_num double, max_num double, empty_count long, cells long, numbers long, nans long"


def _facts(df: DataFrame) -> tuple[Column, Column, Column]:
    """Name, size and time of change of the file that a row comes from."""
    return F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_modification_time")


def _splits(df: DataFrame) -> DataFrame:
    """One row per input split, in order of files and places in them: its number, file, first row as Spark numbers rows, rows, and rows of those before it."""
    path, size, mtime = _facts(df)
    rows = df.select(path.alias("file"), F.col("_metadata.file_block_start").alias("at"), size.alias("file_size"), mtime.alias("file_mtime"), F.monotonically_increasing_id().alias("id"))
    found = rows.groupBy("file", "at", "file_size", "file_mtime").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    order = W.orderBy("file", "at")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return found.select("*", F.row_number().over(order).alias("split"), before.alias("before"))


def _parts(columns: int, block_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bounds of each column over the runs of rows (row, split, text and number of each column) of one block and split, one Arrow batch at a time."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, split = (batch.column(i).to_numpy() for i in (0, 1))
            block = row // block_rows
            start = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (split[1:] != split[:-1]))))
            size = np.diff(np.append(start, len(row)))
            run = np.repeat(np.arange(len(start)), size)
            for place in range(columns):
                text, value = batch.column(2 + 2 * place), batch.column(3 + 2 * place)
                finite = pc.if_else(pc.is_nan(value), None, value)
                runs = pa.table({"run": run, "text": text, "value": value, "finite": finite}).group_by("run", use_threads=False)
                r = runs.aggregate([("text", "min"), ("text", "max"), ("text", "count"), ("finite", "min"), ("finite", "max"), ("finite", "count"), ("value", "count")]).combine_chunks()
                filled, numbers = r["text_count"].to_numpy(), r["value_count"].to_numpy()
                columns_ = [block[start], split[start], np.full(len(start), place, np.int32), row[start], row[start] + size, r["text_min"], r["text_max"], r["finite_min"], r["finite_max"], size - filled, size, numbers, numbers - r["finite_count"].to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c.combine_chunks() for c in columns_], names=[c.split()[0] for c in PART.split(", ")])

    return found


def build_blocks(table: Table, block_rows: int = 65_536) -> DataFrame:
    """One row per block and column: block_id, start_row, end_row (exclusive), column, type, bounds as text and as
    numbers, empty_count, cells, and files (file, file_size, file_mtime), those that the block's rows come from.

    Rows are numbered through all files, in order of path and place in the file, and every block has
    block_rows of them, the last one the rest: so blocks may reach over input splits and files. A
    first pass counts the rows of each split; the second takes the bounds as rows stream by, so a task
    holds a batch of rows whatever the size of its split. What is put in order whole are the splits,
    a row each.
    """
    if block_rows < 1:
        raise ValueError("a block needs at least one row")
    path, _, _ = _facts(table.df)
    names = [f"__{kind}{i}" for i in range(len(table.header)) for kind in ("text", "value")]
    texts = [F.when(F.col(f"`{c}`").cast("string") != "", F.col(f"`{c}`").cast("string")) for c in table.df.columns[: len(table.header)]]
    cells = [c.alias(n) for n, c in zip(names, (c for t in texts for c in (t, number(t))), strict=True)]
    rows = table.df.select(F.monotonically_increasing_id().alias("__id"), path.alias("__file"), F.col("_metadata.file_block_start").alias("__at"), *cells)
    splits = _splits(table.df)
    of = splits.select(F.col("file").alias("__file"), F.col("at").alias("__at"), "first", "rows", "before", "split")
    within = F.col("__id") - F.col("first")
    row = F.when(within.between(0, F.col("rows") - 1), F.col("before") + within).otherwise(F.raise_error(F.lit("the files were split otherwise while their rows were counted")))
    placed = rows.join(F.broadcast(of), ["__file", "__at"], "left").select(row.cast("long").alias("__row"), F.col("split").alias("__split"), *names)
    parts = placed.mapInArrow(_parts(len(table.header), block_rows), PART)
    files = splits.select("split", F.struct("file", "file_size", "file_mtime").alias("from"))
    stats = parts.join(F.broadcast(files), "split").groupBy("block", "place").agg(
        F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row"), F.min("min_str").alias("min_str"), F.max("max_str").alias("max_str"), F.min("min_num").alias("min_num"), F.max("max_num").alias("max_num"),
        *[F.sum(c).alias(c) for c in ("empty_count", "cells", "numbers", "nans")], F.array_sort(F.collect_set("from")).alias("files"),
    )
    few, many = NUMERIC_SHARE
    filled = F.col("cells") - F.col("empty_count")
    kind = F.when((filled > 0) & (F.col("numbers") * many >= filled * few), "numeric").otherwise("string")
    column = F.element_at(F.array(*map(F.lit, table.header)), F.col("place") + 1)
    return stats.select("*", F.first(kind).over(W.partitionBy("place").orderBy("block")).alias("type")).select(
        F.col("block").alias("block_id"), "start_row", "end_row", column.alias("column"), "type", "min_str", "max_str", "min_num", "max_num", "empty_count", "cells", "numbers", "nans", "files"
    )


def is_current(blocks: DataFrame, table: Table) -> bool:
    """Whether files, sizes, times of change and header are those that the statistics were taken from."""
    path, size, mtime = _facts(table.df)
    now = {tuple(r) for r in table.df.select(path, size, mtime).distinct().collect()}
    then = {tuple(r) for r in blocks.select(F.inline("files")).distinct().collect()}
    names = {r[0] for r in blocks.select("column").distinct().collect()}
    return now == then and names == set(table.header)


def can_skip(predicate: Predicate) -> Column:
    """Over a map s of lower-case column name to statistics: no row of the block can match. NOT never skips."""
    match predicate:
        case And(a, b):
            return can_skip(a) | can_skip(b)
        case Or(a, b):
            return can_skip(a) & can_skip(b)
        case Not() | Like() | Missing():
            return F.lit(False)
        case Cmp(name, op, value):
            stats = F.element_at("s", F.lit(name.strip().lower()))
            return F.coalesce(_excluded(stats, op, value), F.lit(False))
    raise TypeError(f"not a predicate: {predicate!r}")


def _excluded(s: Column, op: str, value: object) -> Column:
    as_number = literal_number(value)
    if as_number is not None:
        low, high, literal, none = s["min_num"], s["max_num"], F.lit(as_number), s["numbers"] == 0
        never = (s["nans"] == 0) | F.lit(op != "!=")
    else:
        low, high, literal, none = s["min_str"], s["max_str"], F.lit(str(value)), s["cells"] == s["empty_count"]
        # An empty cell is a text too: it is below every other literal.
        never = (s["empty_count"] == 0) | F.lit(op in ("=", ">", ">=") and str(value) != "")
    outside = {
        "=": (literal < low) | (literal > high), "!=": (low == literal) & (high == literal),
        ">": high <= literal, ">=": high < literal, "<": low >= literal, "<=": low > literal,
    }[op]
    return never & (F.coalesce(outside, F.lit(False)) | none)


def blocks_to_read(blocks: DataFrame, predicate: Predicate) -> DataFrame:
    """(block_id, start_row, end_row, files) of the blocks that may hold a match."""
    stats = F.map_from_entries(F.collect_list(F.struct(F.lower(F.trim("column")), F.struct("min_str", "max_str", "min_num", "max_num", "empty_count", "cells", "numbers", "nans"))))
    by_block = blocks.groupBy("block_id").agg(stats.alias("s"), F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row"), F.first("files").alias("files"))
    return by_block.where(~can_skip(predicate)).select("block_id", "start_row", "end_row", "files")


def save_blocks(blocks: DataFrame, folder: str) -> None:
    """Keeps the statistics as Parquet."""
    blocks.write.mode("overwrite").parquet(folder)


def load_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def pruned_scan(table: Table, blocks: DataFrame, predicate: Predicate) -> Table:
    """The rows that match, read only from files with a block that may hold one.

    Statistics that no longer fit the files are not used: then the whole table is read. Inside a file
    Spark splits by bytes; there row groups of Parquet skip, see to_sorted_parquet(). The names of
    files are on the driver as they are in every scan.
    """
    if not is_current(blocks, table):
        return table.where(predicate)
    files = [r["file"] for r in blocks_to_read(blocks, predicate).select(F.inline("files")).select("file").distinct().collect()]
    return replace(table, df=table.df.where(F.col("_metadata.file_path").isin(files))).where(predicate)


def to_sorted_parquet(table: Table, folder: str, *columns: str) -> None:
    """The same rows as Parquet sorted by the columns that filters use: row-group statistics then skip blocks in every scan."""
    df = table.to_df()
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(folder)
