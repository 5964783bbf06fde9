"""Tables from CSV files, Parquet files, standard input and streams."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.table import Table

#: The dialect: commas, doubled quotes, nothing trimmed, short rows filled and long ones cut.
CSV = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "inferSchema": "false", "maxCharsPerColumn": "-1"}


#: Bytes of standard input that are written at once.
SPOOLED = 1 << 20


def _header(spark: SparkSession, path: str, multiline: bool) -> list[str]:
    first = spark.read.options(**CSV | {"header": "false", "multiLine": str(multiline).lower()}).csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty: no header line")
    return [c or "" for c in first[0]]


def _schema(n: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])


def _filled(df: DataFrame) -> DataFrame:
    """Missing and empty cells are the empty text."""
    return df.select([F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> Table:
    """A CSV file with a header line; every cell is text. multiline reads quoted line breaks, in one task a file."""
    header = _header(spark, path, multiline)
    df = spark.read.options(**CSV | {"enforceSchema": "true", "multiLine": str(multiline).lower()}).schema(_schema(len(header))).csv(path)
    return Table(_filled(df), header)


def read_parquet(spark: SparkSession, path: str) -> Table:
    return Table.of(spark.read.parquet(path))


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; only without a configured one a local temporary folder. It goes when Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = f"{shared.rstrip('/')}/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="quillon-")
    atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    if Path(folder).is_dir():
        shutil.rmtree(folder, ignore_errors=True)
    elif spark.sparkContext._jsc:  # not stopped
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def read_stdin(spark: SparkSession, source: BinaryIO | None = None, folder: str | None = None) -> Table:
    """CSV from standard input, spooled first to a file in a folder that driver and executors share."""
    spool = f"{(folder or scratch(spark)).rstrip('/')}/stdin.csv"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(spool)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        while part := (source or sys.stdin.buffer).read(SPOOLED):
            out.write(bytearray(part))
    finally:
        out.close()
    return read_csv(spark, spool)


def stream_csv(spark: SparkSession, folder: str, header: list[str], files_per_trigger: int | None = None) -> Table:
    """CSV files as they arrive in a folder; each has a header line with the given names."""
    reader = spark.readStream.options(**CSV).schema(_schema(len(header)))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return Table(_filled(reader.csv(folder)), header)
