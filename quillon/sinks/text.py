"""Results as CSV text, CSV folders and JSON."""

from __future__ import annotations

from typing import TextIO

from ..functions.numbers import two_places
from ..operators.table import POSITION, Table

#: Options under which Spark writes what read_csv() reads back unchanged.
CSV_OUT = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _quoted(cell: str) -> str:
    if cell and (any(c in cell for c in ',"\r\n') or cell[0].isspace() or cell == "\\."):
        return '"' + cell.replace('"', '""') + '"'
    return cell


def _text(value: object) -> str:
    if value is None:
        return ""
    return two_places(value) if isinstance(value, float) else str(value)


def write_csv_text(table: Table, out: TextIO) -> int:
    """Writes header and rows to a text stream, in file or first-appearance order if the table is ordered.

    Aggregates and other doubles get two decimals; an average of no number is 0, a least or largest one empty. Rows pass the driver one partition at a time.
    Returns the number of rows.
    """
    table = table.numbered()
    df = table.df.orderBy(POSITION).drop(POSITION) if table.is_ordered else table.df
    out.write(",".join(map(_quoted, table.header)) + "\n")
    n = 0
    for row in df.toLocalIterator():
        out.write(",".join("0" if v is None and i in table.averages else _quoted(_text(v)) for i, v in enumerate(row)) + "\n")
        n += 1
    return n


def write_csv(table: Table, folder: str) -> None:
    table.to_df().write.options(**CSV_OUT).mode("overwrite").csv(folder)


def write_json(table: Table, folder: str) -> None:
    table.to_df().write.mode("overwrite").json(folder)


def show(table: Table, n: int = 20) -> None:
    table.to_df().show(n, truncate=False)
