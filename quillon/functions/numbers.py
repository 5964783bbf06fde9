"""Cells of text as numbers, and numbers as text."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number: decimal digits with an optional exponent, or a word for infinity or not-a-number.
NUMBER = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity)|(?i:nan))$"
_NUMBER, _INFINITE = re.compile(NUMBER, re.ASCII), re.compile(r"^[+-]?inf", re.IGNORECASE)


def number(cell: Column) -> Column:
    """A text cell as a double; null for anything else, spaces and overflowing digits included."""
    value = F.when(cell.rlike(NUMBER), cell.try_cast("double"))
    return F.when(F.abs(value) == float("inf"), F.when(cell.rlike("(?i)inf"), value)).otherwise(value)


def literal_number(value: object) -> float | None:
    """The number that a literal stands for, by the same rules; quoting doesn't matter."""
    text = str(value)
    if not _NUMBER.match(text):
        return None
    found = float(text)
    return None if math.isinf(found) and not _INFINITE.match(text) else found


def two_places(value: float) -> str:
    """Two decimals, ties of the exact binary value to even."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "+Inf" if value > 0 else "-Inf"
    return f"{value:.2f}"
