"""Personal data in whole texts, found with DataFrame functions only.

Regular expressions propose spans, checksums confirm them, and words near a span adjust its score.
Positions are in code points, ends exclusive. They come from the lengths of the pieces between the
matches of a pattern, so a text is scanned a second time only where something matched.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_where, joined_spans, let, lower_ascii, sums_before, without


class Kind(NamedTuple):
    """pattern: proposes spans, possessive so that long runs take linear time; hint: a cheap test that texts with a match pass;
    valid: confirms a match; score: without context; context: words that raise it; always: kept at any score."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    context: str
    always: bool


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, "\\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda d: (F.length(d) <= 2) | ((F.length(d) == 3) & (d <= "255"))))


def _luhn(match: Column) -> Column:
    return let(_digits(match), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))


def _iban(match: Column) -> Column:
    """Mod-97: the first four characters go last, letters count 10 to 35, the remainder must be 1."""
    flat = F.translate(match, " ", "")

    def remainder(s: Column) -> Column:
        turned = F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), "")
        step = lambda acc, c: let(F.ascii(c), lambda a: F.when(a < 58, (acc * 10 + a - 48) % 97).otherwise((acc * 100 + a - 55) % 97))
        return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step)

    return let(flat, lambda s: F.length(s).between(15, 34) & (remainder(s) == 1))


def _national_id(match: Column) -> Column:
    area = F.substr(match, F.lit(1), F.lit(3))
    return ~area.isin("000", "666") & (area < "900") & (F.substr(match, F.lit(5), F.lit(2)) != "00") & (F.substr(match, F.lit(8), F.lit(4)) != "0000")


_true = lambda c: F.lit(True)
_has_digit = lambda t: t.rlike("[0-9]")

#: In the order in which kinds count at the same start. The first four are always kept; the others need context or a checksum.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), _true, 0.9, "mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _has_digit, _octets, 0.6, r"\bip\b|host|server|address", True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _has_digit, _luhn, 0.7, "card|visa|master|credit|debit|payment", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(9, 15), 0.7, "phone|tel|call|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _has_digit, _iban, 0.8, "iban|account|bank|konto|compte|cuenta", False),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.contains("-"), _national_id, 0.3, r"ssn|social security|national id|\bid\b", False),
    Kind("local_phone", r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", _has_digit, _true, 0.3, "phone|tel|call|mobile|fax", False),
)
BASE = 4
#: Characters before a span, up to the match before the last one of its kind, in which context words count, what they add, and the score that an uncertain kind needs.
NEAR, LIFT, LEAST = 40, 0.3, 0.5


def _spans(kind: Kind, rank: int, text: Column, found: Column) -> Column:
    """Spans of the matches found; null where there is none."""

    def build(gaps: Column) -> Column:
        # Lengths of gap, match, gap, match, ...: every second running sum is where a match starts.
        lengths = F.flatten(F.transform(found, lambda m, i: F.array(F.length(gaps[i]).cast("long"), F.length(m).cast("long"))))
        return let(sums_before(lengths), lambda at: F.transform(found, lambda m, i: span(m, at[i * 2 + 1], before(gaps, i))))

    def before(gaps: Column, i: Column) -> Column:
        # From the pieces before the match: a look into the whole text would walk it from its start each time.
        return F.right(F.concat(F.when(i > 0, F.concat(F.right(gaps[i - 1], F.lit(NEAR)), found[i - 1])).otherwise(""), gaps[i]), F.lit(NEAR))

    def span(m: Column, start: Column, near: Column) -> Column:
        score = F.lit(kind.score) + F.when(lower_ascii(near).rlike(kind.context), F.lit(LIFT)).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end"), F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"), kind.valid(m).alias("valid"))

    kept = F.filter(let(F.split(text, kind.pattern, -1), build), lambda s: s["valid"] if kind.always else s["valid"] & (s["score"] >= LEAST))
    return F.when(F.size(found) > 0, F.transform(kept, lambda s: s.dropFields("valid")))


SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double>"


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds pii, an array of struct(start, rank, end, kind, score) by start and then kind, to every row.

    The kinds email, ip, card and phone are found leftmost and without overlap within the kind, and
    kept if they pass their check. IBANs need a mod-97 check, national numbers and local phone
    numbers a context word. Spans of different kinds may overlap. Null and empty texts have no
    spans; repeated rows are scanned each on their own; an input column named pii is replaced.
    """
    base = without(docs, ("pii",))
    value = F.coalesce(F.col(text), F.lit(""))
    names = [f"__{k.name}" for k in KINDS]
    none = F.array().cast("array<string>")
    found = base.select("*", *[F.when(k.hint(value), F.regexp_extract_all(value, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(n) for k, n in zip(KINDS, names, strict=True)])
    spans = [F.coalesce(_spans(k, i, value, F.col(n)), F.array().cast(f"array<{SPAN}>")) for i, (k, n) in enumerate(zip(KINDS, names, strict=True))]
    any_found = F.greatest(*[F.size(n) for n in names]) > 0
    merged = F.when(any_found, F.sort_array(F.concat(*spans))).otherwise(F.array().cast(f"array<{SPAN}>"))
    return found.select(*[F.col(f"`{c}`") for c in base.columns], merged.alias("pii"))


def masked(docs: DataFrame, text: str = "text", mark: str = "*") -> DataFrame:
    """The texts with every character of a found span replaced; adds pii as find_pii() does. Null stays null."""
    found = find_pii(docs, text)

    chars = F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0))

    def hide(all_: Column) -> Column:
        hidden = F.array_distinct(F.flatten(F.transform("pii", lambda s: F.sequence(s["start"], s["end"] - 1))))
        shown = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(all_).cast("long") - 1), hidden)
        written = F.concat(F.transform(shown, lambda i: F.struct(i.alias("i"), F.get(all_, i.cast("int")).alias("c"))), F.transform(hidden, lambda i: F.struct(i.alias("i"), F.lit(mark).alias("c"))))
        return F.array_join(F.transform(F.sort_array(written), lambda x: x["c"]), "")

    return found.withColumn(text, F.when(F.size("pii") > 0, let(chars, hide)).otherwise(F.col(text)))


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the four base kinds, the hash of their spans, and all spans as text."""
    pii = F.col("pii")
    counts = [count_where(pii, "rank", rank).alias(f"n_{KINDS[rank].name}") for rank in range(BASE)]
    digest = F.sha2(joined_spans(F.filter(pii, lambda s: s["rank"] < BASE)), 256).alias("base_sha256")
    return find_pii(docs.select("doc_id", "text")).select("doc_id", *counts, digest, joined_spans(pii).alias("spans"))
