"""Secrets in whole texts: fixed patterns, and literals assigned to names that promise a secret.

The lexer reads assignments of source code, configuration and mark-up into pairs of a name and a list
of terms. Names may be quoted, dotted, subscripted or annotated with a type; values may stand on the
next line, run over several lines in brackets, be joined, or be arguments of calls; strings are read
with their escapes, and assignments inside strings are read too. Terms are literals or other names. A
name is looked up in the blocks around it, by indentation, and then in any block before it. An
assignment to a sensitive name marks its literals, and through the names that it uses the literals
assigned to those, however many steps away. Marked literals are scored by the name and by how random
they look. All patterns take linear time and have no bounds on lengths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import count_where, joined_spans, without

#: kind, pattern, group whose length counts, least length; in the order in which kinds count at the same start.
FIXED = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 1, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    # All of a run at once, so that words don't come up one by one: shorter runs fail anyway.
    ("hex", re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}"), 0, 16),
)
LITERAL = "literal"
ORDER = {k: i for i, k in enumerate([*(f[0] for f in FIXED), LITERAL])}

#: The left side: a name, perhaps with a subscript and a type, and the operator.
SITE = re.compile(
    r"""(?<![\w$.-])(["']?)(?P<name>[A-Za-z_$][\w$.-]*+)\1(?:\[[ \t]*+["']?(?P<key>[\w$.-]*+)["']?[ \t]*+\])?+[ \t]*+"""
    r"""(?::=|=>|<-|=(?![=~>])|:[ \t]*+[A-Za-z_][\w.|, \t\[\]]*+=(?!=)|:(?!:))""",
    re.ASCII,
)
#: An element of mark-up with its text.
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?+>\s*+(?P<text>[^<>\s]++)\s*+</", re.ASCII)
#: What values are made of. A word is a name if it looks like one and somebody has assigned it.
TERM = re.compile(
    r"""(?P<blank>(?:[ \t]|\\\r?\n)++)|(?P<line>\s++)"""
    r"""|[rbfuRBFU]{0,2}(?:\"{3}(?P<t3>(?:(?!\"{3})(?:\\.|[^\\]))*+)\"{3}|'{3}(?P<t4>(?:(?!'{3})(?:\\.|[^\\]))*+)'{3})"""
    r"""|[rbfuRBFU]{0,2}(?:"(?P<t0>(?:[^"\\\n]|\\.)*+)"|'(?P<t1>(?:[^'\\\n]|\\.)*+)'|`(?P<t2>[^`\n]*+)`)"""
    r"""|(?P<ref>\$\{[^{}\s]*+\}|\{\{[^{}\n]*+\}\}|\$\([^()\n]*+\))"""
    r"""|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<join>\|\||\?\?|\+|\.(?![\w])|(?:or|and|if|else|new|await|return)\b)|(?P<comma>,)|(?P<end>;)"""
    r"""|(?P<word>[^\s"'`,;()\[\]{}<>|]++)|(?P<other>.)""",
    re.ASCII | re.DOTALL,
)
DOTTED = re.compile(r"\$?[A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)*", re.ASCII)
INSIDE = re.compile(r"\{+\s*+([A-Za-z_][\w.]*+)\s*+\}+|\$([A-Za-z_]\w*+)", re.ASCII)
REFERENCE = re.compile(r"[${(]*[A-Za-z_][\w.]*[})]+|\$\w+", re.ASCII)
INDENT, LINES = re.compile(r"[ \t]*+"), re.compile(r"^[ \t]*+(?=\S)", re.MULTILINE)
OPERATOR = re.compile(r"[ \t]*+(?::(?!:)|=>|=(?!=))")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

#: How much a word inside a name promises a secret.
SENSITIVE = {"password": 0.6, "passwd": 0.6, "pwd": 0.5, "passphrase": 0.6, "secret": 0.6, "token": 0.5, "apikey": 0.6, "credential": 0.5, "credentials": 0.5, "auth": 0.3, "private": 0.3, "access": 0.2, "key": 0.3, "api": 0.2, "salt": 0.3, "signature": 0.3, "bearer": 0.4}
#: Literals that stand in for a secret.
HOLLOW = {"changeme", "change_me", "example", "password", "secret", "token", "none", "null", "true", "false", "placeholder", "redacted", "dummy", "todo"}
#: Name score from which an assignment is followed, and total score from which a literal is reported.
FOLLOWED, REPORTED = 0.5, 0.7


def name_score(name: str) -> float:
    words = [w.lower() for w in PARTS.findall(name)]
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in set(words)))


#: A constant's or a variable's name in place of a value.
IDENTIFIER = re.compile(r"[A-Za-z]+(?:_[A-Za-z]+)+|[A-Z]+(?:_[A-Z0-9]+)+")


def literal_score(value: str) -> float:
    """0 for stand-ins and short or plain literals, up to 0.5 for long random ones."""
    if len(value) < 6 or value.lower() in HOLLOW or len(set(value)) < 4 or IDENTIFIER.fullmatch(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(0.5, 0.1 * (mixed - 1) + 0.06 * entropy)


class Assignment:
    """A name with the terms of its value.

    literals: (start, end, quoted); names: (name, start, end) of words that may be names; inside: names that strings use;
    nested: assignments inside the value, as of the keys of a mapping.
    """

    def __init__(self, name: str, start: int) -> None:
        self.name, self.start = name, start
        self.literals: list[tuple[int, int, bool]] = []
        self.names: list[tuple[str, int, int]] = []
        self.inside: list[str] = []
        self.nested: list[Assignment] = []


class Value:
    """A value that is being read: how many brackets are open in it, and whether a term must follow."""

    def __init__(self, to: Assignment, indent: int) -> None:
        self.to, self.indent, self.depth, self.wanted = to, indent, 0, True

    def takes(self, t: re.Match, text: str) -> bool:
        """Takes a token in, or tells that the value has ended before it."""
        kind, to, at = t.lastgroup, self.to, t.end()
        match kind:
            case "blank":
                return True
            case "line":
                # A value goes on in brackets and after a joint, and may start on the next line if that is deeper or a string.
                new = len(t[0]) - 1 - t[0].rfind("\n")
                return self.depth > 0 or (self.wanted and (new > self.indent or text[at : at + 1] in ("'", '"')))
            case "t0" | "t1" | "t2" | "t3" | "t4":
                if not OPERATOR.match(text, at):  # else it is a key
                    uses = [a or b for a, b in INSIDE.findall(t[kind])]
                    if not REFERENCE.fullmatch(t[kind]):
                        to.literals.append((t.start(kind), t.end(kind), True))
                    to.inside += uses
                self.wanted = False
            case "ref":
                to.names.append((_plain(t[0]), t.start(), at))
                self.wanted = False
            case "word":
                if not self.wanted and not self.depth:
                    return False
                word = t[0].rstrip(".:!?")
                if word and text[at : at + 1] != "(":  # else it is called
                    to.names.append((_plain(word) if DOTTED.fullmatch(word) else "", t.start(), t.start() + len(word)))
                self.wanted = False
            case "open":
                self.depth, self.wanted = self.depth + 1, True
            case "close":
                self.depth, self.wanted = self.depth - 1, False
                return self.depth >= 0
            case "join":
                self.wanted = True
            case "comma":
                return self.depth > 0
            case "end":
                return False
            case _:
                return self.depth > 0 or t[0] in "|>"
        return True


def _plain(name: str) -> str:
    return re.sub(r"->|::", ".", name.strip("${}() \t"))


def read_assignments(text: str, at: int, end: int, found: list[Assignment]) -> list[tuple[int, int]]:
    """Adds the assignments of a part of a text to found; each token is read once, and again for each value that it ends. Returns where strings are that may hold more."""
    open_: list[Value] = []
    strings, line, seen = [], text.rfind("\n", 0, at) + 1, at
    while True:
        m = SITE.match(text, at, end) if open_ and (open_[-1].depth or open_[-1].wanted) else None if open_ else SITE.search(text, at, end)
        if m:
            a = Assignment(f"{m['name']}.{m['key']}" if m["key"] else m["name"], m.start())
            found.append(a)
            if open_:
                open_[-1].to.nested.append(a)
                open_[-1].wanted = False
            line, seen = max(line, text.rfind("\n", seen, m.start()) + 1), m.start()
            open_.append(Value(a, INDENT.match(text, line).end() - line))
            at = m.end()
            continue
        if not open_:
            return strings
        if not (t := TERM.match(text, at, end)):
            open_ = []
            continue
        while open_ and not open_[-1].takes(t, text):
            open_.pop()
        if open_:
            if t.lastgroup in ("t0", "t1", "t2", "t3", "t4") and ("=" in t[0] or ":" in t[0]):
                strings.append(t.span(t.lastgroup))
            at = t.end()
        elif t.lastgroup not in ("word", "t0", "t1", "t2", "t3", "t4"):
            at = t.end()  # nothing starts with it


def assignments(text: str) -> list[Assignment]:
    """The assignments of a text in order, also those inside strings and elements."""
    found: list[Assignment] = []
    todo = [(0, len(text))]
    while todo:
        todo += read_assignments(text, *todo.pop(), found)
    if "</" in text:
        for m in ELEMENT.finditer(text):
            found.append(a := Assignment(m["name"], m.start()))
            a.literals.append((m.start("text"), m.end("text"), True))
    return sorted(found, key=lambda a: a.start)


class Names:
    """Which assignment a name stands for: the latest in the blocks that are open, else the latest at all."""

    def __init__(self, text: str) -> None:
        self.open: list[tuple[int, dict[str, int]]] = [(0, {})]
        self.latest: dict[str, int] = {}
        self.lines = LINES.finditer(text)
        self.line = next(self.lines, None)

    def at(self, place: int) -> None:
        """Goes on to a place in the text: blocks deeper than a line on the way end."""
        while self.line and self.line.start() <= place:
            indent = self.line.end() - self.line.start()
            while self.open[-1][0] > indent:
                self.open.pop()
            if self.open[-1][0] < indent:
                self.open.append((indent, {}))
            self.line = next(self.lines, None)

    def add(self, name: str, node: int) -> None:
        self.open[-1][1][name] = self.latest[name] = node

    def get(self, name: str) -> int | None:
        for _, names in reversed(self.open):
            if name in names:
                return names[name]
        return self.latest.get(name)


def literal_spans(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name."""
    known, all_ = Names(text), assignments(text)
    number = {id(a): i for i, a in enumerate(all_)}
    nodes: list[tuple[list[tuple[int, int, bool]], list[int]]] = []
    marked: dict[int, float] = {}
    for i, a in enumerate(all_):
        known.at(a.start)
        uses = [(known.get(n) if n else None, start, end) for n, start, end in a.names]
        # A word that nobody has assigned is a literal itself, as in a configuration file.
        own = a.literals + [(start, end, False) for node, start, end in uses if node is None]
        nodes.append((own, [node for node, _, _ in uses if node is not None] + [n for x in a.inside if (n := known.get(x)) is not None] + [number[id(x)] for x in a.nested]))
        known.add(_plain(a.name), i)
        score = name_score(a.name)
        if score >= FOLLOWED:
            marked[i] = score
    reached: dict[int, float] = {}
    for node, score in sorted(marked.items(), key=lambda x: -x[1]):
        todo = [node]
        while todo:
            if (n := todo.pop()) not in reached:
                reached[n] = score
                todo += nodes[n][1]
    spans: dict[tuple[int, int], float] = {}
    for n, score in reached.items():
        for a, b, quoted in nodes[n][0]:
            value = text[a:b]
            plain = not quoted and not (re.search("[0-9]", value) and re.search("[A-Za-z]", value) and len(value) >= 8)
            likely = 0.0 if plain or (quoted and re.search(r"\s", value)) else literal_score(value)
            if likely and score + likely >= REPORTED:
                spans[a, b] = max(spans.get((a, b), 0.0), min(1.0, score + likely))
    return [(a, b, s) for (a, b), s in spans.items()]


def secret_spans(text: str) -> list[dict]:
    found = [(m.start(), m.end(), kind, 1.0) for kind, pattern, group, least in FIXED for m in pattern.finditer(text) if len(m[group]) >= least]
    if "=" in text or ":" in text or "</" in text or "<-" in text:
        found += [(a, b, LITERAL, s) for a, b, s in literal_spans(text)]
    found.sort(key=lambda x: (x[0], ORDER[x[2]], x[1]))
    return [{"start": a, "end": b, "kind": k, "score": s} for a, b, k, s in found]


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())])
ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds secrets, an array of struct(start, end, kind, score) by start and then kind, to every row.

    The kinds assign, access and hex are leftmost matches without overlap within the kind, dropped if
    too short; literal is what the lexer finds. Positions are code points, ends exclusive. Null and
    empty texts have none; repeated rows are scanned each on their own; an input column named
    secrets is replaced; an empty table stays empty.
    """

    @F.arrow_udf(T.ArrayType(SPAN))
    def scanned(texts: pa.Array) -> pa.Array:
        return pa.array([secret_spans(x) if x else [] for x in texts.to_pylist()], ARROW)

    return without(docs, ("secrets",)).withColumn("secrets", scanned(F.col(text)))


def secret_digest(docs: DataFrame) -> DataFrame:
    s = F.col("secrets")
    counts = [count_where(s, "kind", kind).alias(f"n_{kind}") for kind, *_ in FIXED]
    return find_secrets(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(joined_spans(F.filter(s, lambda x: x["kind"] != LITERAL)), 256).alias("base_sha256"), joined_spans(s).alias("spans"))
