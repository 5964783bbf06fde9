"""Document quality by weak supervision, with DataFrame functions only.

Rules look at one signal each and vote good, bad or not at all. How often rules are right is not
known; expectation-maximisation estimates it, with the share of good documents, from the votes of
all documents, which count only by their pattern: with m rules there are at most 3**m of them, so
what is gathered has a fixed bound. The posterior probability of being good decides, instead of a
demand that every rule passes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, UPPER, cut, let, once, without, words

#: Characters that count as symbols, the width of a window, and the bounds of the base rules.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(spots: Column) -> Column:
    """Words in windows found more than once. spots: (key of window, position) in order of key.

    Positions of windows whose key also stands next to them, in order; each covers its window up to the next one.
    """
    same = lambda s, i: F.coalesce(F.get(spots, i)["k"] == s["k"], F.lit(False))
    twice = F.filter(spots, lambda s, i: same(s, i - 1) | same(s, i + 1))
    return let(F.sort_array(F.transform(twice, lambda s: s["i"])), lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))


def _window_keys(hashes: Column) -> Column:
    """A 64-bit key for each window of eight words, from those of two and four."""

    def pairs(a: Column, step: int) -> Column:
        n = F.size(a) - step
        return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))

    return let(pairs(hashes, 1), lambda two: let(pairs(two, 2), lambda four: pairs(four, 4)))


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of the whole text to every row.

    Null and empty texts have zeros. Windows are told apart by 64-bit hashes. Columns of these names are replaced.
    """
    base = without(docs, SIGNALS)
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    hashes = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))

    def repeated(keys: Column) -> Column:
        spots = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), let(spots, _repeated_words)).otherwise(0)

    counted = let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n"), let(_window_keys(h), repeated).cast("long").alias("r")))
    found = once(
        base, counted.alias("__c"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.instr(t, "\n") > 0, dup_lines).otherwise(0).cast("long").alias("n_dup_lines"),
    )
    kept = [F.col(f"`{c}`") for c in base.columns]
    return found.select(*kept, F.col("__c.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("__c.r").alias("n_repeat_words"))


class Rule(NamedTuple):
    """Votes good where good holds, bad where bad holds, and abstains otherwise."""

    name: str
    good: Callable[[Column], Column]
    bad: Callable[[Column], Column]
    value: Callable[[], Column]


def _share(part: str, whole: str) -> Callable[[], Column]:
    return lambda: F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _between(low: float, high: float) -> Callable[[Column], Column]:
    return lambda x: x.between(low, high)


def _never(x: Column) -> Column:
    return F.lit(False)


#: Two rules find signs of prose and may vote good; the others each know one kind of fault and else abstain, because passing
#: them says little and many such passes would outvote the one rule that has seen a fault.
RULES = (
    Rule("length", lambda x: x >= 50, lambda x: x < 10, lambda: F.col("n_words")),
    Rule("plain", lambda x: x <= 0.01, lambda x: x > 0.03, _share("n_odd", "word_chars")),
    Rule("symbols", _never, lambda x: x > 0.1, _share("n_symbols", "n_words")),
    Rule("repeats", _never, lambda x: x > 0.15, _share("n_repeat_words", "n_words")),
    Rule("lines", _never, lambda x: x >= 4, lambda: F.col("n_dup_lines")),
    Rule("word_length", _never, lambda x: (x < 2.5) | (x > 14.0), _share("word_chars", "n_words")),
    Rule("capitals", _never, lambda x: x > 0.3, _share("n_upper", "word_chars")),
)
#: Characters that prose hardly uses, and capitals.
EXTRA = {"n_odd": "!#$%&*+<=>@[\\]^_`{|}~", "n_upper": UPPER}
#: Where estimation starts: the share of good documents, and how often a rule votes bad, abstains and votes good on each kind.
START_GOOD, START = 0.8, {"on_good": (0.005, 0.395, 0.6), "on_bad": (0.4, 0.2, 0.4)}
#: What pulls estimates back to the start (as so many documents), rounds of estimation, least posterior that keeps.
PULL, ROUNDS, KEEP = 20.0, 25, 0.5


class Model(NamedTuple):
    """The share of good documents; for each rule the chances of its votes (bad, none, good) on good and on bad ones."""

    good: float
    on_good: list[list[float]]
    on_bad: list[list[float]]

    def accuracies(self) -> dict[str, float]:
        """How often each rule is right when it votes."""
        right = [(self.good * g[2] + (1 - self.good) * b[0], self.good * (g[0] + g[2]) + (1 - self.good) * (b[0] + b[2])) for g, b in zip(self.on_good, self.on_bad, strict=True)]
        return {r.name: a / n for r, (a, n) in zip(RULES, right, strict=True)}


def more_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """signals(), n_odd (characters that prose hardly uses) and n_upper (capitals A to Z)."""
    t = F.coalesce(F.col(text), F.lit(""))
    counted = [(F.length(t) - F.length(F.translate(t, chars, ""))).cast("long").alias(n) for n, chars in EXTRA.items()]
    return once(signals(without(docs, EXTRA), text), *counted)


def votes() -> Column:
    """1, -1 or 0 of each rule, over the columns of more_signals()."""

    def vote(rule: Rule) -> Column:
        return let(rule.value(), lambda x: F.when(rule.bad(x), -1).when(rule.good(x), 1).otherwise(0))

    return F.array(*map(vote, RULES))


def _posterior(vote: Column, model: Column) -> Column:
    """Probability of being good: every vote counts the log of how much likelier it is on a good document."""
    weighed = F.transform(vote, lambda v, j: F.log(model["on_good"][j][v + 1] / model["on_bad"][j][v + 1]))
    return 1 / (1 + F.exp(-F.aggregate(weighed, F.log(model["good"] / (1 - model["good"])), lambda s, x: s + x)))


def _round(model: Column, patterns: Column) -> Column:
    """One step of expectation-maximisation on the counted vote patterns."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rules, kinds = F.sequence(F.lit(0), F.lit(len(RULES) - 1)), F.array(F.lit(-1), F.lit(0), F.lit(1))

    def chances(soft: Column, weight: str, start: tuple[float, ...]) -> Column:
        pull = F.array(*[F.lit(PULL * x) for x in start])
        of = lambda p: p[weight]
        return let(total(F.transform(soft, of)), lambda n: F.transform(rules, lambda j: F.transform(kinds, lambda v: (total(F.transform(F.filter(soft, lambda p: p["vote"][j] == v), of)) + pull[v + 1]) / (n + PULL))))

    def maximise(soft: Column) -> Column:
        good, bad = (total(F.transform(soft, lambda p: p["good"]))), (total(F.transform(soft, lambda p: p["bad"])))
        return F.struct(((good + PULL * START_GOOD) / (good + bad + PULL)).alias("good"), chances(soft, "good", START["on_good"]).alias("on_good"), chances(soft, "bad", START["on_bad"]).alias("on_bad"))

    def weigh(p: Column) -> Column:
        return let(_posterior(p["vote"], model), lambda q: F.struct(p["vote"].alias("vote"), (p["n"] * q).alias("good"), (p["n"] * (1 - q)).alias("bad")))

    return let(F.transform(patterns, weigh), maximise)


def _model(good: float, on_good: list[list[float]], on_bad: list[list[float]]) -> Column:
    lists = lambda rows: F.array(*[F.array(*map(F.lit, r)) for r in rows])
    return F.struct(F.lit(good).alias("good"), lists(on_good).alias("on_good"), lists(on_bad).alias("on_bad"))


def estimate(rated: DataFrame) -> Model:
    """The model of the votes of all rows of more_signals(); without rows it is where estimation starts."""
    patterns = rated.groupBy(votes().alias("vote")).agg(F.count("*").cast("double").alias("n")).agg(F.sort_array(F.collect_list(F.struct("vote", "n"))).alias("patterns"))
    start = _model(START_GOOD, *[[list(START[k])] * len(RULES) for k in ("on_good", "on_bad")])
    m = patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda m, _: _round(m, F.col("patterns"))).alias("m")).first()["m"]
    return Model(m["good"], [list(x) for x in m["on_good"]], [list(x) for x in m["on_bad"]])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rate(rated: DataFrame, model: Model) -> DataFrame:
    """Adds p_good, base_failed and kept to rows of more_signals(); columns of these names are replaced."""
    p = let(_model(*model), lambda m: _posterior(votes(), m))
    return without(rated, ("p_good", "base_failed", "kept")).select("*", p.alias("p_good"), base_failed().alias("base_failed")).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))


def judge_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the signals, p_good, base_failed and kept to every row; the rows are kept with their signals in between.

    The model is estimated from all rows. Null and empty texts have no words and so fail the base
    rules. Repeated rows vote and are judged each; an empty table stays empty. Columns with the names
    of the new ones are replaced.
    """
    rated = cut(more_signals(docs, text))
    return rate(rated, estimate(rated))


def quality_digest(docs: DataFrame) -> DataFrame:
    rated = cut(more_signals(docs.select("doc_id", "text")).drop("text"))
    return rate(rated, estimate(rated)).select("doc_id", *SIGNALS, "base_failed", "kept", "p_good")
