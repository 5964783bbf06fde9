"""Token counts of whole texts, exactly as a subword tokenizer gives them, by a finite-state transducer.

The vocabulary merges neighbouring pieces, best score first. Where a prefix of a text ends, its last
token is settled: of the pieces that end there, one alone stands the merges beside the last token of
what comes before it (the two, merged on their own, stay two). So a prefix needs no more of the past
than the places from which a piece may still grow: at each the node of the vocabulary's trie, the
last token before it and the difference of the counts. This is a state. A transition reads one
character and carries the tokens that it emits: how many more the longer prefix has, which may be
none or fewer. States and transitions are compiled when they are first met; when their table is full it
starts anew.

No piece has a space after another character, so after a space that follows one the state is always
the same. A chunk of a text is therefore summarised by its state map: the part before its first such
space, which depends on the state before the chunk, the tokens emitted after it, and the state at
its end. State maps compose associatively; those of a text are composed in pairs, pairs of pairs and
so on.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

#: Spaces are written so inside pieces.
MARK = "▁"
#: Characters of a text that give one state map.
CHUNK = 1 << 13
#: Words, pairs of tokens and states of which what was found is kept, at most, and the longest of these words.
WORDS, PAIRS, STATES, KEPT_LENGTH = 1 << 17, 1 << 18, 1 << 18, 48
#: A space after another character.
BOUNDARY, WORD_ENDS = re.compile("[^ ] "), re.compile("(?<=[^ ])(?= )")
#: The trie's root; the token before a place where merges can't reach back.
ROOT, NONE = 0, -1


class State(dict):
    """The transitions that were compiled, by character the next state and the tokens emitted, and the places from which a piece may still grow.

    Workers keep many states from task to task, so places are held as bytes: three numbers each.
    """

    __slots__ = ("places",)
    __hash__, __eq__ = object.__hash__, object.__eq__


class ChunkMap(NamedTuple):
    """What a chunk does: head is read from the state before it; emitted counts the rest, and state is where that ends.

    state is None if there is no rest: the chunk has no boundary and all of it is head.
    """

    head: str
    emitted: int
    state: State | None


class Vocabulary(NamedTuple):
    """Pieces that merges may give, with their scores."""

    scores: dict[str, float]

    @classmethod
    def read(cls, model: str) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = (i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)))
        return cls({p.id_to_piece(i): p.get_score(i) for i in plain})

    def merged(self, symbols: list[str]) -> list[str]:
        """What merging leaves: the best pair first, of equal ones the leftmost."""
        symbols = list(symbols)
        best = [self.scores.get(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
        while found := [s for s in best if s is not None]:
            i = best.index(max(found))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del best[i]
            if i:
                best[i - 1] = self.scores.get(symbols[i - 1] + symbols[i])
            if i < len(best):
                best[i] = self.scores.get(symbols[i] + symbols[i + 1])
        return symbols


class Words(dict):
    """Tokens by word, as transitions from one boundary to the next: a word is written with its leading spaces less one.

    When the table is full its words become the older ones, of which those that come again return.
    """

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, word: str) -> int:
        if (n := self.older.get(word)) is None:
            n = self.transducer.read(self.transducer.letter, " " + word)[1]
        if len(word) <= KEPT_LENGTH:
            if len(self) >= WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n


class Transducer:
    """The compiled tables: for each state and character the next state and the tokens emitted."""

    def __init__(self, vocabulary: Vocabulary):
        if any(MARK in p.lstrip(MARK) for p in vocabulary.scores):
            raise ValueError("a piece has a space inside: the state after a space isn't settled")
        self.vocabulary = vocabulary
        self.children: list[dict[str, int]] = [{}]
        self.token: list[int | None] = [None]
        self.pieces = list({p: None for scored in vocabulary.scores for p in (scored, scored[0])})
        #: Pieces, and characters that begin one, are numbered.
        self.number = {p: i for i, p in enumerate(self.pieces)}
        for piece in vocabulary.scores:
            node = ROOT
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][c]
            self.token[node] = self.number[piece]
        self.stands_: dict[int, bool] = {}
        self.words = Words(self)
        self.reset()

    def reset(self) -> None:
        self.states: dict[bytes, State] = {}
        self.start = self.state([ROOT, NONE, 0])
        #: After a letter that merges can't reach; a space from here leads where it leads from any other character.
        self.letter = self.start

    def state(self, places: list[int]) -> State:
        key = array("i", places).tobytes()
        if (found := self.states.get(key)) is None:
            found = self.states[key] = State()
            found.places = key
        return found

    def stands(self, before: int, token: int) -> bool:
        """Whether a token stays apart from the one before it."""
        if before == NONE:
            return True
        pair = before * len(self.pieces) + token
        if (found := self.stands_.get(pair)) is None:
            x, y = self.pieces[before], self.pieces[token]
            found = self.vocabulary.merged([*x, *y]) == [x, y]
            if len(self.stands_) >= PAIRS:
                self.stands_.clear()
            self.stands_[pair] = found
        return found

    def compiled(self, state: State, c: str) -> tuple[State, int]:
        """The transition of a state by a character."""
        last, emitted, open_, read = None, 0, [], c
        c = MARK if c == " " else c
        flat = array("i", state.places).tolist()
        for node, before, count in zip(flat[::3], flat[1::3], flat[2::3], strict=True):
            if (node := self.children[node].get(c)) is None:
                continue
            open_.append((node, before, count))
            token = self.token[node]
            if last is None and token is not None and self.stands(before, token):
                last, emitted = token, count + 1
        if last is None:
            # No piece ends here: the character stands for itself and is written as its bytes.
            last, emitted = self.number.get(c, NONE), flat[-1] + len(c.encode())
        if c == MARK:
            # Merges don't reach over a space to what isn't one.
            open_ = [(n, b if b == NONE or self.pieces[b][-1] == MARK else NONE, k) for n, b, k in open_]
        places = [x for n, b, k in open_ if self.children[n] for x in (n, b, k - emitted)]
        state[read] = found = self.state([*places, ROOT, last, 0]), emitted
        return found

    def read(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text, and the tokens emitted."""
        total = 0
        for c in text:
            state, n = state.get(c) or self.compiled(state, c)
            total += n
        return state, total

    def emitted(self, text: str) -> int:
        """Tokens emitted by a text that starts with a boundary's space and ends before one."""
        words = text[1:].split(" ") if "  " not in text else [w[1:] for w in WORD_ENDS.split(text)]
        return sum(map(self.words.__getitem__, words))

    def chunk(self, text: str) -> ChunkMap:
        """The state map of a chunk."""
        m = BOUNDARY.search(text)
        if not m:
            return ChunkMap(text, 0, None)
        first, last = m.start() + 1, len(text[: text.rindex(" ")].rstrip(" "))
        state, n = self.read(self.letter, text[last:])
        return ChunkMap(text[:first], n + (self.emitted(text[first:last]) if first < last else 0), state)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The state map of two neighbouring chunks; associative."""
        if a.state is None:
            return ChunkMap(a.head + b.head, b.emitted, b.state)
        state, n = self.read(a.state, b.head)
        return ChunkMap(a.head, a.emitted + n + b.emitted, state if b.state is None else b.state)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if len(self.states) >= STATES:
            self.reset()
        spaced = " " + text.replace(MARK, " ")
        maps = [self.chunk(spaced[i : i + chunk]) for i in range(0, len(spaced), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.read(self.start, maps[0].head)[1] + maps[0].emitted


def default_model() -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def transducer(model: str) -> Transducer:
    return Transducer(Vocabulary.read(model))


def token_counts(docs: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every row.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each on their own;
    an empty table stays empty. Texts of any length are read chunk by chunk. Columns of the input
    with the names of the new ones are replaced. The model's file must be readable at the same path
    on every executor.
    """

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = transducer(model)
        for texts in batches:
            # One text at a time becomes a Python string, not all of a batch.
            yield pa.array([t.count(x) if x else 0 for x in (s.as_py() for s in texts)], pa.int64())
        pa.default_memory_pool().release_unused()

    # Declared to vary so that filters on the count don't make Spark count twice.
    udf = F.arrow_udf(counted, T.LongType()).asNondeterministic()
    kept = without(docs, ("n_bytes", "n_tokens", "over_limit"))
    n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return kept.select("*", n_bytes.alias("n_bytes"), udf(F.col(text)).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
