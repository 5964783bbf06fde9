"""Quality, token counts, decontamination and language-model scores against brute force."""

import math
import re
import zlib
from collections import Counter

import pytest

from quillon.llm import lm
from quillon.llm.decontaminate import _parts, build_index, contamination, contamination_digest, covered, find_hits
from quillon.llm.lm import scores
from quillon.llm.quality import SIGNALS, estimate, judge_quality, more_signals, signals
from quillon.llm.token_counts import token_counts, transducer


def repeated(words):
    c, hit = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7)), set()
    for i in range(len(words) - 7):
        if c[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_quality_signals(spark, rng):
    texts = ["".join(rng.choice(["a", "b", "É", "#", "|", " ", " ", "\n", "\t", "\x1f", "<"]) for _ in range(rng.randint(0, 120))) for _ in range(200)] + [None, "", "a b c d e f g h i a b c d e f g h", "a " * 30]
    for r in signals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        t = texts[r.doc_id] or ""
        words = re.findall("[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        assert [r[c] for c in SIGNALS] == [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated(words)], t


def test_quality_verdicts(spark, rng):
    prose = [(i, " ".join("".join(rng.choice("aeioustnr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 120))) + ".") for i in range(300)]
    junk = [(1000 + i, " ".join(f"{t}###" for t in x.split())) for i, x in prose[:20]]
    shout = [(2000 + i, x.upper().replace(" ", "!! ")) for i, x in prose[20:40]]
    df = spark.createDataFrame(prose + junk + shout, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in judge_quality(df).collect()}
    assert all(v == (k < 1000) for k, v in kept.items())
    model = estimate(more_signals(df))
    assert 0.8 < model.good < 0.95 and model.accuracies()["plain"] > 0.95
    assert estimate(more_signals(df.limit(0))).good == pytest.approx(0.8)


def test_quality_odd_rows(odd):
    out = judge_quality(odd)
    assert out.count() == odd.count() and judge_quality(odd.limit(0)).count() == 0
    assert {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in out.where("doc_id < 4").collect()} == {i: (0, True, False) for i in (1, 2, 3)}


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_counts(spark, rng, odd, model):
    import sentencepiece

    library, t = sentencepiece.SentencePieceProcessor(model_file=model), transducer(model)
    bits = ["a", "the", " of", " ", "  ", "   ", "\n", "▁", "é", "e\u0301", "中", "<s>", "</s>", "<0x0A>", "\r", "\x00", "x=", "ﬁ", "Ａ", "\u200b", "\xa0", "😀", "ing", "tion", "0123", "лаи", "...."]
    for _ in range(5000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        n = len(library.encode(s))
        assert [t.count(s, c) for c in (1, 2, 3, 7, 1000)] == [n] * 5, s
        a, b, c = (t.chunk(" " + s), t.chunk("x" + s), t.chunk(s + "y"))
        assert t.compose(t.compose(a, b), c) == t.compose(a, t.compose(b, c))
    for s in ("x9Qz7" * 20000, "中文没有空格" * 20000, " " * 30000, "word " * 30000):
        assert t.count(s) == len(library.encode(s))
    out = token_counts(odd, model, limit=100)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out.where("doc_id IN (1, 2, 4)").collect()} == {1: (0, 0, False), 2: (0, 0, False), 4: (7, 2, False)}
    assert out.where("over_limit").count() == 1 and token_counts(odd.limit(0), model).count() == 0


def test_token_tables_take_little_memory(rng, model):
    """Workers keep their tables from task to task, beside the stages that follow: bytes of what many new words leave, by state."""
    import tracemalloc

    from quillon.llm import token_counts as m

    t = m.Transducer(m.Vocabulary.read(model))
    tracemalloc.start()
    for _ in range(100):
        t.count(" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(100)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(t.states) > 5000 and held < 600 * len(t.states), held / len(t.states)


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def folded(t):
    return WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def brute_hits(texts, items):
    windows = {}
    for i, t in items:
        w = folded(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = folded(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    found |= ids
                    hit.update(range(k, k + n))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination(spark, rng):
    vocabulary = ["a", "b", "cc", "é", "X1", "the"]
    for _ in range(150):
        items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for i in range(rng.randint(0, 4))]
        texts = [rng.choice(["", " ", ".,"]) + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(3)] + [None]
        texts += [items[0][1] + " zz " + items[-1][1][3:]] if items else []
        index = build_index([(i, t.encode()) for i, t in items])
        assert [(n, sum(b - a for a, b in s), ids) for n, s, ids in find_hits([t and t.encode() for t in texts], index)] == brute_hits(texts, items)


def test_decontamination_in_blocks(spark, rng, odd):
    items = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(30))) for i in range(40)]
    texts = [" ".join(items[i % 40][1].split()[5 : 5 + i % 20]) + " tail" for i in range(60)]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, [(str(i), t) for i, t in items])
    for limit in (1 << 20, 2000):
        got = contamination(docs, bench, block_bytes=limit)
        rows = {r.doc_id: (r.n_words, r.n, r.item_ids) for r in got.select("doc_id", "n_words", covered(got["hit_spans"]).alias("n"), "item_ids").collect()}
        assert [rows[i] for i in range(60)] == want
    assert contamination_digest(odd, bench).count() == odd.count()
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_long_items_are_split_without_loss(rng):
    text = " ".join(f"w{rng.randint(0, 50)}" for _ in range(3000)).encode()
    windows = lambda t: {tuple(w[i : i + 10]) for w in [t.split()] for i in range(len(w) - 9)}
    parts = list(_parts(text, 1500))
    assert len(parts) > 5 and max(map(len, parts)) <= 3000 and set().union(*map(windows, parts)) == windows(text)
    assert list(_parts(b"x" * 9000, 1500)) == [b"x" * 9000] and list(_parts(b"", 10)) == [b""]


def test_index_is_small(rng):
    import pickle

    text = " ".join(f"w{rng.randint(0, 99999)}" for _ in range(50_000)).encode()
    assert len(pickle.dumps(build_index([("1", text)]))) < 8 * len(text)


def tokens(t):
    return re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + [None]


def test_lm(spark, rng):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    texts = {i: " ".join(rng.choice(words[: rng.randint(5, 80)]) for _ in range(rng.randint(0, 60))) for i in range(80)} | {200: None, 201: "", 202: "Zzq THE\x0bthe"}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    count = Counter(w for k, t in texts.items() if not held[k] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    rows = scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("vocabulary", "hot"), [(10, 5), (1000, 40), (1000, 10**6)])
def test_lm_scores_by_brute_force(spark, rng, vocabulary, hot, monkeypatch):
    """Counts, classes and the mixture in plain Python, with the weights that were learned; and the weights by plain expectation-maximisation."""
    words = [f"w{i}" for i in range(60)]
    follow = {w: rng.sample(words, 4) for w in words}
    texts = {}
    for i in range(150):
        w = [rng.choice(words)]
        while len(w) < 40:
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.8 else rng.choice(words))
        texts[i] = " ".join(w)
    texts |= {500: None, 501: "w1 unseen w2", 502: texts[0]}
    found, plain = [], lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda events: found.append(plain(events)) or found[0])
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(lm, "HOT", hot)
    rows = {r.doc_id: r for r in scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), vocabulary_size=vocabulary).collect()}
    fold = {k: zlib.crc32(str(k).encode()) % 7 for k in texts}
    told = {k: tokens(t) for k, t in texts.items()}
    all_ = Counter(w for k in texts if fold[k] != 2 for w in told[k])
    frequent, least = set(), 64
    for size in sorted({int(math.log2(n)) for n in all_.values()}, reverse=True):
        more = {w for w, n in all_.items() if int(math.log2(n)) == size}
        if len(frequent) + len(more) > vocabulary:
            break
        frequent |= more
    assert (len(frequent) < len(all_)) == (vocabulary == 10)

    def counted(folds):
        one = Counter(w for k in texts if fold[k] in folds for w in told[k])
        class_ = lambda w: w if w in frequent else "rare"
        seen = Counter()
        for w, n in one.items():
            seen[class_(w)] += n
        two = Counter((class_(a), class_(b)) for k in texts if fold[k] in folds for a, b in zip([None, *told[k]], told[k], strict=False))
        total, distinct = sum(one.values()), len(one)

        def estimates(a, b):
            context = seen[class_(a)]
            p2 = two[class_(a), class_(b)] / context * one[b] / seen[class_(b)] if context and seen[class_(b)] else 0
            return (1 + int(math.log2(context)) if context else 0), (p2, one[b] / total, 1 / (distinct + 1))

        return estimates

    full = counted({0, 1, 3, 4, 5, 6})
    for k, r in rows.items():
        want = sum(math.log10(sum(x * y for x, y in zip(p, found[0][c], strict=True))) for c, p in (full(a, b) for a, b in zip([None, *told[k]], told[k], strict=False)))
        assert r.score == pytest.approx(want, rel=1e-9)
    events = [counted({0, 1, 4, 5, 6})(a, b) for k in texts if fold[k] == 3 for a, b in zip([None, *told[k]], told[k], strict=False)]
    exact = plain(lm.np.array([[c, *p, 1] for c, p in events]))
    assert abs(exact - found[0])[[c for c, _ in events]].max() < 0.05
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * (0.9 if vocabulary > 60 else 1)


def test_lm_learns_from_pairs(spark):
    """On the texts held out, word pairs gain over single words."""
    held = [r for r in scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in held) > -205_000 > 1.1 * sum(r.score for r in held) > sum(r.base_score for r in held)


def test_sql_gives_the_same_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    from quillon.llm.queries import QUERIES, SQL

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, sql in SQL.items():
        want = con.sql(sql)
        columns = sorted(want.columns)
        got = [tuple(r) for r in QUERIES[name](spark, folder).select(columns).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())), name
