"""PII and secrets against plain regular expressions."""

import hashlib
import re

import pytest

from quillon.llm.pii import find_pii, masked, pii_digest
from quillon.llm.secret_scan import find_secrets, secret_digest, secret_spans

BITS = ["a@b.co", "x@y", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111111111111112", "+1 (234) 567-8901", "+12", "é", "😀", ".", "-", " ", "\n", "@", "+", "z", "7"]


def base_pii(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


def test_pii_base(spark, rng):
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "4111111111111111 " * 700 + "a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_digest(df).collect():
        want = base_pii(texts[r.doc_id])
        assert r.base_sha256 == digest(want), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]


def test_pii_checks_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00", "IBAN DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "lot 123-45-6789", "call (555) 123-4567", "sum (555) 123-4567"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: [s.kind for s in r.pii] for r in find_pii(df).collect()}
    assert kinds == {0: ["iban"], 1: [], 2: ["national_id"], 3: [], 4: ["local_phone"], 5: []}
    assert masked(df).where("doc_id = 2").first()["text"] == "ssn ***********"


def test_many_matches_take_linear_time(spark):
    import time

    def took(n):
        df = spark.createDataFrame([(1, "write to some.body@example.org\n" * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert (pii_digest(df).first().n_email, masked(df).first()["text"].count("*")) == (n, 21 * n)
        return time.perf_counter() - began

    took(2000)
    assert took(32_000) < 6 * took(8000) + 2


def base_secrets(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    for kind, (name, p, n) in enumerate((("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)), 1):
        out += [(m.start(), kind, name, m.end()) for m in re.finditer(p, t or "") if len(m[0]) >= n]
    return sorted(out)


def test_secrets_base(spark, rng):
    bits = ["password", "=", ": ", '"', "Token", "api_key", "deadbeef01234567", "AKIA", "ABCDEFGH12345678", "abc", " ", "\n", "ſecret", "é", "short", "secret=", "x1y2z3w4v5u6"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_digest(df).collect():
        want = base_secrets(texts[r.doc_id])
        assert r.base_sha256 == digest(want), texts[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in want) for k in range(3)]


def test_constants_propagate():
    t = 'salt = "abcXYZ123987"\nmid = salt\npassword = mid + "tail99XYZ!"\nname = "abcXYZ123987"'
    assert [t[s["start"] : s["end"]] for s in secret_spans(t) if s["kind"] == "literal"] == ["abcXYZ123987", "tail99XYZ!"]
    assert secret_spans("x = x + x\nsecret = x") == [] and secret_spans("password = changeme") == []


SECRET = "xK9v2LqZ7pTw4R"


@pytest.mark.parametrize("text", [
    f'db_credential{" " * 30}= "{SECRET}"', f'{"very_" * 20}credential = "{SECRET}"', f'credential: str = "{SECRET}"', f"credential:\n  {SECRET}\n",
    f'credential =\n    "{SECRET}"', f'credentials["k"] = "{SECRET}"', f'credential = os.environ.get("DB_X", "{SECRET}")', f'credential = f("{SECRET}")',
    f"<credential>{SECRET}</credential>", f'cmd = "export credential={SECRET} run"', f'cfg.dbkey = "{SECRET}"\ndb_credential = cfg.dbkey',
    f'cfg.dbkey = "{SECRET}"\ndb_credential = "${{cfg.dbkey}}"', f'{{"user": "bob", "credential": "{SECRET}"}}', f'credentials = [\n  "{SECRET}",\n]',
    f'credential = """{SECRET}"""', f"$credential => '{SECRET}';", f"[db]\ncredential={SECRET}\n", f'credential = x + \\\n  "{SECRET}"', f'credential := "{SECRET}"',
    f'private String credential = "{SECRET}";', f'credential = config.get(x) or "{SECRET}"', f"credential: |\n  {SECRET}\n", f'a = "{SECRET}"\nb = a\nc = b\npassphrase = c',
    f'key1 = "{SECRET}"\ndef f():\n    key1 = "other1value9X"\ndef g():\n    credential = key1\n', f'credentials = {{"main": {{"deep": "{SECRET}"}}}}',
])
def test_lexer(text):
    assert [text[s["start"] : s["end"]] for s in secret_spans(text) if s["kind"] == "literal"] == [SECRET]


def test_escapes_and_plain_texts():
    t = f'credential = "ab\\"{SECRET}"'
    assert [t[s["start"] : s["end"]] for s in secret_spans(t)] == [f'ab\\"{SECRET}']
    for t in ("The key: a story of one token, and the password was lost. Note: it's fine, don't worry = ok", "password = None", "secret: see above", "api_key = os.environ['API_KEY']", 'credential = getenv("DB_PASSWORD")'):
        assert secret_spans(t) == []


@pytest.mark.parametrize("unit", ["a = [", "x=", "key: b ", "<a ", "credential: str ", '"a": {', "credential = '", " = ", "a.b-", 'password="\\', "credential=(a,"])
def test_long_texts_take_linear_time(unit):
    import time

    def took(n):
        began = time.perf_counter()
        secret_spans(unit * (n // len(unit)))
        return time.perf_counter() - began

    assert took(400_000) < 8 * took(100_000) + 0.5


def test_odd_rows(odd):
    for f, c in ((find_pii, "pii"), (find_secrets, "secrets")):
        assert f(odd).count() == odd.count() and f(odd.limit(0)).count() == 0
        assert f(odd).columns == [*odd.columns, c]
        assert f(f(odd)).columns == [*odd.columns, c]
