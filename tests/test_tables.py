"""Scans, predicates, aggregates, limits and output over small CSV files."""

import io
import random

import pytest

from quillon.functions.numbers import literal_number
from quillon.operators.table import Agg, Table
from quillon.plans.predicates import And, Cmp, Not, Or, field
from quillon.sinks.text import write_csv, write_csv_text, write_json
from quillon.sources.tables import read_csv, read_stdin, stream_csv
from quillon.streaming.live import append_to, running


@pytest.fixture
def csv(spark, tmp_path):
    def make(text, multiline=False):
        p = tmp_path / f"t{random.random()}.csv"
        p.write_text(text)
        return read_csv(spark, str(p), multiline)

    return make


def text(table):
    out = io.StringIO()
    write_csv_text(table.ordered() if not table.is_ordered else table, out)
    return out.getvalue()


def test_projection(csv):
    assert text(csv("id,name,amount\n1,alpha,10\n2,beta,20\n3,gamma,30\n").select("name", "amount")) == "name,amount\nalpha,10\nbeta,20\ngamma,30\n"


def test_predicate_and_limit(csv):
    assert text(csv("id,amount\n1,5\n2,15\n3,25\n").ordered().where(field("amount") > 10).limit(1)) == "id,amount\n2,15\n"


def test_header_only_and_no_match(csv):
    assert text(csv("name,age,city\n")) == "name,age,city\n"
    assert text(csv("name,age\nAlice,30\n").where(field("name") == "Charlie")) == "name,age\n"


@pytest.mark.parametrize("build", [lambda t: t.where(field("city") == "NYC"), lambda t: t.select("city"), lambda t: t.group_by("city").distinct(), lambda t: t.aggregate(Agg("SUM", "city"))])
def test_unknown_columns_raise(csv, build):
    with pytest.raises(ValueError, match="not found: city"):
        build(csv("name,age\nAlice,30\n"))


@pytest.mark.parametrize(("op", "ids"), [("=", "2"), ("!=", "134"), (">", "34"), (">=", "234"), ("<", "1"), ("<=", "12")])
def test_operators(csv, op, ids):
    t = csv("id,value\n1,10\n2,20\n3,30\n4,40\n").where(Cmp("value", op, 20)).select("id")
    assert "".join(text(t).split("\n")[1:]) == ids


def test_names_ignore_case(csv):
    assert text(csv("Name,AGE,CiTy\nAlice,30,NYC\n").select("name", "age")) == "Name,AGE\nAlice,30\n"


def test_repeated_headers_use_the_last(csv):
    assert text(csv("a,A,b\n1,2,3\n").select("a", "b", "a")) == "A,b,A\n2,3,2\n"


@pytest.mark.parametrize(("predicate", "n"), [
    ((field("country") == "UK") & (field("amount") > 100), 1), ((field("country") == "UK") | (field("country") == "US"), 5),
    (~(field("country") == "UK"), 3), (((field("country") == "UK") | (field("country") == "US")) & (field("status") == "active"), 3),
])
def test_logic(csv, predicate, n):
    t = csv("country,amount,status\nUK,50,active\nUK,150,active\nUS,120,active\nUS,80,inactive\nFR,200,active\nUK,30,inactive\n")
    assert t.where(predicate).df.count() == n


def test_short_long_blank_and_quoted_rows(csv):
    t = csv('a,b\n1\n2,x,y\n\n3,"p,""q"""\n')
    assert text(t) == 'a,b\n1,\n2,x\n3,"p,""q"""\n'
    assert t.where(field("b") == "").df.count() == 1
    assert csv('a,b\n1,"x\ny"\n', multiline=True).df.first()[1] == "x\ny"


CELLS = ["", " 5", "5", "05", "5.0", "-5", "1d", "inf", "-Infinity", "nan", "1e400", "abc", "10", ".5"]


def _brute(p, cell):
    match p:
        case Not(x):
            return not _brute(x, cell)
        case And(a, b):
            return _brute(a, cell) and _brute(b, cell)
        case Or(a, b):
            return _brute(a, cell) or _brute(b, cell)
    want, have = literal_number(p.value), literal_number(cell)
    if want is None:
        have, want = cell, str(p.value)
    elif have is None:
        return False
    return {"=": have == want, "!=": have != want, "<": have < want, "<=": have <= want, ">": have > want, ">=": have >= want}[p.op]


def test_random_predicates_match_a_row_evaluator(csv):
    r = random.Random(7)
    t = csv("i,v\n" + "".join(f"{i},{c}\n" for i, c in enumerate(CELLS)))

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return Cmp("v", r.choice(["=", "!=", "<", "<=", ">", ">="]), r.choice([5, "5", "abc", "", "nan", "inf", 0.5, "10"]))
        return r.choice([lambda: Not(tree(depth - 1)), lambda: And(tree(depth - 1), tree(depth - 1)), lambda: Or(tree(depth - 1), tree(depth - 1))])()

    for _ in range(25):
        p = tree(3)
        got = {int(x[0]) for x in t.where(p).df.collect()}
        assert got == {i for i, c in enumerate(CELLS) if _brute(p, c)}, p


def test_five_aggregates_as_text(csv):
    t = csv("country,amount\nUS,100\nUS,200\nUK,150\nFR,x\n").ordered()
    got = text(t.group_by("country").agg(Agg("COUNT"), Agg("SUM", "amount"), Agg("AVG", "amount"), Agg("MIN", "amount"), Agg("MAX", "amount")))
    assert got == "country,COUNT(*),SUM(amount),AVG(amount),MIN(amount),MAX(amount)\nUS,2,300.00,150.00,100.00,200.00\nUK,1,150.00,150.00,150.00,150.00\nFR,1,0.00,0,,\n"


def test_count_of_a_column_counts_rows_and_groups_limit_in_order(csv):
    t = csv("c,v\nUS,\nUK,1\nUS,2\nCA,3\nFR,\n").ordered()
    assert text(t.group_by("c").agg(Agg("COUNT", "v")).limit(2)) == "c,COUNT(v)\nUS,2\nUK,1\n"
    assert text(t.limit(0)) == "c,v\n"
    assert t.aggregate(Agg("AVG", "v", "m"), Agg("COUNT", name="n")).to_df().first().asDict() == {"m": 2.0, "n": 5}


def test_half_even_text(csv):
    assert text(csv("k,v\na,0.125\nb,1.005\nc,2.675\n").ordered().group_by("k").agg(Agg("SUM", "v"))).split("\n")[1:4] == ["a,0.12", "b,1.00", "c,2.67"]


def test_csv_and_json_out(spark, csv, tmp_path):
    t = csv('a,b\n1,"x ""y"", z"\n2,\n')
    write_csv(t, str(tmp_path / "c"))
    assert {tuple(r) for r in read_csv(spark, str(tmp_path / "c")).df.collect()} == {("1", 'x "y", z'), ("2", "")}
    write_json(t, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_stdin_and_streams(spark, tmp_path):
    assert read_stdin(spark, io.BytesIO(b"a,b\n1,2\n"), str(tmp_path / "spool")).where(field("a") == 1).df.count() == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.csv").write_text("k,v\na,1\nb,2\na,x\n")
    t = stream_csv(spark, str(tmp_path / "in"), ["k", "v"])
    append_to(t.where(field("v") >= 1).select("k"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    running(t.group_by("k").agg(Agg("COUNT", name="n"), Agg("SUM", "v", "s")), "sums", str(tmp_path / "cp2")).awaitTermination()
    assert {tuple(r) for r in spark.table("sums").collect()} == {("a", 2, 1.0), ("b", 1, 2.0)}


def test_not_a_number_in_typed_columns(spark):
    t = Table.of(spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, 9.0), (4, None)], "k long, v double"))
    ids = lambda p: sorted(r["k"] for r in t.where(p).to_df().collect())
    v = field("v")
    assert [ids(p) for p in (v > 5, v >= 3, v < 5, v == 3, v != 3, v == "nan", v != "nan", ~(v > 5))] == [[3], [2, 3], [2], [2], [1, 3], [], [1, 2, 3], [1, 2, 4]]
    assert t.aggregate(Agg("MIN", "v"), Agg("MAX", "v")).to_df().first()[:] == (3.0, 9.0)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id AS double) AS v").coalesce(1).write.parquet(str(tmp_path / "p"))
    t = Table.of(spark.read.parquet(str(tmp_path / "p")))
    for table in (t.where(field("v") > 50), t.ordered().where(field("v") > 50), t.ordered().where(field("v") > 50).limit(3), t.where(field("v").between(3, 5))):
        plan = table.df._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan" in plan.split("PushedFilters")[1]
    assert [r["id"] for r in t.ordered().where(field("v") > 50).limit(3).to_df().collect()] == [51, 52, 53]


def test_times_are_checked(spark):
    t = Table.of(spark.sql("SELECT TIMESTAMP_NTZ '2020-05-01 10:00:00' AS at"))
    assert t.where(field("at") >= "2020-05").df.count() == t.where(field("at") < "2020-05-01 10:00:01.5").df.count() == 1
    for bad in ("soon", "2020-13-01", "2020-02-30", 7):
        with pytest.raises(ValueError, match="not a date or time"):
            t.where(field("at") > bad)


def test_clauses(csv):
    t = csv("k,v\na,10\nb,9\nc,x\nd,\na,10\n").ordered()
    assert [r["k"] for r in t.order_by(("v", "desc"), "k").to_df().collect()] == ["c", "d", "a", "a", "b"]
    assert [r["k"] for r in t.distinct().limit(10).to_df().collect()] == ["a", "b", "c", "d"]
    assert [r["k"] for r in t.limit(2, offset=1).to_df().collect()] == ["b", "c"]
    assert t.select(("k", "key")).to_df().columns == ["key"]
    assert [r["size"] for r in t.with_case("size", [(field("v") > 9, "big"), (field("v").missing(), "none")], "other").limit(9).to_df().collect()] == ["big", "other", "other", "none", "big"]
    assert t.where(field("k").isin("a", "z")).df.count() == 2 and t.where(field("k").isin()).df.count() == 0 and t.where(~field("k").like("_")).df.count() == 0
    for bad in (lambda: t.order_by(("k", "up")), lambda: t.with_case("c", []), lambda: t.limit(1, -1), lambda: t.select("none")):
        with pytest.raises(ValueError):
            bad()
