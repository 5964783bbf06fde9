"""The catalogue: one query per operator, with SQL that gives the same rows."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.blocks import build_blocks, load_blocks, pruned_scan, save_blocks
from .operators.table import Agg, Grouped, Table
from .plans.predicates import Field, field
from .sinks.text import write_csv, write_csv_text
from .sources.generate import orders
from .sources.tables import read_csv, read_parquet, read_stdin, scratch, stream_csv
from .streaming.live import running

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, table: str, build: Callable[[Table], Table], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(read_parquet(spark, f"{sf_dir}/{table}.parquet")).to_df()
    SQL[name] = sql


def _rounded(name: str, table: str, build: Callable[[Table], Table], sql: str) -> None:
    """Doubles are rounded to two places on both sides: sums depend on the order of addition."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(read_parquet(spark, f"{sf_dir}/{table}.parquet")).to_df()
        return df.select([F.round(c, 2).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

    QUERIES[name], SQL[name] = run, sql


_status, _priority, _price = field("o_orderstatus"), field("o_orderpriority"), field("o_totalprice")
_quantity, _type, _value = field("l_quantity"), field("event_type"), field("value")

_add("scan_all", "nation", lambda t: t.select("*"), "SELECT * FROM nation")
_add("project_cols", "orders", lambda t: t.select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders")
_add("project_case_insensitive", "orders", lambda t: t.select(" O_ORDERKEY "), "SELECT o_orderkey FROM orders")

for _n, _op in {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _m = {"=": Field.__eq__, "!=": Field.__ne__, "<": Field.__lt__, "<=": Field.__le__, ">": Field.__gt__, ">=": Field.__ge__}[_op]
    _add(f"filter_{_n}_str", "orders", lambda t, m=_m: t.where(m(_priority, "3-MEDIUM")).select("o_orderkey", "o_orderpriority"), f"SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority {_op} '3-MEDIUM'")
    _add(f"filter_{_n}_num", "lineitem", lambda t, m=_m: t.where(m(_quantity, 25)).select("l_orderkey", "l_linenumber", "l_quantity"), f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} 25")

_add("filter_quoted_num", "lineitem", lambda t: t.where(_quantity == "25").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 25")
_events = "SELECT event_id, event_type, value FROM events WHERE "
for _n, _p, _w in (
    ("and", (_type == "click") & (_value > 100), "event_type = 'click' AND value > 100"),
    ("or", (_type == "click") | (_type == "view"), "event_type = 'click' OR event_type = 'view'"),
    ("not", ~(_type == "click"), "NOT event_type = 'click'"),
    ("double_not", ~~(_type == "click"), "event_type = 'click'"),
    ("not_and", ~((_type == "click") & (_value > 100)), "NOT (event_type = 'click' AND value > 100)"),
    ("precedence", (_type == "click") | (_type == "view") & (_value > 400), "event_type = 'click' OR event_type = 'view' AND value > 400"),
    ("parens", ((_type == "click") | (_type == "view")) & (_value > 400), "(event_type = 'click' OR event_type = 'view') AND value > 400"),
):
    _add(f"filter_{_n}", "events", lambda t, p=_p: t.where(p).select("event_id", "event_type", "value"), _events + _w)
_add("filter_or5", "orders", lambda t: t.where((_priority == "1-URGENT") | (_priority == "2-HIGH") | (_priority == "3-MEDIUM") | (_priority == "5-LOW") | (_priority == "none")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW', 'none')")
_add("filter_range", "orders", lambda t: t.where((_price > 5000) & (_price < 100000)).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 5000 AND o_totalprice < 100000")
_add("filter_ts", "lineitem", lambda t: t.where(field("l_shipdate") >= "1998-01-01").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
_add("filter_none", "orders", lambda t: t.where(_status == "nothing").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'nothing'")
_number = "TRY_CAST(p_name AS DOUBLE)"
_add("text_eq_num", "part", lambda t: t.where(field("p_name") == 5).select("p_partkey"), f"SELECT p_partkey FROM part WHERE coalesce({_number} = 5, false)")
_add("text_ne_num", "part", lambda t: t.where(field("p_name") != 5).select("p_partkey"), f"SELECT p_partkey FROM part WHERE coalesce({_number} != 5, false)")
_add("text_not_eq_num", "part", lambda t: t.where(~(field("p_name") == 5)).select("p_partkey"), f"SELECT p_partkey FROM part WHERE NOT coalesce({_number} = 5, false)")

_add("group_count", "orders", lambda t: t.group_by("o_orderstatus").agg(Agg("COUNT", name="n")), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
_add("group_count_col", "orders", lambda t: t.group_by("o_orderstatus").agg(Agg("COUNT", "o_custkey", "n")), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
_rounded("group_sum", "lineitem", lambda t: t.group_by("l_returnflag").agg(Agg("SUM", "l_extendedprice", "total")), "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
_rounded("group_avg", "lineitem", lambda t: t.group_by("l_returnflag").agg(Agg("AVG", "l_quantity", "mean")), "SELECT l_returnflag, round(avg(l_quantity), 2) AS mean FROM lineitem GROUP BY 1")
_rounded("group_min_max", "lineitem", lambda t: t.group_by("l_returnflag").agg(Agg("MIN", "l_extendedprice", "low"), Agg("MAX", "l_extendedprice", "high")), "SELECT l_returnflag, round(min(l_extendedprice), 2) AS low, round(max(l_extendedprice), 2) AS high FROM lineitem GROUP BY 1")
_add("group_multi", "lineitem", lambda t: t.group_by("l_returnflag", "l_linestatus").agg(Agg("COUNT", name="n")), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
_rounded("group_where", "lineitem", lambda t: t.where(_quantity > 25).group_by("l_returnflag", "l_linestatus").agg(Agg("COUNT", name="n"), Agg("SUM", "l_quantity", "total")), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2")


def _five(grouped: Grouped, column: str) -> Table:
    return grouped.agg(Agg("COUNT", name="n"), Agg("SUM", column, "total"), Agg("AVG", column, "mean"), Agg("MIN", column, "low"), Agg("MAX", column, "high"))


_five_sql = "count(*) AS n, round(sum({0}), 2) AS total, round(avg({0}), 2) AS mean, round(min({0}), 2) AS low, round(max({0}), 2) AS high"
_rounded("group_all_aggs", "events", lambda t: _five(t.group_by("event_type"), "value"), f"SELECT event_type, {_five_sql.format('value')} FROM events GROUP BY 1")
_add("group_distinct", "lineitem", lambda t: t.group_by("l_returnflag").distinct(), "SELECT DISTINCT l_returnflag FROM lineitem")
_add("group_empty", "orders", lambda t: t.where(_price > 1e12).group_by("o_orderstatus").agg(Agg("COUNT", name="n")), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1e12 GROUP BY 1")
_rounded("aggregate_all", "orders", lambda t: t.aggregate(Agg("COUNT", name="n"), Agg("AVG", "o_totalprice", "mean")), "SELECT count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders")
_add("limit_zero", "orders", lambda t: t.limit(0), "SELECT * FROM orders LIMIT 0")
_add("limit_all", "nation", lambda t: t.limit(1000), "SELECT * FROM nation LIMIT 1000")


def _as_csv(spark: SparkSession, sf_dir: str, name: str) -> Table:
    folder = scratch(spark) + f"/{name}"
    write_csv(read_parquet(spark, f"{sf_dir}/{name}.parquet"), folder)
    return read_csv(spark, folder)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_csv(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").to_df()


def csv_filter_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in text cells against a number."""
    return _as_csv(spark, sf_dir, "customer").where((field("c_acctbal") >= 5000) & ~(field("c_mktsegment") == "BUILDING")).select("c_custkey", "c_name").to_df()


def csv_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _five(_as_csv(spark, sf_dir, "customer").group_by("c_mktsegment"), "c_acctbal").to_df()
    return df.select([F.round(c, 2).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of columns over all blocks of a CSV file."""
    blocks = build_blocks(_as_csv(spark, sf_dir, "customer"), 1000)
    return blocks.groupBy("column").agg(F.min("min_str").alias("min_str"), F.max("max_str").alias("max_str"), F.min("min_num").alias("min_num"), F.max("max_num").alias("max_num"), F.sum("empty_count").alias("empty_count"), F.sum("cells").alias("cells"))


def generated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator's invariants over many rows."""
    t = Table.of(orders(spark, 100_000))
    return t.where((field("total_minor") >= 0) & (field("quantity") <= 5) & (field("price_minor") >= 1000)).aggregate(Agg("COUNT", name="n"), Agg("MIN", "price_minor", "low")).to_df()


_bounds = "SELECT '{0}' AS \"column\", min(CAST({0} AS VARCHAR)) AS min_str, max(CAST({0} AS VARCHAR)) AS max_str, min(TRY_CAST(CAST({0} AS VARCHAR) AS DOUBLE)) AS min_num, max(TRY_CAST(CAST({0} AS VARCHAR) AS DOUBLE)) AS max_num, CAST(0 AS BIGINT) AS empty_count, count(*) AS cells FROM customer"
QUERIES |= {"csv_roundtrip": csv_roundtrip, "csv_filter_num": csv_filter_num, "csv_group": csv_group, "block_stats": block_stats, "generated_orders": generated_orders}
SQL |= {
    "csv_roundtrip": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
    "csv_filter_num": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_acctbal >= 5000 AND NOT c_mktsegment = 'BUILDING'",
    "csv_group": f"SELECT c_mktsegment, {_five_sql.format('c_acctbal')} FROM customer GROUP BY 1",
    "block_stats": " UNION ALL ".join(_bounds.format(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "generated_orders": "SELECT CAST(100000 AS BIGINT) AS n, CAST(1000 AS DOUBLE) AS low",
}

# ---- filters and clauses beside comparisons

_add("filter_in", "orders", lambda t: t.where(_status.isin("O", "P")).select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
_add("filter_not_in", "lineitem", lambda t: t.where(~_quantity.isin(1, 25, 50)).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT IN (1, 25, 50)")
_add("filter_between", "orders", lambda t: t.where(_price.between(50000, 60000)).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
_add("filter_like", "customer", lambda t: t.where(field("c_name").like("%7_")).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%7_'")
_add("select_alias", "orders", lambda t: t.select(("o_orderkey", "id"), ("o_totalprice", "price")), "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
_add("select_distinct", "lineitem", lambda t: t.select("l_returnflag", "l_linestatus").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_add("top_k", "orders", lambda t: t.order_by(("o_totalprice", "desc"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_add("limit_offset", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber").order_by("l_orderkey", ("l_linenumber", "desc")).limit(40, offset=15), "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber DESC LIMIT 40 OFFSET 15")
_add("case_when", "events", lambda t: t.with_case("size", [(_value >= 400, "large"), ((_value >= 100) & ~(_type == "error"), "middle")], "small").select("event_id", "size"), "SELECT event_id, CASE WHEN value >= 400 THEN 'large' WHEN value >= 100 AND NOT event_type = 'error' THEN 'middle' ELSE 'small' END AS size FROM events")
_add("having", "lineitem", lambda t: t.group_by("l_suppkey").agg(Agg("COUNT", name="n")).where(field("n") > 5), "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 5")
_add("ordered_filter", "orders", lambda t: t.ordered().where(_price > 400000).select("o_orderkey").limit(50), "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 LIMIT 50")


# ---- cells that are no number, missing, or not-a-number


def _made(name: str, column: Callable[[], Column], build: Callable[[Table], Table], sql: str) -> None:
    """Over events with one more column x."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(Table.of(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", column().alias("x")))).to_df()
        return df.select([F.round(c, 2).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

    QUERIES[name], SQL[name] = run, sql


_id = lambda: F.col("event_id")
#: A number as text, a word, or nothing; and a double that may be not-a-number.
_mixed = lambda: F.when(_id() % 3 == 0, F.col("value").cast("string")).when(_id() % 3 == 1, F.col("event_type")).otherwise("")
_nan = lambda: F.when((_id() % 5 == 0) | (F.col("event_type") == "view"), F.lit(float("nan"))).otherwise(F.col("value"))
_mixed_sql = "(SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN event_type ELSE '' END AS x FROM events)"
_nan_sql = "(SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 OR event_type = 'view' THEN 'nan'::DOUBLE ELSE value END AS x FROM events)"
_x = field("x")
for _n, _p, _w in (
    ("gt", _x > 250, "TRY_CAST(x AS DOUBLE) > 250"), ("ne", _x != 250, "TRY_CAST(x AS DOUBLE) != 250"), ("not_gt", ~(_x > 250), "NOT coalesce(TRY_CAST(x AS DOUBLE) > 250, false)"),
    ("missing", _x.missing(), "x = ''"), ("not_missing", ~_x.missing(), "x <> ''"), ("empty", _x == "", "x = ''"), ("text", _x < "error", "x < 'error'"),
):
    _made(f"mixed_{_n}", _mixed, lambda t, p=_p: t.where(p).select("event_id"), f"SELECT event_id FROM {_mixed_sql} WHERE {_w}")
for _n, _p, _w in (
    ("gt", _x > 250, "x > 250 AND NOT isnan(x)"), ("le", _x <= 250, "x <= 250"), ("ne", _x != 250, "x != 250"), ("not_gt", ~(_x > 250), "NOT (x > 250 AND NOT isnan(x))"),
    ("eq_nan", _x == "nan", "false"), ("ne_nan", _x != "nan", "true"),
):
    _made(f"typed_nan_{_n}", _nan, lambda t, p=_p: t.where(p).select("event_id"), f"SELECT event_id FROM {_nan_sql} WHERE {_w}")
_made("typed_nan_extremes", _nan, lambda t: t.group_by("event_type").agg(Agg("COUNT", name="n"), Agg("MIN", "x", "low"), Agg("MAX", "x", "high")), f"SELECT event_type, count(*) AS n, round(min(x) FILTER (NOT isnan(x)), 2) AS low, round(max(x) FILTER (NOT isnan(x)), 2) AS high FROM {_nan_sql} GROUP BY 1")
_made("mixed_aggregates", _mixed, lambda t: _five(t.group_by("event_type"), "x"), f"SELECT event_type, {_five_sql.format('TRY_CAST(x AS DOUBLE)')} FROM {_mixed_sql} GROUP BY 1")
_made("group_without_numbers", _mixed, lambda t: _five(t.where(_x.missing()).group_by("event_type"), "x"), f"SELECT event_type, count(*) AS n, 0.0::DOUBLE AS total, 0.0::DOUBLE AS mean, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM {_mixed_sql} WHERE x = '' GROUP BY 1")


# ---- blocks, standard input, streams

#: Rows of a file of pruned_blocks.
FILE_ROWS = 500_000


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block of a table with its bounds. The table is written in the order of its rows, which several tasks else don't keep."""
    folder = scratch(spark)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    write_csv(Table.of(rows.orderBy("_metadata.file_path", "_metadata.row_index")), folder)
    return build_blocks(read_csv(spark, folder), 100).where(F.col("column") == "c_custkey").select("block_id", "start_row", "end_row", "type", "min_num", "max_num", "empty_count", "cells")


def pruned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter over files of which saved statistics leave few. Larger tables have more files, none of more than about FILE_ROWS rows."""
    folder, kept = scratch(spark), scratch(spark)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows.repartitionByRange(max(8, -(-rows.count() // FILE_ROWS)), "o_totalprice").write.mode("overwrite").options(header="true").csv(folder)
    t = read_csv(spark, folder)
    save_blocks(build_blocks(t, 5000), kept)
    return pruned_scan(t, load_blocks(spark, kept), _price > 450000).select("o_orderkey", "o_totalprice").to_df()


def stdin_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    write_csv_text(read_parquet(spark, f"{sf_dir}/nation.parquet"), out)
    return read_stdin(spark, io.BytesIO(out.getvalue().encode())).group_by("n_regionkey").agg(Agg("COUNT", name="n"), Agg("MAX", "n_nationkey", "high")).to_df()


def stream_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts over a folder of CSV files, after all that has arrived."""
    folder, name = scratch(spark), "quillon_stream_group"
    write_csv(read_parquet(spark, f"{sf_dir}/customer.parquet"), folder)
    header = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    running(stream_csv(spark, folder, header).where(field("c_acctbal") > 0).group_by("c_mktsegment").agg(Agg("COUNT", name="n")), name, scratch(spark)).awaitTermination()
    return spark.table(name)


QUERIES |= {"block_rows": block_rows, "pruned_blocks": pruned_blocks, "stdin_group": stdin_group, "stream_group": stream_group}
SQL |= {
    "block_rows": "SELECT CAST(b AS BIGINT) AS block_id, CAST(b * 100 AS BIGINT) AS start_row, CAST(b * 100 + count(*) AS BIGINT) AS end_row, 'numeric' AS type, CAST(min(c_custkey) AS DOUBLE) AS min_num, CAST(max(c_custkey) AS DOUBLE) AS max_num, CAST(0 AS BIGINT) AS empty_count, count(*) AS cells FROM (SELECT c_custkey, (row_number() OVER () - 1) // 100 AS b FROM customer) GROUP BY b",
    "pruned_blocks": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders WHERE o_totalprice > 450000",
    "stdin_group": "SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, count(*) AS n, CAST(max(n_nationkey) AS DOUBLE) AS high FROM nation GROUP BY 1",
    "stream_group": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1",
}
