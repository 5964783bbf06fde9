"""Block statistics, pruning and the order generator."""

import pytest

from quillon.operators.blocks import blocks_to_read, build_blocks, is_current, load_blocks, pruned_scan, save_blocks, to_sorted_parquet
from quillon.plans.predicates import field
from quillon.sources.generate import orders
from quillon.sources.tables import read_csv


@pytest.fixture
def table(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("id,name\n" + "".join(f"{i},{'n%03d' % i if i % 50 else ''}\n" for i in range(200)))
    return read_csv(spark, str(p)), p


def test_blocks(table):
    blocks = build_blocks(table[0], 50)
    ids = {r["block_id"]: r for r in blocks.where("column = 'id'").collect()}
    assert [(ids[b]["start_row"], ids[b]["end_row"], ids[b]["min_num"], ids[b]["max_num"], ids[b]["type"]) for b in range(4)] == [(0, 50, 0, 49, "numeric"), (50, 100, 50, 99, "numeric"), (100, 150, 100, 149, "numeric"), (150, 200, 150, 199, "numeric")]
    assert {(r["type"], r["empty_count"]) for r in blocks.where("column = 'name'").collect()} == {("string", 1)}


@pytest.mark.parametrize(("predicate", "kept"), [
    (field("id") == 9, {0}), (field("id") >= 100, {2, 3}), (field("id") < 50, {0}), ((field("id") < 50) | (field("id") > 150), {0, 3}),
    ((field("id") > 60) & (field("id") < 70), {1}), (~(field("id") == 9), {0, 1, 2, 3}), (field("name") == "n120", {2}), (field("name") == "", {0, 1, 2, 3}), (field("id") == "x", set()), (field("other") == 1, {0, 1, 2, 3}),
])
def test_pruning_keeps_every_match(table, predicate, kept):
    found = {r["block_id"] for r in blocks_to_read(build_blocks(table[0], 50), predicate).collect()}
    assert found == kept


def test_validation(spark, table, tmp_path):
    t, p = table
    save_blocks(build_blocks(t, 50), str(tmp_path / "blocks"))
    blocks = load_blocks(spark, str(tmp_path / "blocks"))
    assert is_current(blocks, t)
    with p.open("a") as out:
        out.write("200,x\n")
    assert not is_current(blocks, read_csv(spark, str(p)))


def test_sorted_parquet(spark, table, tmp_path):
    to_sorted_parquet(table[0], str(tmp_path / "s"), "name")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 200


def test_generator(spark):
    a, b = orders(spark, 500), orders(spark, 500).repartition(7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.where("total_minor < 0 OR quantity NOT BETWEEN 1 AND 5 OR discount_minor > price_minor / 5").count() == 0
    assert orders(spark, 3, in_time=True).collect()[1]["created_at"] == "2023-01-01T00:00:01Z"


def test_pruned_scan_reads_fewer_files(spark, tmp_path):
    folder = str(tmp_path / "many")
    spark.range(400).selectExpr("id", "id % 7 AS v").repartitionByRange(4, "id").write.option("header", "true").csv(folder)
    t = read_csv(spark, folder)
    save_blocks(build_blocks(t, 50), str(tmp_path / "blocks"))
    blocks = load_blocks(spark, str(tmp_path / "blocks"))
    found = pruned_scan(t, blocks, (field("id") >= 10) & (field("id") < 20))
    assert sorted(int(r["id"]) for r in found.to_df().collect()) == list(range(10, 20))
    out = found.df
    out.collect()
    scans = []

    def walk(node):
        if "FileScan" in node.nodeName() or "Scan csv" in node.nodeName():
            scans.append(node)
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    plan = out._jdf.queryExecution().executedPlan()
    walk(plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan)
    assert [s.metrics().apply("numFiles").value() for s in scans] == [1]
    with (tmp_path / "many" / "later.csv").open("w") as f:
        f.write("id,v\n15,1\n")
    assert pruned_scan(read_csv(spark, folder), blocks, field("id") == 15).df.count() == 2


def test_blocks_reach_over_splits_and_files(spark, tmp_path):
    """Rows are numbered through all files and splits in order, and blocks have as many as asked for."""
    folder = tmp_path / "many"
    folder.mkdir()
    at = 0
    for i, n in enumerate((130, 1, 4000, 77)):  # the largest file, in many splits, is read first
        (folder / f"part-{i}.csv").write_text("id,v\n" + "".join(f"{k},{'nan' if k % 3 else k}\n" for k in range(at, at + n)))
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        found = build_blocks(read_csv(spark, str(folder)), 100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    ids = sorted((r["block_id"], r["start_row"], r["end_row"], r["min_num"], r["max_num"], r["cells"]) for r in found if r["column"] == "id")
    assert ids == [(b, 100 * b, min(at, 100 * b + 100), 100 * b, min(at, 100 * b + 100) - 1, min(at, 100 * b + 100) - 100 * b) for b in range(-(-at // 100))]
    v = {r["block_id"]: r for r in found if r["column"] == "v"}
    assert (v[2]["min_num"], v[2]["max_num"], v[2]["nans"], v[2]["numbers"], v[2]["max_str"]) == (201, 297, 67, 100, "nan")
    assert [f["file"][-10:] for f in v[1]["files"]] == ["part-0.csv", "part-1.csv", "part-2.csv"]


def test_a_block_needs_no_sorted_cells(spark, tmp_path):
    """Memory of a task: the cells of a split aren't sorted to find their bounds."""
    folder = str(tmp_path / "long")
    spark.range(250_000).selectExpr("id", *[f"id % {7 + i} AS c{i}" for i in range(6)]).coalesce(1).write.option("header", "true").csv(folder)
    blocks = build_blocks(read_csv(spark, folder), 5000)
    found = blocks.collect()
    peaks = []

    def walk(node):
        if node.metrics().contains("peakMemory"):
            peaks.append(node.metrics().apply("peakMemory").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(blocks._jdf.queryExecution().executedPlan().executedPlan())
    assert peaks and max(peaks) < 100e6
    assert len(found) == 50 * 7
