"""Statements over named frames."""

import pytest

from rowloom import Frame
from rowloom.errors import RowloomError
from rowloom.operators import aggregate, display, generate, search, sort
from rowloom.operators.workspace import Workspace
from rowloom.sources.csv import csv_export


@pytest.fixture
def work(spark):
    staff = Frame.create(spark, [("Name", "string"), ("Pay", "int"), ("City", "string")], [("Sal", 100, "Bergen"), ("Eve", 250, "Oslo"), ("Mo", 300, "Lima"), ("Di", 50, "Rome")])
    return Workspace(spark, Staff=staff, least=90, key="Mo", col="City")


def seen(got):
    return got.list() if isinstance(got, Frame) and got.width == 1 else got.rows() if isinstance(got, Frame) else got


@pytest.mark.parametrize(("text", "want"), [
    ("Staff.Pay", [100, 250, 300, 50]), ("Staff.(Pay, Name)[1]", [250, "Eve"]), ("Staff.$col[end]", "Rome"), ("Staff.Pay[1:2]", [250, 300]), ("Staff.Pay[{3, 0, 3}]", [50, 100, 50]),
    ("Staff.Name[Staff.Pay > 90 && Staff.City != 'Lima']", ["Sal", "Eve"]), ("Staff.Name.Mo", 2), ("Staff.Name.$key", 2), ("Staff.Name . 'Di'", 3), ("%Staff", 4), ("% {1, 2}", 2), ("%(@int {1})", None),
    ("@int {3, 1, 2}", [3, 1, 2]), ("@int 0:9:3", [0, 3, 6]), ("@string(@int {7})", ["7"]), ("@double {1}", [1.0]), ("@table(a int, b string) {{1, 'x'}, {2, 'y'}}", [(1, "x"), (2, "y")]),
    ("@reverse(Staff.Pay)", [50, 300, 250, 100]), ("@sum(Staff.Pay)", 700), ("@lookup(Staff.Name, 'Eve')", 1), ("@lookup(Staff.Name, 'Zed')", -1), ("@list(Staff.Pay)", [100, 250, 300, 50]), ("@dict(Staff.Name).2", "Mo"),
    ("@delete(Staff.Pay, 1:2)", [100, 50]), ("@delete(Staff.Pay, {0, 3})", [250, 300]), ("@delete(Staff, Staff.Pay > 90)", [("Di", 50, "Rome")]), ("@delete(Staff.Pay, 0)", [250, 300, 50]),
    ("@fill(Staff.Pay, 1, 2:3)", [100, 250, 1, 1]), ("@fill(Staff.Pay, 9, Pay < 101)", [9, 250, 300, 9]), ("@inject(Staff.Pay, {7, 8}, 1)", [100, 7, 8, 250, 300, 50]), ("@insert(Staff.Pay, 5, end, 2)", [100, 250, 300, 50, 5, 5]),
    ("@sort Staff.Pay decreasing", [300, 250, 100, 50]), ("@sort Staff.Pay indices", [3, 0, 1, 2]), ("@sort {2, 0, 1} -> Staff.Pay", [0, 1, 2]), ("@search Staff.Pay > 90", 0), ("@search Staff.Pay > 90 all", [0, 1, 2]),
    ("@search Staff.Pay > 90 all inline", [100, 250, 300]), ("@search {3, 2, 0} -> Staff.Pay > 90 all", [2, 0]), ("@search Staff.City =^ 'LIMA' inline", "Lima"), ("@search Staff.City == 'x'", -1), ("Staff.Pay[@search Staff.Pay > 200 all]", [250, 300]),
])
def test_values(work, text, want):
    if want is None:
        with pytest.raises(RowloomError):
            work.run(text)
    else:
        assert seen(work.run(text)) == want


@pytest.mark.parametrize(("text", "pay"), [
    ("Staff.Pay[Staff.Pay < 260] = Staff.Pay[Staff.Pay < 260] + 1000", [1100, 1250, 300, 1050]), ("Staff.Pay[1:2] = 0", [100, 0, 0, 50]), ("Staff.Pay[{0, 2}] = {1, 2}", [1, 250, 2, 50]), ("Staff.Pay[end] = 7", [100, 250, 300, 7]),
    ("Staff.(Pay, City)[Staff.Name.Sal] = {70, 'Kyiv'}", [70, 250, 300, 50]), ("Staff.Pay = @int {4, 3, 2, 1}", [4, 3, 2, 1]), ("Staff.Pay[1: && Pay > $least] = 1", [100, 1, 1, 50]),
])
def test_assignments(work, text, pay):
    work.run(text)
    assert work.held["Staff"].list("Pay") == pay


def test_names_and_errors(work):
    assert seen(work.run("Copy = Staff.Name")) == seen(work.run("Copy"))
    assert len(seen(work.run("@int[5] 0:10:*"))) == 5
    for bad in ("Nope", "Staff.Name.Zed", "Staff[", "@nope(Staff)", "@sort Staff.Pay sideways", "@search Staff.Pay", "Staff.Pay extra", "1 = 2"):
        with pytest.raises(RowloomError):
            work.run(bad)


def test_shapes(work):
    staff = work.held["Staff"]
    assert sort.as_list(staff.slice(["Pay", "Name"]))[1] == [250, "Eve"]
    assert list(sort.as_dict(staff.slice(["Name"]), sort.sort_positions(staff, "Pay")).items()) == [(3, "Di"), (0, "Sal"), (1, "Eve"), (2, "Mo")]
    assert sort.as_dict(sort.span(staff, 1, 2).slice(["Pay", "Name"])) == {0: [250, "Eve"], 1: [300, "Mo"]}
    assert sort.as_dict(staff.slice(["Pay"]), Frame.column(work.spark, "int", [3, 0])) == {3: 50, 0: 100}
    mixed = Frame.column(work.spark, "string", ["b", "A", "a", "B"])
    assert [r[1] for r in sort.sort_indirect(mixed, [3, 2, 1, 0], [0], nocase=True).orderBy("pos").collect()] == [2, 1, 3, 0]


def test_categorizer_function(work):
    def size(pos, value):
        if value > 250:
            raise aggregate.Stop
        if pos == 0:
            raise aggregate.Skip
        return "small" if value < 100 else "big"

    got = aggregate.categorize_with(work.held["Staff"], size, "Pay", ltype="string", positions=True).collect()
    assert [tuple(r) for r in got] == [(1, "big", [1])]
    plain = aggregate.categorize_with(work.held["Staff"], lambda p, v: v % 100, "Pay", ltype="int").orderBy("first").collect()
    assert [(r["Category"], r["Data"]) for r in plain] == [(0, [100, 300]), (50, [250, 50])]


def test_process_wide_seeds(spark):
    generate.randseed(100, 200)
    first, more = generate.random(spark, "int", 20).list(), generate.random(spark, "int", 20).list()
    generate.randseed(100, 200)
    assert generate.random(spark, "int", 20).list() == first != more
    generate.randseed()
    assert generate.random(spark, "int", 20).list() != first
    generate.randseed(42, 54)


def test_line_ends_and_boxes(spark, tmp_path, work):
    csv_export(work.held["Staff"].slice(["Pay"]), str(tmp_path / "out"), translation="crlf")
    [part] = (tmp_path / "out").glob("part-*")
    assert part.read_bytes() == b"100\r\n250\r\n300\r\n50\r\n"
    with pytest.raises(RowloomError):
        csv_export(work.held["Staff"], str(tmp_path / "no"), translation="dos")
    assert display.prettify(work.held["Staff"].slice(["Pay"]), style="graphics").split("\n")[:2] == ["┌─────┐", "│ Pay │"]


def test_no_single_partition_to_find_positions(spark):
    from rowloom import queries

    for name in ("search_first", "lookup_key", "minmax_indices", "distinct_first"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan.replace("windowspecdefinition(i", "").replace("Window [sum", ""), name


def test_many_first_rows(spark):
    from rowloom.plans import frame as frames

    rows = Frame(spark.range(5000).selectExpr("4999 - id AS k", "id % 1700 AS v"), ["k"])
    want = {}
    for i in range(5000):
        want.setdefault((4999 - i) % 1700, i)
    assert {r["value"]: r["first"] for r in aggregate.distinct(rows, "v").collect()} == want
    few = Frame(rows.df.withColumn("v", rows.df["v"] % 7), ["k"])
    want = {}
    for i in range(5000):
        want.setdefault((4999 - i) % 1700 % 7, i)
    assert {r["value"]: r["first"] for r in aggregate.distinct(few, "v").collect()} == want
    assert frames.FEW_ROWS < 1700
    assert search.search(rows, 3, "v").first()["found"] == min(i for i in range(5000) if (4999 - i) % 1700 == 3)
