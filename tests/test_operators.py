"""Search options, arithmetic, aggregation, joins, sets, generators, selection text, sources, display and streams."""

import math as pymath
import operator
import re
from collections import Counter
from typing import NamedTuple

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowloom import Frame
from rowloom.errors import BadName, BadValue, RowloomError, TypeMismatch
from rowloom.functions import types
from rowloom.functions.math import Operand, exact, math
from rowloom.functions.predicates import glob_regex
from rowloom.operators import aggregate, display, generate, search
from rowloom.operators import join as joins
from rowloom.plans.selector import condition, expression, select_expr, table_filter
from rowloom.sources import csv, database, samples
from rowloom.streaming.live import search_stream, summarize_stream


def column(spark, values, ltype="int"):
    return Frame.column(spark, ltype, values)


def ordered(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


# ---- search ---------------------------------------------------------------------------------------


def test_search_shapes(spark):
    c = column(spark, [5, 7, 5, 9])
    assert search.search(c, 5).first()["found"] == 0
    assert search.search(c, 6).first()["found"] == -1
    assert search.search(c, 6, oper="gt", inline=True).first()["value"] == 7
    assert ordered(search.search(c, 5, all=True), "pos") == [(0,), (2,)]
    assert ordered(search.search(c, 5, all=True, inline=True), "pos") == [(0, 5), (2, 5)]
    assert [r["found"] for r in search.search(c, 5, bitmap=True).orderBy("pos").collect()] == [True, False, True, False]
    assert [r["found"] for r in search.search(c, 5, bitmap=True, span=(1, "end")).orderBy("pos").collect()] == [False, False, True, False]
    with pytest.raises(BadValue):
        search.search(c, 5, bitmap=True, inline=True)


def test_among_keeps_order_and_repeats(spark):
    c = column(spark, [10, 20, 30, 40])
    got = search.search(c, 15, oper="gt", all=True, among=[3, 1, 3, 9, 0])
    assert [r["pos"] for r in got.orderBy("ord").collect()] == [3, 1, 3]
    assert search.count(c, 15, oper="gt", among=[3, 1, 3, 9, 0]).first()["n"] == 3
    assert search.search(c, 15, oper="gt", among=[3, 1]).first()["found"] == 3


@pytest.mark.parametrize(("oper", "negate", "f"), [("eq", False, operator.eq), ("eq", True, operator.ne), ("gt", False, operator.gt), ("gt", True, operator.le), ("lt", False, operator.lt), ("lt", True, operator.ge)])
@pytest.mark.parametrize("ltype", ["byte", "int", "uint", "wide", "double", "string", "any"])
def test_operators_over_types(spark, oper, negate, f, ltype):
    values = ["a", "B", "b", "ab", ""] if ltype in ("string", "any") else [0, 3, 7, 7, 200]
    probe = values[2]
    got = search.count(column(spark, values, ltype), probe, oper=oper, negate=negate).first()["n"]
    assert got == sum(f(v, probe) for v in values)


def test_not_a_number_matches_nothing_and_its_negation_everything(spark):
    c = column(spark, [float("nan"), 1.0, 2.0], "double")
    for oper in ("gt", "lt", "eq"):
        n = search.count(c, 1.0, oper=oper).first()["n"]
        assert search.count(c, 1.0, oper=oper, negate=True).first()["n"] == 3 - n
    assert search.count(c, 1.0, oper="gt").first()["n"] == 1


@pytest.mark.parametrize(("pattern", "hits"), [("a*", ["ab", "a", "a+b"]), ("?b", ["ab", "xb"]), ("[ax]b", ["ab", "xb"]), ("*", ["ab", "xb", "a", "", "a+b", "*"]), (r"\*", ["*"]), ("a+b", ["a+b"]), ("[^a]b", ["ab"])])
def test_globs(spark, pattern, hits):
    c = column(spark, ["ab", "xb", "a", "", "a+b", "*"], "string")
    got = search.search(c, pattern, oper="pat", all=True, inline=True).orderBy("pos").collect()
    assert [r["value"] for r in got] == hits
    assert [v for v in ("ab", "xb", "a", "", "a+b", "*") if re.match(glob_regex(pattern).replace(r"\z", r"\Z"), v)] == hits


def test_text_options(spark):
    c = column(spark, ["Red", "RED", "green"], "string")
    assert search.count(c, "red", nocase=True).first()["n"] == 2
    assert search.count(c, "^r.d$", oper="re", nocase=True).first()["n"] == 2
    assert search.count(c, "E", oper="re").first()["n"] == 1
    assert ordered(search.lookup(c, ["green", "blue"]), "key") == [("blue", -1), ("green", 2)]
    for bad in (lambda: search.count(column(spark, [1]), "1", oper="pat"), lambda: search.count(column(spark, [1]), 1, nocase=True), lambda: search.count(column(spark, [True], "boolean"), True, oper="gt"), lambda: search.lookup(column(spark, [1]), ["1"])):
        with pytest.raises(TypeMismatch):
            bad()


# ---- arithmetic -----------------------------------------------------------------------------------


def value(spark, o):
    return spark.range(1).select(o.c.alias("v")).first()["v"]


class of(NamedTuple):  # noqa: N801
    """An operand of a given type, made when a session is there."""

    v: object
    ltype: str

    def made(self):
        return Operand(F.lit(self.v).cast(types.SPARK[self.ltype]), self.ltype)


def made(operands):
    return [o.made() if isinstance(o, of) else o for o in operands]


@pytest.mark.parametrize(("op", "operands", "want", "ltype"), [
    ("+", [of(250, "byte"), 10], 4, "byte"), ("+", [of(2**31 - 1, "int"), 1], -(2**31), "int"), ("-", [of(0, "uint"), of(1, "uint")], 2**32 - 1, "uint"),
    ("+", [of(2**63 - 1, "wide"), 1], -(2**63), "wide"), ("*", [of(2**62, "wide"), 4], 0, "wide"), ("-", [of(5, "int")], 5, "int"),
    ("/", [of(-7, "int"), 2], -4, "int"), ("/", [of(7, "int"), of(-2, "int")], -4, "int"), ("/", [of(1.0, "double"), 0], float("inf"), "double"), ("/", [of(-1.0, "double"), 0.0], float("-inf"), "double"),
    ("**", [2, 3, 2], 512.0, "double"), ("+", [of(True, "boolean"), True], 2, "int"), ("+", [200, 100], 300, "int"), ("*", [2**40, 2**40], 0, "byte"), ("-", [0, 200], -200, "int"), ("&", [of(12, "int"), 10], 8, "int"), ("^", [True, True], False, "boolean"), ("|", [of(8, "byte"), 3], 11, "byte"),
    ("&&", [of(3, "int"), 0], False, "boolean"), ("^^", [of(3, "int"), 0], True, "boolean"), ("<", [1, 2, 3], True, "boolean"), ("<", [1, 3, 2], False, "boolean"), ("==", [of(16, "int"), "0x10"], False, "boolean"),
    ("<", [of(9, "int"), "10"], False, "boolean"), ("==", [5], True, "boolean"), ("!=", [of(float("nan"), "double"), 1.0], True, "boolean"),
])
def test_math(spark, op, operands, want, ltype):
    got = math(op, *made(operands))
    assert (value(spark, got), got.ltype) == (want, ltype)


def test_math_that_is_wrong(spark):
    assert pymath.isnan(value(spark, math("/", of(0.0, "double").made(), 0.0)))
    for bad in (lambda: math("+", "a", 1), lambda: math("&", 1.5, 1)):
        with pytest.raises(TypeMismatch):
            bad()
    for bad in (lambda: math("!=", 1, 2, 3), lambda: math("%", 1, 2), lambda: exact("+", "int", 2**31 - 1, 1)):
        with pytest.raises(BadValue):
            bad()
    with pytest.raises(PySparkException):
        value(spark, math("/", of(1, "int").made(), 0))
    assert exact("*", "wide", 2**31, 2**31) == 2**62


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=20))
def test_wide_arithmetic_wraps(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    a, b = Operand(F.col("a"), "wide"), Operand(F.col("b"), "wide")
    got = df.select(*(math(op, a, b).c.alias(n) for op, n in (("+", "p"), ("-", "m"), ("*", "t")))).collect()
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    assert [tuple(r) for r in got] == [(wrap(x + y), wrap(x - y), wrap(x * y)) for x, y in pairs]


# ---- aggregation ----------------------------------------------------------------------------------


def test_sums(spark):
    assert aggregate.sum(column(spark, [2**31 - 1, 1])).first()["sum"] == 2**31
    assert aggregate.sum(column(spark, [2**63 - 1, 1], "wide")).first()["sum"] == -(2**63)
    assert aggregate.sum(column(spark, [])).first()["sum"] == 0
    for ltype, v in (("boolean", True), ("string", "1")):
        with pytest.raises(TypeMismatch):
            aggregate.sum(column(spark, [v], ltype))


def test_extremes(spark):
    c = column(spark, [3, 1, 3, 1, 2])
    assert tuple(aggregate.minmax(c).first()) == (1, 3)
    assert tuple(aggregate.minmax(c, positions=True).first()) == (1, 0)
    assert tuple(aggregate.minmax(c, span=(2, 4)).first()) == (1, 3)
    assert tuple(aggregate.minmax(column(spark, ["b", "A", "C"], "string"), nocase=True).first()) == ("A", "C")
    with pytest.raises(PySparkException):
        aggregate.minmax(column(spark, [])).first()


def test_histograms(spark):
    c = column(spark, [100, 249, 120, 170, 190, 195, 201, 200])
    got = aggregate.histogram(c, 5).orderBy("bucket").collect()
    assert [(r["LowerBound"], r["Data"]) for r in got] == [(100, 2), (130, 0), (160, 1), (190, 4), (220, 1)]
    assert [r["Data"] for r in aggregate.histogram(c, 5, compute="positions").orderBy("bucket").collect()] == [[0, 2], [], [3], [4, 5, 6, 7], [1]]
    assert [r["Data"] for r in aggregate.histogram(c, 5, compute="values").orderBy("bucket").collect()] == [[100, 120], [], [170], [190, 195, 201, 200], [249]]
    assert [r["Data"] for r in aggregate.histogram(c, 1, compute="sum").collect()] == [sum([100, 249, 120, 170, 190, 195, 201, 200])]
    assert [r["Data"] for r in aggregate.histogram(column(spark, range(6)), 6).orderBy("bucket").collect()] == [1] * 6
    assert [r["Data"] for r in aggregate.histogram(column(spark, [0.0, 0.1, 0.3], "double"), 3).orderBy("bucket").collect()] == [1, 1, 1]
    assert [r["Data"] for r in aggregate.histogram(column(spark, [True, False, True], "boolean"), 2).orderBy("bucket").collect()] == [1, 2]
    for bad in (lambda: aggregate.histogram(c, 0), lambda: aggregate.histogram(column(spark, []), 2), lambda: aggregate.histogram(c, 2, low=9, high=1), lambda: aggregate.histogram(column(spark, [True], "boolean"), 3)):
        with pytest.raises(BadValue):
            bad()


def test_categories_and_summaries(spark):
    c = column(spark, [3, 1, 3, 1, 2])
    got = aggregate.categorize(c, positions=True)
    assert ordered(got, "first") == [(0, 3, [0, 2]), (1, 1, [1, 3]), (4, 2, [4])]
    assert ordered(aggregate.summarize(aggregate.categorize(c), compute="sum"), "first") == [(0, 3, 6), (1, 1, 2), (4, 2, 2)]
    assert ordered(aggregate.categorize(c, stop=F.col("value") == 2, skip=F.col("value") == 1), "first") == [(0, 3, [3, 3])]
    assert ordered(aggregate.distinct(c), "first") == [(0, 3), (1, 1), (4, 2)]
    assert [r["pos"] for r in aggregate.ranked_categories(got).orderBy("first").collect()] == [0, 1, 2]
    assert ordered(aggregate.summarize_by(c, F.col("value") > 1, "value", "sum"), "Category") == [(False, 2), (True, 8)]


# ---- joins and sets -------------------------------------------------------------------------------


def test_join_names_and_order(spark):
    got = joins.join(samples.freelancers(spark), samples.freelancer_skills(spark), ordered=True)
    assert got.columns == ["pos", "Id", "Name", "Rate", "Experience", "City", "Id_t1", "Language"]
    assert [(r["Name"], r["Language"]) for r in got.orderBy("pos").collect()] == [("Ines", "SQL"), ("Ines", "Java"), ("Bela", "C"), ("Omar", "SQL"), ("Omar", "Scala"), ("Omar", "C"), ("Lena", "Java")]


def test_join_folding_and_errors(spark):
    a = Frame.create(spark, [("Name", "string"), ("Age", "int")], [("ann", 1), ("Bob", 2)])
    b = Frame.create(spark, [("Name", "string"), ("Grade", "int")], [("ANN", 5), ("bob", 6)])
    assert joins.join(a, b).count() == 0
    assert sorted(tuple(r) for r in joins.join(a, b, nocase=True, t1cols=["Grade"]).collect()) == [("Bob", 2, 6), ("ann", 1, 5)]
    with pytest.raises(TypeMismatch):
        joins.join(a, b, ["Age", "Name"])
    with pytest.raises(BadName):
        joins.join(a, Frame.create(spark, [("x", "int")], []))
    nan = column(spark, [float("nan"), 1.0], "double")
    assert joins.join(nan, nan).count() == 1


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "A", "b", "B", "c"]), max_size=9), st.lists(st.sampled_from(["a", "A", "b", "d"]), max_size=9), st.booleans())
def test_multiset_operations(spark, x, y, nocase):
    both, only_x, only_y = (sorted(r["value"] for r in df.collect()) for df in joins.intersect3(column(spark, x, "string"), column(spark, y, "string"), nocase=nocase))
    fold = str.lower if nocase else str
    a, b = Counter(map(fold, x)), Counter(map(fold, y))
    assert (Counter(map(fold, both)), Counter(map(fold, only_x)), Counter(map(fold, only_y))) == (a & b, a - b, b - a)
    assert Counter(both) + Counter(only_x) == Counter(x)


# ---- generators -----------------------------------------------------------------------------------


@pytest.mark.parametrize(("args", "want", "ltype"), [((5,), [0, 1, 2, 3, 4], "int"), ((2, 9, 3), [2, 5, 8], "int"), ((5, 0, -2), [5, 3, 1], "int"), ((3, 3), [], "int"), ((0.0, 1.0, 0.25), [0.0, 0.25, 0.5, 0.75], "double"), ((2**31, 2**31 + 2), [2**31, 2**31 + 1], "wide")])
def test_series(spark, args, want, ltype):
    got = generate.series(spark, *args)
    assert (got.list(), got.type()) == (want, ltype)


def test_spacing_and_constants(spark):
    assert generate.linspace(spark, 0, 12, 4, ltype="int").list() == [0, 4, 8, 12]
    assert generate.linspace(spark, 0, 12, 4, ltype="int", open=True).list() == [0, 3, 6, 9]
    assert generate.linspace(spark, 3, 9, 1).list() == [3.0]
    assert generate.logspace(spark, 0, 3, 4).list() == pytest.approx([1, 10, 100, 1000])
    assert generate.zeroes(spark, 2, "byte").list() == [0, 0]
    assert generate.bitmap1(spark, 3, [1]).list() == [True, False, True]
    assert generate.bitmap0(spark, 1, [2]).list() == [False, False, True]
    for bad in (lambda: generate.series(spark, 0, 5, -1), lambda: generate.series(spark, 0, 5, 0), lambda: generate.linspace(spark, 0, 1, 0)):
        with pytest.raises(BadValue):
            bad()


@pytest.mark.parametrize(("ltype", "low", "high"), [("byte", None, None), ("int", -5, 5), ("uint", 9, 3), ("wide", None, None), ("double", 2.0, 3.0), ("boolean", None, None)])
def test_random_values(spark, ltype, low, high):
    rng = generate.Rng(spark, ltype, low, high, (1, 2))
    first, more = rng.get(300).list(), rng.get(300).list()
    rng.seed(1, 2)
    assert first == rng.get(300).list() and first != more
    if low is not None:
        assert all(min(low, high) <= v < max(low, high) for v in first)
    assert len(set(first)) > 1
    with pytest.raises(RowloomError):
        generate.Rng(spark, "string")
    with pytest.raises(BadValue):
        generate.Rng(spark, "int", 3, 3)


# ---- selection text -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def staff(spark):
    return Frame.create(spark, [("Name", "string"), ("Pay", "int"), ("City", "string")], [("Sal", 100, "New York"), ("Eve", 250, "Oslo"), ("Mo", 300, "new york"), ("Di", 50, "Rome")])


@pytest.mark.parametrize(("text", "names"), [
    ("Pay > 90 && City != 'New York'", ["Eve", "Mo"]), ("City =^ 'NEW YORK'", ["Sal", "Mo"]), ("!(Pay > 90)", ["Di"]), ("Pay * 2 + 1 == 201 || City ~ '^R'", ["Sal", "Di"]),
    ("1:2", ["Eve", "Mo"]), ("2: && Pay < 100", ["Di"]), ("@@.City =* 'O*'", ["Eve"]), ("Name !~^ 's'", ["Eve", "Mo", "Di"]), ("-Pay < -200", ["Eve", "Mo"]), ("Pay / 7 == 7", ["Di"]),
    ("Pay > $least", ["Mo"]), ("2 ** 3 ** 0 == 2 && Pay & 4", ["Sal", "Mo"]), ("City !^* 'new*'", ["Eve", "Di"]), ("Pay >= 250 ^^ Name == \"Mo\"", ["Eve"]),
])
def test_selections(staff, text, names):
    assert select_expr(staff, text, {"least": 250}).list("Name") == names


@pytest.mark.parametrize("text", ["Pay >", "(Pay", "Nope == 1", "Pay ~ City", "Pay == 1 1", "$x == 1", "Pay ; 1", ""])
def test_bad_selections(staff, text):
    with pytest.raises(RowloomError):
        condition(staff, text)


def test_expressions_have_types(staff):
    assert expression(staff, "Pay + 1.5").ltype == "double"
    assert expression(staff, "Pay + 1").ltype == "int"


@pytest.mark.parametrize(("filters", "names"), [({"Pay": "> 90"}, ["Sal", "Eve", "Mo"]), ({"City": "* ?ew*", "Pay": "<= 100"}, ["Sal"]), ({"Name": "!~ ^[SE]"}, ["Mo", "Di"]), ({"City": "~^ new"}, ["Sal", "Mo"]), ({"Pay": "50"}, ["Di"]), ({"Pay": ""}, ["Sal", "Eve", "Mo", "Di"]), ({"City": "!= Rome"}, ["Sal", "Eve", "Mo"])])
def test_table_filters(staff, filters, names):
    assert search.select(staff, table_filter(staff, filters)).list("Name") == names


# ---- sources --------------------------------------------------------------------------------------


@pytest.mark.parametrize(("content", "options", "definition", "rows"), [
    ("0,1,2\n3,4,5\n", {}, [("Col_1", "wide"), ("Col_2", "wide"), ("Col_3", "wide")], [(0, 1, 2), (3, 4, 5)]),
    ("a b,,n\nx,1.5,2\ny,2,3\n", {}, [("a_b", "string"), ("Col_2", "double"), ("n", "wide")], [("x", 1.5, 2), ("y", 2.0, 3)]),
    ("p;q\n1;\"u;v\"\n2;w\n", {"sniff": True}, [("p", "wide"), ("q", "string")], [(1, "u;v"), (2, "w")]),
    ("7\n8\n", {"header": True}, [("7", "wide")], [(8,)]),
])
def test_csv_import(spark, tmp_path, content, options, definition, rows):
    path = tmp_path / "in.csv"
    path.write_text(content)
    got = csv.csv_import(spark, f"file://{path}", **options)
    assert (got.definition(), got.rows()) == (definition, rows)


def test_csv_round_trip(spark, tmp_path, staff):
    path = f"file://{tmp_path}/out"
    csv.csv_export(staff, path, header=["Name", "Pay", "City"])
    assert csv.csv_import(spark, path, header=True).rows() == staff.rows()
    with pytest.raises(PySparkException):
        csv.csv_export(staff, path)
    csv.csv_export(staff, path, mode="append")
    csv.csv_export(staff, path, mode="overwrite")
    assert csv.csv_import(spark, path, header=False).rows() == staff.rows()


def test_database(spark, tmp_path, staff):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    staff.values.write.format("jdbc").options(url=url, dbtable="staff", **driver).save()
    got = database.db_import(spark, url, "staff", ["Pay", "Name"], order=["Pay"], **driver)
    assert got.rows() == [(50, "Di"), (100, "Sal"), (250, "Eve"), (300, "Mo")]
    assert got.definition() == [("Pay", "int"), ("Name", "any")]
    assert database.logical_type("decimal(10,2)") == "double" and database.logical_type("int", nullable=True) == "any"
    more = spark.createDataFrame([(7, None)], "Pay int, Name string")
    assert database.append_rows(got, more).rows()[-1] == (7, "")


# ---- display and streams --------------------------------------------------------------------------


def test_prettify(spark):
    text = display.prettify(generate.series(spark, 20), first=2, last=1)
    assert text.splitlines() == ["value", "-----", "0", "1", "...", "19"]
    assert display.text_width(column(spark, [5, -100])).first()["width"] == 4
    assert display.text_width(column(spark, [])).first()["width"] == 0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "2024-01-01 00:00:10"), ("a", 2, "2024-01-01 00:00:50"), ("b", 5, "2024-01-01 00:01:10")], "kind string, n int, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    got = summarize_stream(search_stream(stream, "n", 0, "gt"), "kind", "n", "at", "1 minute", "10 seconds")
    q = got.writeStream.outputMode("complete").format("memory").queryName("rowloom_stream").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        assert sorted((r["label"], r["n"], r["total"]) for r in spark.table("rowloom_stream").collect()) == [("a", 2, 3), ("b", 1, 5)]
    finally:
        q.stop()
