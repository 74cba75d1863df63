"""Frames: order and positions, types, and everything that reads or writes by position."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowloom import Frame, Ref
from rowloom.errors import BadIndex, BadName, BadValue, ShapeMismatch, TypeMismatch
from rowloom.operators import mutate, search, sort, vector
from rowloom.plans.frame import bounds, number, position


def column(spark, values, ltype="int"):
    return Frame.column(spark, ltype, values)


@pytest.fixture(scope="module")
def pairs(spark):
    return Frame.create(spark, [("a", "int"), ("b", "string")], [(10, "x"), (20, "y"), (30, "z"), (40, "w")])


def test_definition_and_types(pairs):
    assert pairs.definition() == [("a", "int"), ("b", "string")]
    assert (pairs.width, pairs.size(), pairs.name(1)) == (2, 4, "b")
    assert pairs.rows() == [(10, "x"), (20, "y"), (30, "z"), (40, "w")]
    assert list(pairs.loop()) == pairs.rows()


@pytest.mark.parametrize(("definition", "rows", "error"), [
    ([("a", "int"), ("a", "int")], [], BadName), ([("1a", "int")], [], BadName),
    ([("a", "int")], [(1, 2)], ShapeMismatch), ([("a", "byte")], [(256,)], BadValue), ([("a", "int")], [(1.5,)], BadValue),
])
def test_bad_literal_tables(spark, definition, rows, error):
    with pytest.raises(error):
        Frame.create(spark, definition, rows)


@pytest.mark.parametrize(("ltype", "low", "high"), [("byte", 0, 255), ("int", -(2**31), 2**31 - 1), ("uint", 0, 2**32 - 1), ("wide", -(2**63), 2**63 - 1)])
def test_domains_hold_at_their_ends(spark, ltype, low, high):
    assert column(spark, [low, high], ltype).list() == [low, high]
    for v in (low - 1, high + 1):
        with pytest.raises(BadValue):
            column(spark, [v], ltype)


@pytest.mark.parametrize(("spec", "size", "insert", "want"), [("end", 5, False, 4), ("end", 5, True, 5), ("end-2", 5, False, 2), ("end+1", 5, False, 5), (3, 5, False, 3), ("2", 5, False, 2)])
def test_positions(spec, size, insert, want):
    assert position(spec, size, insert) == want


def test_bounds_are_inclusive():
    assert bounds(-3, 2, 9) == (0, 2)
    assert bounds(5, 2, 9) == (5, 4)
    with pytest.raises(BadIndex):
        position("last", 3)


def test_numbering_is_the_same_however_it_is_done(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("k"), "id").repartition(7)
    few = number(df, ["k"], distributed=False).orderBy("pos").collect()
    many = number(df, ["k"], distributed=True).orderBy("pos").collect()
    assert [(r["pos"], r["k"]) for r in few] == [(r["pos"], r["k"]) for r in many]
    assert number(df.where("id < 0"), ["k"], distributed=True).count() == 0


def test_zip_and_replace(spark):
    t = Frame.zip(["n", "s"], [column(spark, [3, 1]), column(spark, ["p", "q"], "string")])
    assert t.rows() == [(3, "p"), (1, "q")]
    assert t.with_column("n", column(spark, [8, 9])).rows() == [(8, "p"), (9, "q")]
    with pytest.raises(ShapeMismatch):
        t.with_column("n", column(spark, [1, 2, 3]))
    with pytest.raises(ShapeMismatch):
        Frame.zip(["n", "s"], [column(spark, [1]), column(spark, [1, 2])])


def test_get_keeps_order_and_repeats(pairs):
    assert mutate.get(pairs, [3, 0, 3]).rows() == [(40, "w"), (10, "x"), (40, "w")]
    assert mutate.get(pairs, F.col("a") > 20, ["b"]).list("b") == ["z", "w"]
    with pytest.raises(PySparkException):
        mutate.get(pairs, [9]).rows()
    with pytest.raises(BadIndex):
        mutate.get(pairs, [0, "end"])


def test_spans(pairs):
    assert sort.span(pairs, 1, 2).rows() == [(20, "y"), (30, "z")]
    assert sort.span(pairs, "end-1", "end").list("a") == [30, 40]
    assert sort.span(pairs, 3, 1).rows() == []
    assert mutate.index(pairs, "end") == (40, "w")
    with pytest.raises(BadIndex):
        mutate.index(pairs, 4)


def test_delete_ignores_what_is_not_there(pairs):
    assert mutate.delete(pairs, [1, 1, 99]).list("a") == [10, 30, 40]
    assert mutate.delete(pairs, low=1, high="end").list("a") == [10]
    assert mutate.delete(pairs, low=2, high=1).list("a") == [10, 20, 30, 40]


def test_insert_and_inject(spark):
    c = column(spark, [1, 2, 3])
    assert mutate.insert(c, 100, 1, 2).list() == [1, 100, 100, 2, 3]
    assert mutate.insert(c, 9).list() == [1, 2, 3, 9]
    assert mutate.inject(c, [7, 8], 0).list() == [7, 8, 1, 2, 3]
    assert mutate.inject(c, column(spark, [5]), "end").list() == [1, 2, 3, 5]
    with pytest.raises(BadIndex):
        mutate.insert(c, 1, 5)


def test_put_overwrites_and_extends(spark, pairs):
    assert mutate.put(column(spark, [1, 2, 3]), [8, 9], 2).list() == [1, 2, 8, 9]
    assert mutate.put(pairs, [(0,), (5,)], 1, ["a"]).rows() == [(10, "x"), (0, "y"), (5, "z"), (40, "w")]
    with pytest.raises(BadIndex):
        mutate.put(column(spark, [1]), [2], 3)
    with pytest.raises(ShapeMismatch):
        mutate.put(pairs, [(0,)], "end", ["a"])


def test_place_grows_without_gaps_and_the_last_write_stays(spark):
    c = column(spark, [0, 1, 2, 3, 4])
    assert mutate.place(c, [106, 105, 107, 104], [6, 5, 7, 4]).list() == [0, 1, 2, 3, 104, 105, 106, 107]
    assert mutate.place(c, [7, 8, 9], [1, 1, 0]).list() == [9, 8, 2, 3, 4]
    with pytest.raises(BadIndex):
        mutate.place(c, [1, 2], [6, 7])
    with pytest.raises(BadIndex):
        mutate.place(c, [1], [-1])


def test_fill(spark, pairs):
    c = column(spark, [1, 2, 3])
    assert mutate.fill(c, 0, [2, 0]).list() == [0, 2, 0]
    assert mutate.fill(c, 0, low=2, high=4).list() == [1, 2, 0, 0, 0]
    assert mutate.fill(pairs, "!", F.col("a") > 20, columns=["b"]).list("b") == ["x", "y", "!", "!"]
    with pytest.raises(BadIndex):
        mutate.fill(c, 0, [4])


def test_a_reference_changes_and_the_frame_does_not(spark):
    c = column(spark, [1, 2, 3])
    ref = Ref(c)
    ref.change(mutate.delete, [0])
    ref.change(sort.reverse)
    assert (ref.frame.list(), c.list()) == ([3, 2], [1, 2, 3])


def test_sorts_are_stable_in_both_directions(spark):
    t = Frame.create(spark, [("k", "string"), ("n", "int")], [("b", 0), ("a", 1), ("b", 2), ("A", 3), ("a", 4)])
    assert sort.sort(t, "k").list("n") == [3, 1, 4, 0, 2]
    assert sort.sort(t, "k", decreasing=True).list("n") == [0, 2, 1, 4, 3]
    assert sort.sort(t, "k", nocase=True).list("n") == [1, 3, 4, 0, 2]
    assert [r["value"] for r in sort.sort_positions(t, "k").orderBy("pos").collect()] == [3, 1, 4, 0, 2]
    assert sort.top_k(t, 2, "n").list("n") == [4, 3]
    assert sort.head(t, 2).list("n") == [0, 1]
    assert sort.tail(t, 2).list("n") == [2 + 1, 4]
    assert sort.reverse(t).list("n") == [4, 3, 2, 1, 0]
    assert sorted(sort.shuffle(t, 3).list("n")) == [0, 1, 2, 3, 4]


def test_indirect_passes_are_one_sort(spark):
    people = Frame.create(spark, [("name", "string"), ("h", "int"), ("w", "int")], [("Ada", 180, 90), ("Bo", 170, 70), ("Cy", 170, 90)])
    got = sort.sort_indirect(people, [0, 1, 2], ["h", "w"]).orderBy("pos").collect()
    assert [r["value"] for r in got] == [1, 2, 0]


def test_selecting_keeps_the_order(pairs):
    assert search.select(pairs, F.col("a") != 20).rows() == [(10, "x"), (30, "z"), (40, "w")]


@pytest.mark.parametrize(("a", "b", "loose", "strict"), [
    (("int", [1, 2]), ("wide", [1, 2]), True, False), (("int", [1, 2]), ("int", [2, 1]), False, False),
    (("int", [16]), ("string", ["0x10"]), False, False), (("int", []), ("int", []), True, True), (("int", [1]), ("int", [1, 1]), False, False),
])
def test_equality(spark, a, b, loose, strict):
    x, y = column(spark, a[1], a[0]), column(spark, b[1], b[0])
    assert search.equality(x, y).first()["equal"] is loose
    assert search.equality(x, y, strict=True).first()["equal"] is strict


def test_casts(spark):
    assert vector.cast(column(spark, [1, 257, -1]), 0, "byte").list() == [1, 1, 255]
    assert vector.cast(column(spark, [-1]), 0, "uint").list() == [2**32 - 1]
    assert vector.cast(column(spark, [2**31, 2**32 - 1], "uint"), 0, "int").list() == [-(2**31), -1]
    assert vector.cast(column(spark, [2.9, -2.9], "double"), 0, "int").list() == [2, -2]
    with pytest.raises(PySparkException):
        vector.cast(column(spark, [2.5], "double"), 0, "int", strict=True).list()
    with pytest.raises(PySparkException):
        vector.cast(column(spark, [300]), 0, "byte", strict=True).list()


def test_vectors_of_two_columns(spark):
    assert vector.elementwise(column(spark, [7, -7]), column(spark, [2, 2]), "/").list() == [3, -4]
    with pytest.raises(ShapeMismatch):
        vector.elementwise(column(spark, [1]), column(spark, [1, 2]), "+")
    with pytest.raises(TypeMismatch):
        vector.elementwise(column(spark, ["1"], "string"), column(spark, [1]), "+")
