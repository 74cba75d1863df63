"""Searching columns: first match, all positions, bitmaps, matching values, counts and key lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadValue, TypeMismatch
from ..functions import types as L
from ..functions.predicates import predicate
from ..plans.frame import POS, Frame, bounds, indices, number, ranks


def matches(frame: Frame, value: object, column: str | int = 0, oper: str = "eq", nocase: bool = False, negate: bool = False) -> Column:
    """The predicate of a search as an expression over the frame's columns."""
    name = frame.name(column)
    return predicate(F.col(name), frame.type(name), value, oper, nocase, negate)


def _ranged(frame: Frame, rows: DataFrame, span: Sequence | None) -> DataFrame:
    if span is None:
        return rows
    low, high = span if len(span) == 2 else (span[0], "end")
    size = frame.size() if any(isinstance(x, str) and x.startswith("end") for x in (low, high)) and high != "end" else None
    if high == "end" and not isinstance(low, str):
        return rows.where(F.col(POS) >= max(0, low))
    lo, hi = bounds(low, high, size or 0)
    return rows.where(F.col(POS).between(lo, hi))


def search(frame: Frame, value: object, column: str | int = 0, oper: str = "eq", *, all: bool = False, inline: bool = False, bitmap: bool = False, negate: bool = False, nocase: bool = False, span: Sequence | None = None, among=None) -> DataFrame:
    """Rows whose column matches.

    By default (found): the first position, or -1. ``all``: (pos), every position in order.
    ``inline``: the first value, or with ``all`` (pos, value). ``bitmap``: (pos, found) for every row
    of the frame. ``span`` restricts positions; ``among`` looks at the given positions only, in their
    order and as often as given, and gives (ord, pos) with ``all``; positions outside are passed over.
    """
    if bitmap and inline:
        raise BadValue("bitmap and inline exclude each other")
    name = frame.name(column)
    hit = matches(frame, value, name, oper, nocase, negate)
    if inline and all and span is None and among is None:
        return frame.df.where(hit).select(*dict.fromkeys([*frame.order, name])) if frame.order != (POS,) else frame.df.where(hit).select(POS, name)
    if not (all or bitmap) and span is None and among is None:
        return _first(frame, hit, name if inline else None)
    rows = frame.numbered()
    if bitmap:
        inside = _ranged(frame, rows, span).select(POS, hit.alias("found"))
        if among is not None:
            inside = inside.join(indices(frame, among).select(F.col("at").alias(POS)).distinct(), POS, "left_semi")
        if span is None and among is None:
            return inside
        return rows.select(POS).join(inside, POS, "left").select(POS, F.coalesce("found", F.lit(False)).alias("found"))
    found = _ranged(frame, rows, span).where(hit)
    order = [POS]
    if among is not None:
        found = indices(frame, among).join(found, F.col("at") == F.col(POS)).drop("at")
        order = ["ord"]
    if all:
        return found.select(*dict.fromkeys([*order, POS]), *([name] if inline else []))
    first = F.min_by(name if inline else POS, order[0])
    return found.agg(first.alias(name)) if inline else found.agg(F.coalesce(first, F.lit(-1)).cast("long").alias("found"))


def _first(frame: Frame, hit: Column, inline: str | None) -> DataFrame:
    """The first hit's value, or its position: the number of rows before it in the frame's order. Nothing is sorted."""
    order = F.struct(*(F.col(o) for o in frame.order))
    if inline:
        return frame.df.where(hit).agg(F.min_by(inline, order).alias(inline))
    if frame.order == (POS,):
        return frame.df.where(hit).agg(F.coalesce(F.min(POS), F.lit(-1)).cast("long").alias("found"))
    least = frame.df.where(hit).agg(F.min(order).alias("least")).scalar()
    rows = frame.df.select((order < least).alias("before"))
    return rows.agg(F.count_if("before").alias("n"), F.count("before").alias("known")).select(F.when(F.col("known") > 0, F.col("n")).otherwise(-1).cast("long").alias("found"))


def count(frame: Frame, value: object, column: str | int = 0, oper: str = "eq", *, negate: bool = False, nocase: bool = False, span: Sequence | None = None, among=None) -> DataFrame:
    """(n): how many rows match; a position given twice in ``among`` counts twice."""
    hit = matches(frame, value, column, oper, nocase, negate)
    if span is None and among is None:
        return frame.df.agg(F.count_if(hit).alias("n"))
    got = search(frame, value, column, oper, all=True, negate=negate, nocase=nocase, span=span, among=among)
    return got.agg(F.count(F.lit(1)).alias("n"))


def bits_set(frame: Frame, column: str | int = 0) -> DataFrame:
    """(n): how many booleans are true."""
    name = frame.name(column)
    if frame.type(name) != "boolean":
        raise TypeMismatch("only booleans have bits to count")
    return frame.df.agg(F.count_if(F.col(name)).alias("n"))


def lookup(frame: Frame, keys: Sequence[str] | DataFrame, column: str | int = 0) -> DataFrame:
    """(key, found): the lowest position of each key in a text column, -1 where absent."""
    name = frame.name(column)
    if frame.type(name) not in ("string", "any"):
        raise TypeMismatch("lookup is for text columns")
    asked = keys if isinstance(keys, DataFrame) else frame.df.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    own = frame.df.join(asked.select(F.col("key").alias(name)).distinct(), name, "left_semi")
    where = first_rows(frame, own, F.col(name).alias("key")).select("key", F.col(POS).alias("found"))
    return asked.join(where, "key", "left").select("key", F.coalesce("found", F.lit(-1)).cast("long").alias("found"))


def first_rows(frame: Frame, rows: DataFrame, by: Column) -> DataFrame:
    """The groups of some of the frame's rows, with ``pos``, the position in the frame of the first row of each."""
    if frame.order == (POS,):
        return rows.groupBy(by).agg(F.min(POS).alias(POS))
    firsts = rows.groupBy(by).agg(F.min(F.struct(*(F.col(o) for o in frame.order))).alias("at"))
    return ranks(frame, firsts).drop("at")


def select(frame: Frame, condition: Column) -> Frame:
    """The rows that a condition selects, in order."""
    rows = frame.df.where(condition)
    if frame.order != (POS,):
        return Frame(rows, frame.order)
    return Frame(number(rows.withColumnRenamed(POS, "_rl_old"), ["_rl_old"]).drop("_rl_old"))


def equality(a: Frame, b: Frame, strict: bool = False) -> DataFrame:
    """(equal): whether two tables hold the same values row by row; ``strict`` asks for the same types and names too."""
    spark = a.df.sparkSession
    same_shape = a.width == b.width and (not strict or a.definition() == b.definition())
    if not same_shape:
        return spark.range(1).select(F.lit(False).alias("equal"))
    left = a.numbered().select(POS, *(F.col(n).alias(f"a{i}") for i, n in enumerate(a.names)))
    right = b.numbered().select(POS, *(F.col(n).alias(f"b{i}") for i, n in enumerate(b.names)))
    same = F.lit(True)
    for i, (x, y) in enumerate(zip(a.names, b.names, strict=True)):
        s, t = a.type(x), b.type(y)
        u, v = F.col(f"a{i}"), F.col(f"b{i}")
        if {s, t} & {"string", "any"}:
            u, v = L.as_text(u, s), L.as_text(v, t)
        elif "double" in (s, t):
            u, v = L.cast(u, s, "double"), L.cast(v, t, "double")
        else:
            u, v = L.as_long(u, s), L.as_long(v, t)
        same = same & u.eqNullSafe(v)
    pairs = left.withColumn("_rl_a", F.lit(True)).join(right.withColumn("_rl_b", F.lit(True)), POS, "full_outer")
    whole = F.col("_rl_a").isNotNull() & F.col("_rl_b").isNotNull()
    return pairs.agg(F.coalesce(F.bool_and(whole & same), F.lit(True)).alias("equal"))
