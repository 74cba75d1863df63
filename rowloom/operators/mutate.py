"""Reading and writing rows by position: get, put, place, fill, insert, inject, delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadIndex, BadName, ShapeMismatch
from ..functions import types as L
from ..plans.frame import POS, Frame, bounds, indices, number, position


def _literal(frame: Frame, rows: Sequence[Sequence], columns: Sequence[str]) -> DataFrame:
    """(ord, columns...) of literal rows, or of single values for one column."""
    data = []
    for i, r in enumerate(rows):
        r = r if isinstance(r, (tuple, list)) else (r,)
        if len(r) != len(columns):
            raise ShapeMismatch(f"row {i} has {len(r)} values, not {len(columns)}")
        data.append((i, *(L.checked(v, frame.type(c)) for v, c in zip(r, columns, strict=True))))
    fields = [T.StructField("ord", T.LongType()), *(T.StructField(c, frame.df.schema[c].dataType) for c in columns)]
    return frame.df.sparkSession.createDataFrame(data, T.StructType(fields))


def _given(frame: Frame, rows, columns: Sequence[str]) -> tuple[DataFrame, int]:
    if isinstance(rows, Frame):
        if rows.width != len(columns):
            raise ShapeMismatch(f"rows have {rows.width} values, not {len(columns)}")
        own = rows.numbered()
        return own.select(F.col(POS).alias("ord"), *(F.col(n).cast(frame.df.schema[c].dataType).alias(c) for n, c in zip(rows.names, columns, strict=True))), rows.size()
    return _literal(frame, rows, columns), len(rows)


def _map(frame: Frame, columns: Sequence[str | int] | None) -> list[str]:
    names = frame.names if columns is None else [frame.name(c) for c in columns]
    if len(set(names)) < len(names):
        raise BadName("a column is there twice")
    return names


def _kept_types(frame: Frame, df: DataFrame) -> Frame:
    return Frame(df.select(POS, *(F.col(n).alias(n, metadata=frame.df.schema[n].metadata) for n in frame.names)))


def get(frame: Frame, given, columns: Sequence[str | int] | None = None, check: bool = True) -> Frame:
    """The rows at the given positions, in their order and as often as given. A position outside is an error when it runs."""
    names = _map(frame, columns)
    at = indices(frame, given)
    how = "left" if check and not isinstance(given, Column) else "inner"
    rows = at.join(frame.numbered().select(F.col(POS).alias("_rl_p"), *names), F.col("at") == F.col("_rl_p"), how)
    if how == "left":
        missing = F.raise_error(F.concat(F.lit("no row at position "), F.col("at").cast("string")))
        rows = rows.withColumn("ord", F.when(F.col("_rl_p").isNull(), missing.cast("long")).otherwise(F.col("ord")))
    return Frame(number(rows, ["ord"]).select(POS, *names))


def index(frame: Frame, at: int | str) -> tuple:
    """One row, on the driver."""
    p = position(at, frame.size() if isinstance(at, str) else 0)
    got = frame.numbered().where(F.col(POS) == p).select(*frame.names).take(1)
    if not got:
        raise BadIndex(f"no row at position {at}")
    return tuple(got[0])


def delete(frame: Frame, given=None, low: int | str | None = None, high: int | str | None = None) -> Frame:
    """The frame without the given positions or the range low to high; positions that aren't there are passed over."""
    rows = frame.numbered()
    if given is None:
        size = frame.size() if any(isinstance(x, str) for x in (low, high)) else 0
        lo, hi = bounds(low, high, size)
        out = rows.where(~F.col(POS).between(lo, hi))
        # what follows the range moves up by its length: no row is numbered anew
        moved = F.when(F.col(POS) > hi, F.col(POS) - (hi - lo + 1)).otherwise(F.col(POS))
        return Frame(out.withColumn(POS, moved))
    gone = indices(frame, given).select(F.col("at").alias(POS)).distinct()
    left = rows.join(gone, POS, "left_anti").withColumnRenamed(POS, "_rl_old")
    return _kept_types(frame, number(left, ["_rl_old"]))


def _check_columns(frame: Frame, names: list[str], grows: bool) -> None:
    if grows and set(names) != set(frame.names):
        raise ShapeMismatch("a table grows in all its columns at once")


def put(frame: Frame, rows, first: int | str = "end", columns: Sequence[str | int] | None = None) -> Frame:
    """Rows written from ``first`` on, over what is there and beyond the end without a gap."""
    names = _map(frame, columns)
    new, n = _given(frame, rows, names)
    size = frame.size()
    at = position(first, size, insert=True)
    if not 0 <= at <= size:
        raise BadIndex(f"{first} leaves a gap or is before the first row")
    _check_columns(frame, names, at + n > size)
    old = frame.numbered()
    placed = new.select((F.col("ord") + at).alias(POS), *names)
    if set(names) == set(frame.names):
        out = old.where(~F.col(POS).between(at, at + n - 1)).select(POS, *frame.names).unionByName(placed)
        return _kept_types(frame, out)
    return _overlaid(frame, old, placed, names)


def _overlaid(frame: Frame, old: DataFrame, placed: DataFrame, names: list[str]) -> Frame:
    own = placed.select(F.col(POS).alias("_rl_p"), *(F.col(n).alias(f"_rl_{n}") for n in names))
    both = old.join(own, F.col(POS) == F.col("_rl_p"), "full_outer")
    there = F.col("_rl_p").isNotNull()
    out = both.select(F.coalesce(POS, "_rl_p").alias(POS), *(F.when(there, F.col(f"_rl_{n}")).otherwise(F.col(n)).alias(n) if n in names else F.col(n) for n in frame.names))
    return _kept_types(frame, out)


def place(frame: Frame, rows, given, columns: Sequence[str | int] | None = None) -> Frame:
    """Rows written to the given positions in turn: of writes to one position the last stays. Positions
    beyond the end extend the frame if they leave no gap, and are an error otherwise."""
    names = _map(frame, columns)
    new, n = _given(frame, rows, names)
    at = indices(frame, given)
    size = frame.size()
    seen = at.agg(F.count(F.lit(1)), F.min("at"), F.max("at"), F.countDistinct(F.when(F.col("at") >= size, F.col("at")))).first()
    if seen[0] > n:
        raise ShapeMismatch(f"{seen[0]} positions for {n} rows")
    if seen[0]:
        if seen[1] < 0:
            raise BadIndex(f"no row at position {seen[1]}")
        if seen[2] >= size and seen[3] != seen[2] - size + 1:
            raise BadIndex(f"position {seen[2]} leaves a gap")
        _check_columns(frame, names, seen[2] >= size)
    ranked = number(at, ["ord"], "_rl_n").select("_rl_n", "at")
    writes = new.join(ranked, F.col("ord") == F.col("_rl_n"))
    last = writes.groupBy("at").agg(*(F.max_by(n, "ord").alias(n) for n in names))
    return _overlaid(frame, frame.numbered(), last.select(F.col("at").alias(POS), *names), names)


def fill(frame: Frame, row, given=None, low: int | str | None = None, high: int | str | None = None, columns: Sequence[str | int] | None = None) -> Frame:
    """One row's values written to many positions (a list, a condition, or low to high); growth is without gaps."""
    names = _map(frame, columns)
    values = row if isinstance(row, (tuple, list)) else (row,)
    if len(values) != len(names):
        raise ShapeMismatch(f"{len(values)} values for {len(names)} columns")
    lits = {c: F.lit(L.checked(v, frame.type(c))).cast(frame.df.schema[c].dataType) for v, c in zip(values, names, strict=True)}
    spark = frame.df.sparkSession
    if isinstance(given, Column):
        rows = frame.df
        out = rows.select(*((F.when(given, lits[c]).otherwise(F.col(c)) if c in lits else F.col(c)).alias(c, metadata=rows.schema[c].metadata) for c in rows.columns))
        return Frame(out, frame.order)
    size = frame.size()
    if given is None:
        lo, hi = bounds(low, low if high is None else high, size)
        if lo > size:
            raise BadIndex(f"position {lo} leaves a gap")
        hit, grown = F.col(POS).between(lo, hi), max(size, hi + 1)
        rows = frame.numbered()
    else:
        at = indices(frame, given).select(F.col("at").alias("_rl_p")).distinct()
        seen = at.agg(F.min("_rl_p"), F.max("_rl_p"), F.count_if(F.col("_rl_p") >= size)).first()
        if seen[0] is not None and (seen[0] < 0 or seen[1] >= size and seen[2] != seen[1] - size + 1):
            raise BadIndex("a position leaves a gap or is before the first row")
        grown = max(size, (seen[1] if seen[1] is not None else -1) + 1)
        rows = frame.numbered().join(at, F.col(POS) == F.col("_rl_p"), "left")
        hit = F.col("_rl_p").isNotNull()
    _check_columns(frame, names, grown > size)
    out = rows.select(POS, *((F.when(hit, lits[c]).otherwise(F.col(c)) if c in lits else F.col(c)).alias(c) for c in frame.names))
    if grown > size:
        out = out.unionByName(spark.range(size, grown).select(F.col("id").alias(POS), *(lits[c].alias(c) for c in frame.names)))
    return _kept_types(frame, out)


def inject(frame: Frame, rows, first: int | str = "end", columns: Sequence[str | int] | None = None) -> Frame:
    """Rows inserted before ``first``; what follows moves down by their number."""
    names = _map(frame, columns)
    _check_columns(frame, names, True)
    new, n = _given(frame, rows, names)
    at = position(first, frame.size(), insert=True) if isinstance(first, str) else first
    old = frame.numbered()
    if at < 0 or not isinstance(first, str) and at > frame.size():
        raise BadIndex(f"{first} leaves a gap or is before the first row")
    moved = old.withColumn(POS, F.when(F.col(POS) >= at, F.col(POS) + n).otherwise(F.col(POS)))
    return _kept_types(frame, moved.select(POS, *frame.names).unionByName(new.select((F.col("ord") + at).alias(POS), *names)))


def insert(frame: Frame, row, first: int | str = "end", count: int = 1, columns: Sequence[str | int] | None = None) -> Frame:
    """One row inserted ``count`` times before ``first``."""
    names = _map(frame, columns)
    _check_columns(frame, names, True)
    if count < 0:
        raise BadIndex("a negative count")
    values = row if isinstance(row, (tuple, list)) else (row,)
    if len(values) != len(names):
        raise ShapeMismatch(f"{len(values)} values for {len(names)} columns")
    size = frame.size()
    at = position(first, size, insert=True)
    if not 0 <= at <= size:
        raise BadIndex(f"{first} leaves a gap or is before the first row")
    lits = [F.lit(L.checked(v, frame.type(c))).cast(frame.df.schema[c].dataType).alias(c) for v, c in zip(values, names, strict=True)]
    new = frame.df.sparkSession.range(count).select((F.col("id") + at).alias(POS), *lits)
    moved = frame.numbered().withColumn(POS, F.when(F.col(POS) >= at, F.col(POS) + count).otherwise(F.col(POS)))
    return _kept_types(frame, moved.select(POS, *frame.names).unionByName(new))
