"""Frames: a DataFrame and its declared row order. Positions are made only when an operation addresses rows by number."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadIndex, BadName, ShapeMismatch
from ..functions import types as L
from .scratch import stored

POS = "pos"
#: Frames of at most so many rows (counted, and estimated below so many bytes) are numbered by one window; larger ones by
#: counts of sorted partitions.
ONE_WINDOW_ROWS, ONE_WINDOW_BYTES = 500_000, 8 << 20
#: Rows whose positions are found by counting what comes before each, in one pass and without a sort.
FEW_ROWS = 1000
_NAME = re.compile(r"[^\W\d][-\w]*\Z")
_AT = "_rl_at"


def number(df: DataFrame, keys: Sequence[Column | str], name: str = POS, distributed: bool | None = None) -> DataFrame:
    """``df`` with 0-based positions by ``keys``, which should be unique.

    A frame counted to be small gets them from one window. Any other is sorted over all executors and written to the shared folder with each row's
    partition and place in it; the driver gets one count per partition, and a position is the
    partition's offset and the place. No task sees more than its partition.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    if distributed is None:
        distributed = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > ONE_WINDOW_BYTES or df.select(F.lit(1)).limit(ONE_WINDOW_ROWS + 1).count() > ONE_WINDOW_ROWS
    if not distributed:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long") - 1)
    held = stored(df.orderBy(*keys).withColumn(_AT, F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(_AT, 33)
    counts = {r["p"]: r["count"] for r in held.groupBy(part.alias("p")).count().collect()}  # a row for each partition
    offsets, before = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(p, 0)
    start = F.element_at(F.lit(offsets or [0]).cast("array<bigint>"), part.cast("int") + 1)
    return held.withColumn(name, start + F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1))).drop(_AT)


def ranks(frame: Frame, firsts: DataFrame, few: bool = False) -> DataFrame:
    """``firsts`` with ``pos``: the positions in the frame of rows given by ``at``, the struct of their order columns.

    Up to ``FEW_ROWS`` of them are sent to the scan as one sorted array, which counts how many rows stand
    before each: one pass without a sort. For more, the whole frame is numbered. ``few`` says that they are
    known to be few.
    """
    order = F.struct(*(F.col(o) for o in frame.order))
    if not few and firsts.limit(FEW_ROWS + 1).count() > FEW_ROWS:
        rows = frame.numbered().select(order.alias("at"), F.col(POS))
        return firsts.join(rows, "at")
    sorted_firsts = firsts.select(F.sort_array(F.collect_set("at")).alias("all")).scalar()
    rows = frame.df.select(order.alias("_rl_own"), sorted_firsts.alias("_rl_all"))
    reached = F.size(F.filter("_rl_all", lambda x: x <= F.col("_rl_own")))  # of the firsts, those not after the row
    by_place = rows.groupBy(reached.alias("place")).agg(F.count(F.lit(1)).alias("n"))  # a row for each first at most
    # the rows that reach i firsts or fewer are those before first number i
    before = by_place.select("place", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("place")).alias("before"))
    numbered = firsts.withColumn("_rl_all", sorted_firsts).withColumn("place", F.size(F.filter("_rl_all", lambda x: x < F.col("at"))))
    # only the very first row of the frame has none before it; every other first follows one that reaches its number
    return numbered.join(F.broadcast(before), "place", "left").select(*firsts.columns, F.coalesce("before", F.lit(0)).alias(POS))


class Frame:
    """A table whose rows have the order of ``order``; the result of an operation that numbers rows is in order of ``pos``."""

    def __init__(self, df: DataFrame, order: Sequence[str] = (POS,)):
        missing = [c for c in order if c not in df.columns]
        if missing:
            raise BadName(f"no column {missing[0]} to order by")
        self.df, self.order = df, tuple(order)

    @classmethod
    def create(cls, spark: SparkSession, definition: Sequence[tuple[str, str]], rows: Sequence[Sequence] = ()) -> Frame:
        """A literal table: (name, logical type) pairs and rows in order."""
        names = [n for n, _ in definition]
        if len(set(names)) < len(names):
            raise BadName("a column name is there twice")
        for n in names:
            if not _NAME.match(n):
                raise BadName(f"{n!r} can't name a column")
        data = []
        for i, r in enumerate(rows):
            if len(r) != len(names):
                raise ShapeMismatch(f"row {i} has {len(r)} values, not {len(names)}")
            data.append((i, *(L.checked(v, t) for v, (_, t) in zip(r, definition, strict=True))))
        schema = T.StructType([T.StructField(POS, T.LongType(), False), *(T.StructField(n, L.SPARK[t], True, {"ltype": t}) for n, t in definition)])
        return cls(spark.createDataFrame(data, schema))

    @classmethod
    def column(cls, spark: SparkSession, ltype: str, values: Sequence = (), name: str = "value") -> Frame:
        """A literal column."""
        return cls.create(spark, [(name, ltype)], [(v,) for v in values])

    @classmethod
    def zip(cls, names: Sequence[str], columns: Sequence[Frame]) -> Frame:
        """A table of equally long one-column frames."""
        if len(names) != len(columns) or not names:
            raise ShapeMismatch("as many names as columns are needed")
        if len(set(names)) < len(names):
            raise BadName("a column name is there twice")
        if len({c.size() for c in columns}) > 1:
            raise ShapeMismatch("columns of different lengths")
        out = None
        for n, c in zip(names, columns, strict=True):
            if not _NAME.match(n):
                raise BadName(f"{n!r} can't name a column")
            own = c.numbered().select(POS, F.col(c.names[0]).alias(n, metadata={"ltype": c.type(c.names[0])}))
            out = own if out is None else out.join(own, POS)
        return cls(out)

    @property
    def names(self) -> list[str]:
        """Names of the value columns; ``pos`` is not one of them."""
        return [c for c in self.df.columns if c != POS]

    @property
    def values(self) -> DataFrame:
        """The rows without positions, in no promised order."""
        return self.df.drop(POS)

    def name(self, spec: str | int) -> str:
        """A column's name from its name or place."""
        if isinstance(spec, int):
            if not 0 <= spec < len(self.names):
                raise BadName(f"no column {spec}")
            return self.names[spec]
        if spec not in self.names:
            raise BadName(f"no column {spec}")
        return spec

    def type(self, spec: str | int = 0) -> str:
        return L.of(self.df, self.name(spec))

    def definition(self, specs: Sequence[str | int] | None = None) -> list[tuple[str, str]]:
        return [(self.name(s), self.type(s)) for s in (self.names if specs is None else specs)]

    @property
    def width(self) -> int:
        return len(self.names)

    def size(self) -> int:
        return self.df.count()

    def numbered(self) -> DataFrame:
        """The rows with contiguous positions from 0."""
        return self.df if self.order == (POS,) else number(self.df.drop(POS) if POS in self.df.columns else self.df, self.order)

    def with_positions(self) -> Frame:
        return Frame(self.numbered())

    def slice(self, specs: Sequence[str | int]) -> Frame:
        """The named columns in the order given; the order of rows stays."""
        names = [self.name(s) for s in specs]
        if len(set(names)) < len(names):
            raise BadName("a column is there twice")
        if set(self.order) <= set(names):
            return Frame(self.df.select(*names), self.order)
        return Frame(self.numbered().select(POS, *names))

    def columns(self, specs: Sequence[str | int] | None = None) -> list[Frame]:
        return [self.slice([s]) for s in (self.names if specs is None else specs)]

    def with_column(self, spec: str | int, new: Frame) -> Frame:
        """The table with one column's values replaced by a column of the same type and length."""
        name = self.name(spec)
        if new.type() != self.type(name):
            raise ShapeMismatch(f"{name} is {self.type(name)}, not {new.type()}")
        if new.size() != self.size():
            raise ShapeMismatch("a column of another length")
        theirs = new.numbered().select(POS, F.col(new.names[0]).alias("_rl_new"))
        rows = self.numbered().join(theirs, POS)
        return Frame(rows.select(POS, *(F.col("_rl_new").alias(n, metadata={"ltype": self.type(n)}) if n == name else F.col(n) for n in self.names)))

    def rows(self) -> list[tuple]:
        """All rows in order, on the driver."""
        return [tuple(r) for r in self.df.orderBy(*self.order).select(*self.names).collect()]

    def list(self, spec: str | int = 0) -> list:
        """One column's values in order, on the driver."""
        return [r[0] for r in self.df.orderBy(*self.order).select(self.name(spec)).collect()]

    def loop(self):
        """Rows in order, a partition at a time."""
        for r in self.df.orderBy(*self.order).select(*self.names).toLocalIterator():
            yield tuple(r)


class Ref:
    """A variable that holds a frame: ``ref.change(delete, [1, 2])`` puts an operation's result in its place."""

    def __init__(self, frame: Frame):
        self.frame = frame

    def change(self, operation, *args, **kwargs) -> Frame:
        self.frame = operation(self.frame, *args, **kwargs)
        return self.frame


def position(spec: int | str, size: int, insert: bool = False) -> int:
    """A position from a number, ``end``, ``end-N`` or ``end+N``. To insert, ``end`` is one past the last."""
    if isinstance(spec, str):
        m = re.fullmatch(r"end(?:([-+])(\d+))?", spec)
        if not m:
            if re.fullmatch(r"-?\d+", spec):
                return int(spec)
            raise BadIndex(f"{spec!r} is no position")
        shift = int(m[2] or 0) * (-1 if m[1] == "-" else 1)
        return (size if insert else size - 1) + shift
    return int(spec)


def bounds(low: int | str, high: int | str, size: int) -> tuple[int, int]:
    """An inclusive range; a negative low counts as 0, and high below low is an empty range."""
    lo, hi = max(0, position(low, size)), position(high, size)
    return (lo, hi) if hi >= lo else (lo, lo - 1)


def indices(frame: Frame, given: Sequence[int] | Frame | DataFrame | Column) -> DataFrame:
    """(ord, at): positions in the order given. A boolean expression or column stands for the positions of its set rows."""
    spark = frame.df.sparkSession
    if isinstance(given, Column):
        return frame.numbered().where(given).select(F.col(POS).alias("ord"), F.col(POS).alias("at"))
    if isinstance(given, Frame):
        name = given.names[0]
        rows = given.numbered()
        if given.type(name) == "boolean":
            return rows.where(F.col(name)).select(F.col(POS).alias("ord"), F.col(POS).alias("at"))
        return rows.select(F.col(POS).alias("ord"), L.cast(F.col(name), given.type(name), "wide").alias("at"))
    if isinstance(given, DataFrame):
        return given.select("ord", "at")
    if any(isinstance(g, str) for g in given):
        raise BadIndex("end can't be in a list of indices")
    return spark.createDataFrame([(i, int(p)) for i, p in enumerate(given)], "ord long, at long")
