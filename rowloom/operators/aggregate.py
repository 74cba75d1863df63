"""Sums, extremes, histograms, categories and their summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadValue, TypeMismatch
from ..functions import types as L
from ..plans.frame import POS, Frame, ranks
from .search import first_rows


def summed(c: Column, ltype: str) -> Column:
    """The sum as BIGINT that wraps around, or DOUBLE; 0 for no rows. ``wide`` is summed exactly in a decimal."""
    if ltype not in ("byte", "int", "uint", "wide", "double"):
        raise TypeMismatch(f"{ltype} has no sum")
    if ltype == "double":
        return F.coalesce(F.sum(c), F.lit(0.0))
    if ltype == "wide":
        return F.coalesce(L.wrapped64(F.sum(c.cast("decimal(19,0)")).cast("decimal(38,0)")), F.lit(0).cast("long"))
    return F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))


def sum(frame: Frame, column: str | int = 0) -> DataFrame:  # noqa: A001
    """(sum) of a column."""
    name = frame.name(column)
    return frame.df.agg(summed(F.col(name), frame.type(name)).alias("sum"))


def fold(frame: Frame, op: str, column: str | int = 0) -> DataFrame:
    if op != "+":
        raise BadValue("only + folds a column")
    return sum(frame, column)


def minmax(frame: Frame, column: str | int = 0, *, positions: bool = False, nocase: bool = False, span: tuple[int, int] | None = None) -> DataFrame:
    """(min, max) of a column, or the lowest positions of both. No rows: an error when it runs."""
    name = frame.name(column)
    key = F.lower(name) if nocase and frame.type(name) in ("string", "any") else F.col(name)
    rows = frame.df
    if span is not None:
        rows = frame.numbered().where(F.col(POS).between(max(0, span[0]), span[1]))
        frame = Frame(rows)
    order = F.struct(*(F.col(o) for o in frame.order))
    low, high, kept = F.min(name), F.max(name), rows
    if positions or nocase:  # the first row, by the frame's order, of the least and of the greatest key
        ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        least, greatest = (ends.select(c).scalar() for c in ("lo", "hi"))
        ordinal = F.col(POS) if frame.order == (POS,) else order
        pick = (lambda end: F.min(F.when(key == end, ordinal))) if positions else (lambda end: F.min_by(name, F.when(key == end, order)))
        low, high = pick(least), pick(greatest)
        kept = rows.where((key == least) | (key == greatest))
        if positions and frame.order != (POS,):
            two = kept.agg(low.alias("min"), high.alias("max"), F.count(F.lit(1)).alias("n"))
            at = ranks(frame, two.select(F.explode(F.array("min", "max")).alias("at")).where("at is not null").distinct(), few=True)
            kept = at
            # which of both is the first of the least key is known from the rows themselves
            first = two.select((F.col("min") <= F.col("max")).alias("f")).scalar()
            low, high = F.when(first, F.min(POS)).otherwise(F.max(POS)), F.when(first, F.max(POS)).otherwise(F.min(POS))
    none = F.raise_error(F.lit("min and max of no rows"))
    n = F.count(F.lit(1))
    kind = "long" if positions else dict(frame.df.dtypes)[name]
    return kept.agg(low.alias("min"), high.alias("max"), n.alias("n")).select(*(F.when(F.col("n") == 0, none.cast(kind)).otherwise(F.col(c)).alias(c) for c in ("min", "max")))


@dataclass(frozen=True)
class Buckets:
    """Equal intervals from ``low``: ``n`` of width ``step``; values from ``last`` on go into the last."""

    low: float | int
    step: float | int
    n: int
    high: float | int

    @classmethod
    def of(cls, ltype: str, low, high, n: int) -> Buckets:
        if n <= 0:
            raise BadValue("a histogram needs at least one bucket")
        if low > high:
            raise BadValue("the lower bound is above the upper")
        if ltype != "double":
            return cls(int(low), max(1, (int(high) - int(low) + n - 1) // n), n, int(high))
        step = (high - low) / n
        if step <= 0:
            step = 1.0
        while low + n * step < high:  # rounding must not leave the greatest value out
            step = step * (1 + 2**-52) if step * (1 + 2**-52) > step else step * 2
        return cls(float(low), step, n, float(high))

    def place(self, c: Column) -> Column:
        if self.n == 1:
            return F.lit(0).cast("long")
        last = self.low + (self.n - 1) * self.step
        inside = F.floor((c - F.lit(self.low)) / F.lit(self.step)) if isinstance(self.step, float) else F.call_function("div", c.cast("long") - F.lit(self.low), F.lit(self.step).cast("long"))
        return F.when(c >= F.lit(last), self.n - 1).otherwise(F.least(inside, F.lit(self.n - 1))).cast("long")


def histogram(frame: Frame, n: int, column: str | int = 0, *, compute: str = "count", low=None, high=None, names: tuple[str, str] = ("LowerBound", "Data")) -> DataFrame:
    """(bucket, LowerBound, Data): every bucket, empty ones too. ``compute``: count, sum, values or positions.

    Values outside the bounds are left out, and the greatest go into the last bucket. Without bounds
    one pass finds the least and greatest value (an error for no rows).
    """
    name = frame.name(column)
    t = frame.type(name)
    L.numeric(t)
    spark = frame.df.sparkSession
    if t == "boolean":
        if n != 2:
            raise BadValue("booleans have two buckets")
        rows = frame.df.select(*frame.df.columns, L.as_long(F.col(name), t).alias("_rl_v"))
        buckets, kind = Buckets(0, 1, 2, 1), "long"
    else:
        if low is None or high is None:
            got = frame.df.agg(F.min(name), F.max(name)).first()
            if got[0] is None:
                raise BadValue("a histogram of no rows needs bounds")
            low, high = (got[0] if low is None else low), (got[1] if high is None else high)
        buckets = Buckets.of(t, low, high, n)
        rows = frame.df.where(F.col(name).between(F.lit(low), F.lit(high))).withColumn("_rl_v", F.col(name))
        kind = "double" if t == "double" else "long"
    if compute == "positions":
        rows = Frame(rows, frame.order).numbered() if t == "boolean" else frame.numbered().where(F.col(name).between(F.lit(buckets.low), F.lit(buckets.high))).withColumn("_rl_v", F.col(name))
    order = F.struct(*(F.col(o) for o in frame.order), F.col(name))
    sums = {
        "count": lambda: (F.count(F.lit(1)), F.lit(0).cast("long")),
        "sum": lambda: (summed(F.col("_rl_v"), "wide" if t == "boolean" else t), F.lit(0.0) if t == "double" else F.lit(0).cast("long")),
        "values": lambda: (F.transform(F.sort_array(F.collect_list(order)), lambda s: s[name]), F.array().cast(f"array<{dict(frame.df.dtypes)[name]}>")),
        "positions": lambda: (F.sort_array(F.collect_list(POS)), F.array().cast("array<bigint>")),
    }
    if compute not in sums:
        raise BadValue(f"can't compute {compute}")
    agg, nothing = sums[compute]()
    data = rows.groupBy(buckets.place(F.col("_rl_v")).alias("bucket")).agg(agg.alias(names[1]))
    lower = (F.lit(buckets.low) + F.col("bucket") * F.lit(buckets.step)).cast(kind).alias(names[0])
    few = F.broadcast(data) if compute in ("count", "sum") else data  # a number for each bucket; arrays hold whole columns
    return spark.range(n).withColumnRenamed("id", "bucket").join(few, "bucket", "left").select("bucket", lower, F.coalesce(F.col(names[1]), nothing).alias(names[1]))


def categorize(frame: Frame, column: str | int = 0, *, by: Column | None = None, positions: bool = False, stop: Column | None = None, skip: Column | None = None, names: tuple[str, str] = ("Category", "Data")) -> DataFrame:
    """(first, Category, Data): the values (or positions) of each category as an array in row order.

    ``by`` is the category of a row (default: its value); rows where ``skip`` holds are left out, and
    with ``stop`` everything from the first row where it holds. ``first`` is the lowest position of a
    category, which gives the categories' order. The arrays hold what a group holds: to summarise
    groups use ``summarize_by``, which builds none.
    """
    name = frame.name(column)
    rows = frame.numbered()
    if stop is not None:
        at = rows.where(stop).agg(F.min(POS).alias("_rl_stop"))
        rows = rows.join(F.broadcast(at), F.col("_rl_stop").isNull() | (F.col(POS) < F.col("_rl_stop"))).drop("_rl_stop")
    if skip is not None:
        rows = rows.where(~skip)
    keyed = rows.select(POS, F.col(name).alias("_rl_v"), (F.col(name) if by is None else by).alias(names[0]))
    data = F.sort_array(F.collect_list(POS)) if positions else F.transform(F.sort_array(F.collect_list(F.struct(POS, "_rl_v"))), lambda s: s["_rl_v"])
    return keyed.groupBy(names[0]).agg(F.min(POS).alias("first"), data.alias(names[1])).select("first", *names)


class Skip(Exception):  # noqa: N818
    """Raised by a categorizer to leave a row out."""


class Stop(Exception):  # noqa: N818
    """Raised by a categorizer to end with the row before."""


def categorize_with(frame: Frame, categorizer: Callable[[int, object], object], column: str | int = 0, *, ltype: str = "any", positions: bool = False, names: tuple[str, str] = ("Category", "Data")) -> DataFrame:
    """``categorize`` by a Python function of a row's position and value, which gives the category.

    It may raise ``Skip`` to leave the row out, or ``Stop`` to end: rows from the first such position on are left
    out. It runs on the executors in Arrow batches and in no order, so it must not keep state. Where an
    expression can say the category, ``categorize`` is faster. ``ltype`` is the category's type.
    """
    name = frame.name(column)
    of = T.StructType([T.StructField("category", L.SPARK[ltype]), T.StructField("state", T.IntegerType())])

    @F.pandas_udf(of)
    def judged(pos: pd.Series, value: pd.Series) -> pd.DataFrame:
        out = []
        for p, v in zip(pos.tolist(), value.tolist(), strict=True):
            try:
                got = categorizer(p, v)
                out.append((str(got) if ltype in ("string", "any") else got, 0))
            except Skip:
                out.append((None, 1))
            except Stop:
                out.append((None, 2))
        return pd.DataFrame(out, columns=["category", "state"])

    rows = frame.numbered().select(POS, name).withColumn("_rl_j", judged(F.col(POS), F.col(name))).select(POS, name, F.col("_rl_j.category").alias(names[0]), F.col("_rl_j.state").alias("_rl_state"))
    held = Frame(rows)
    return categorize(held, name, by=F.col(names[0]), positions=positions, stop=F.col("_rl_state") == 2, skip=F.col("_rl_state") == 1, names=names)


def summarize(frame_or_df: Frame | DataFrame, data: str = "Data", *, compute: str | Callable = "count", ltype: str = "wide", name: str = "Summary") -> DataFrame:
    """A table of nested columns with ``name`` in the place of ``data``: the size, the sum, or what a
    function makes of the array (an expression over the array column)."""
    df = frame_or_df.df if isinstance(frame_or_df, Frame) else frame_or_df
    c = F.col(data)
    if compute == "count":
        out = F.size(c)
    elif compute == "sum":
        zero = F.lit(0.0) if ltype == "double" else F.lit(0).cast("decimal(38,0)")
        out = F.aggregate(c, zero, lambda s, x: s + (x.cast("double") if ltype == "double" else x.cast("decimal(19,0)")).cast("double" if ltype == "double" else "decimal(38,0)") if ltype == "double" else (s + x.cast("decimal(19,0)")).cast("decimal(38,0)"))
        out = out if ltype == "double" else L.wrapped64(out)
    else:
        out = compute(c)
    return df.select(*(out.alias(name) if n == data else F.col(n) for n in df.columns))


def summarize_by(frame: Frame, label: Column | str, column: str | int, compute: str | Callable = "count", names: tuple[str, str] = ("Category", "Summary")) -> DataFrame:
    """(Category, Summary): grouping and summarising in one aggregation, merged before the shuffle.

    ``compute`` is count, sum, or a function from the column to an aggregate expression, which may
    be a grouped pandas UDF.
    """
    name = frame.name(column)
    agg = {"count": lambda: F.count(F.lit(1)), "sum": lambda: summed(F.col(name), frame.type(name))}
    out = agg[compute]() if isinstance(compute, str) else compute(F.col(name))
    return frame.df.groupBy((F.col(label) if isinstance(label, str) else label).alias(names[0])).agg(out.alias(names[1]))


def distinct(frame: Frame, column: str | int = 0) -> DataFrame:
    """(first, value): each value once, with its lowest position."""
    return first_rows(frame, frame.df, F.col(frame.name(column)).alias("value")).select(F.col(POS).alias("first"), "value")


def ranked_categories(df: DataFrame) -> DataFrame:
    """``categorize``'s rows with ``pos`` from 0 in their order; there are as many rows as categories."""
    return df.withColumn(POS, F.row_number().over(Window.orderBy("first")).cast("long") - 1)
