"""The inner equi-join of two tables on one pair of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadName, TypeMismatch
from ..plans.frame import Frame, number


def join_columns(t0: Frame, t1: Frame, on: Sequence[str | int] | str | None) -> tuple[str, str]:
    """The pair of columns to join on: as given, one name for both, or the first name that both have."""
    if on is None:
        both = [n for n in t0.names if n in t1.names]
        if not both:
            raise BadName("the tables have no column name in common")
        return both[0], both[0]
    pair = [on] if isinstance(on, (str, int)) else list(on)
    return t0.name(pair[0]), t1.name(pair[-1])


def join(t0: Frame, t1: Frame, on: Sequence[str | int] | str | None = None, *, nocase: bool = False, t0cols: Sequence[str | int] | None = None, t1cols: Sequence[str | int] | None = None, suffix: str = "_t1", ordered: bool = False) -> DataFrame:
    """The rows of both tables whose keys are equal; names that clash get the suffix on the right side.

    Spark chooses the strategy by the sizes it finds. NaN keys match nothing. With ``ordered`` the
    result has ``pos`` by key, then left order, then right order.
    """
    a, b = join_columns(t0, t1, on)
    t = t0.type(a)
    if t != t1.type(b):
        raise TypeMismatch(f"{a} is {t}, {b} is {t1.type(b)}")
    if t == "boolean":
        raise TypeMismatch("booleans can't be join keys")
    left_names = t0.names if t0cols is None else [t0.name(c) for c in t0cols]
    right_names = t1.names if t1cols is None else [t1.name(c) for c in t1cols]
    fold = (lambda c: F.lower(c)) if nocase and t in ("string", "any") else (lambda c: c)
    left = t0.df.select(*(F.col(n).alias(f"l_{i}") for i, n in enumerate(left_names)), fold(F.col(a)).alias("_rl_k0"), *(F.col(o).alias(f"lo_{i}") for i, o in enumerate(t0.order) if ordered))
    right = t1.df.select(*(F.col(n).alias(f"r_{i}") for i, n in enumerate(right_names)), fold(F.col(b)).alias("_rl_k1"), *(F.col(o).alias(f"ro_{i}") for i, o in enumerate(t1.order) if ordered))
    if t == "double":
        left, right = left.where(~F.isnan("_rl_k0")), right.where(~F.isnan("_rl_k1"))
    both = left.join(right, F.col("_rl_k0") == F.col("_rl_k1"))
    taken = set(left_names)
    out = [F.col(f"l_{i}").alias(n) for i, n in enumerate(left_names)]
    for i, n in enumerate(right_names):
        name = n if n not in taken else n + suffix
        if name in taken:
            raise BadName(f"{name} is there twice; choose another suffix")
        taken.add(name)
        out.append(F.col(f"r_{i}").alias(name))
    if not ordered:
        return both.select(*out)
    keys = ["_rl_k0", *(f"lo_{i}" for i in range(len(t0.order))), *(f"ro_{i}" for i in range(len(t1.order)))]
    return number(both, keys).select("pos", *out)


def intersect3(a: Frame, b: Frame, column_a: str | int = 0, column_b: str | int = 0, *, nocase: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(in both, only in a, only in b) of two columns as multisets: each value as often as it occurs.

    With ``nocase`` values match by their lower case, and what is in both has a's spelling.
    """
    x, y = a.name(column_a), b.name(column_b)
    if a.type(x) != b.type(y):
        raise TypeMismatch(f"{x} is {a.type(x)}, {y} is {b.type(y)}")
    left, right = a.df.select(F.col(x).alias("value")), b.df.select(F.col(y).alias("value"))
    if not nocase or a.type(x) not in ("string", "any"):
        return left.intersectAll(right), left.exceptAll(right), right.exceptAll(left)

    def counted(df: DataFrame, side: str) -> DataFrame:
        """How often each spelling occurs, and how many of its folded value come before it: no copy is numbered."""
        spelt = df.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lower("value"))
        before = F.sum("n").over(Window.partitionBy("k").orderBy("value")) - F.col("n")  # a window sees the spellings of one word
        return spelt.withColumn("before", before).select("k", "value", "n", "before", F.sum("n").over(Window.partitionBy("k")).alias(f"all_{side}"))

    mine, theirs = counted(left, "a"), counted(right, "b")

    def split(own: DataFrame, other: DataFrame, total: str) -> DataFrame:
        other_all = other.groupBy("k").agg(F.max(total).alias(total))
        shared = F.least(F.greatest(F.coalesce(F.col(total), F.lit(0)) - F.col("before"), F.lit(0)), F.col("n"))
        return own.join(other_all, "k", "left").select("value", shared.alias("shared"), (F.col("n") - shared).alias("rest"))

    def repeated(df: DataFrame, n: str) -> DataFrame:
        return df.where(F.col(n) > 0).select(F.explode(F.array_repeat("value", F.col(n).cast("int"))).alias("value"))

    left_split, right_split = split(mine, theirs, "all_b"), split(theirs, mine, "all_a")
    return repeated(left_split, "shared"), repeated(left_split, "rest"), repeated(right_split, "rest")
