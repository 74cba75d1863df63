"""Order: sorting by value, to positions and indirectly; reversing, shuffling, ranges, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frame import POS, Frame, bounds, indices, number


def sort_keys(frame: Frame, columns: Sequence[str | int], decreasing: bool = False, nocase: bool = False) -> list[Column]:
    """Sort keys for columns and then the frame's own order, which makes the sort stable in either direction."""
    out = []
    for c in columns:
        name = frame.name(c)
        key = F.lower(name) if nocase and frame.type(name) in ("string", "any") else F.col(name)
        out.append(key.desc() if decreasing else key.asc())
    return [*out, *(F.col(o).asc() for o in frame.order)]


def sort(frame: Frame, column: str | int = 0, *, decreasing: bool = False, nocase: bool = False, columns: Sequence[str | int] | None = None) -> Frame:
    """The rows sorted by one column, stable, with their new positions; ``columns`` are the columns to return."""
    keep = frame.names if columns is None else [frame.name(c) for c in columns]
    names = list(dict.fromkeys([*keep, frame.name(column), *frame.order]))
    rows = frame.df.select(*names).withColumnRenamed(POS, "_rl_old") if POS in names else frame.df.select(*names)
    keys = sort_keys(frame, [column], decreasing, nocase)
    if POS in frame.order:
        keys = [*keys[: -len(frame.order)], *(F.col("_rl_old" if o == POS else o).asc() for o in frame.order)]
    return Frame(number(rows, keys).select(POS, *keep))


def sort_positions(frame: Frame, column: str | int = 0, *, decreasing: bool = False, nocase: bool = False) -> DataFrame:
    """(pos, value): at each new position the old position of the row that goes there."""
    rows = frame.numbered().select(F.col(POS).alias("value"), F.col(frame.name(column)).alias("_rl_key"))
    key = F.lower("_rl_key") if nocase and frame.type(column) in ("string", "any") else F.col("_rl_key")
    return number(rows, [key.desc() if decreasing else key.asc(), F.col("value")]).select(POS, "value")


def sort_indirect(frame: Frame, given, keys: Sequence[str | int], *, decreasing: bool = False, nocase: bool = False) -> DataFrame:
    """(pos, value): the given positions sorted by the frame's values at them; ties keep the given order.

    Several keys stand for as many passes, the last the strongest; one sort does them all.
    """
    at = indices(frame, given)
    rows = frame.numbered().join(at, F.col(POS) == F.col("at"))
    keyed = []
    for k in reversed(keys):
        name = frame.name(k)
        keyed.append(F.lower(name) if nocase and frame.type(name) in ("string", "any") else F.col(name))
    rows = rows.select("ord", F.col("at").alias("value"), *(c.alias(f"_rl_{i}") for i, c in enumerate(keyed)))
    order = [F.col(f"_rl_{i}").desc() if decreasing else F.col(f"_rl_{i}").asc() for i in range(len(keyed))]
    return number(rows, [*order, F.col("ord")]).select(POS, "value")


def reverse(frame: Frame) -> Frame:
    """The rows in the opposite order; positions are recomputed by subtraction, without a sort."""
    rows = frame.numbered()
    last = frame.size() - 1
    return Frame(rows.withColumn(POS, F.lit(last) - F.col(POS)))


def shuffle(frame: Frame, seed: int | None = None) -> Frame:
    """The rows in a random order, the same for a seed and a frame."""
    s = F.lit(seed if seed is not None else 42)
    rows = frame.numbered().withColumnRenamed(POS, "_rl_old")
    return Frame(number(rows, [F.xxhash64(s, "_rl_old"), F.col("_rl_old")]).drop("_rl_old"))


def span(frame: Frame, low: int | str, high: int | str) -> Frame:
    """Rows low to high, inclusive, with positions from 0."""
    size = frame.size() if any(isinstance(x, str) for x in (low, high)) else 0
    lo, hi = bounds(low, high, size)
    rows = frame.numbered().where(F.col(POS).between(lo, hi))
    return Frame(rows.withColumn(POS, F.col(POS) - lo))


def head(frame: Frame, n: int) -> Frame:
    return Frame(_limited(frame.df, [F.col(o).asc() for o in frame.order], n), frame.order)


def tail(frame: Frame, n: int) -> Frame:
    return Frame(_limited(frame.df, [F.col(o).desc() for o in frame.order], n), frame.order)


def _limited(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def top_k(frame: Frame, k: int, column: str | int = 0, decreasing: bool = True) -> Frame:
    """The first k rows of a stable sort; each partition keeps k rows and only those meet."""
    few = frame.df.orderBy(*sort_keys(frame, [column], decreasing)).limit(k)
    name = frame.name(column)
    if frame.order == (POS,):
        few = few.withColumnRenamed(POS, "_rl_old")
        own = [F.col("_rl_old").asc()]
    else:
        own = [F.col(o).asc() for o in frame.order]
    first = F.col(name).desc() if decreasing else F.col(name).asc()
    return Frame(number(few, [first, *own], distributed=False).drop("_rl_old"))




def as_list(frame: Frame) -> list:
    """All rows in order, on the driver: values for one column, else lists of values."""
    return [r[0] for r in frame.rows()] if frame.width == 1 else [list(r) for r in frame.rows()]


def as_dict(frame: Frame, at: Frame | DataFrame | None = None) -> dict[int, object]:
    """What ``as_list`` gives, on the driver, by position in the frame.

    With ``at`` (positions as ``sort_positions``, ``search`` and ``Frame`` give them) only those rows, in their order.
    """
    if at is None:
        return dict(enumerate(as_list(frame)))
    if isinstance(at, Frame):
        wanted = at.numbered().select(F.col(POS).alias("_rl_o"), F.col(at.names[0]).alias("_rl_w"))
    else:  # (pos, value), (ord, pos) or (pos)
        wanted = at.select(F.col(at.columns[0]).alias("_rl_o"), F.col(at.columns[-1]).alias("_rl_w"))
    rows = wanted.join(frame.numbered().select(F.col(POS).alias("_rl_w"), *frame.names), "_rl_w").orderBy("_rl_o").select("_rl_w", *frame.names).collect()
    return {r[0]: r[1] if frame.width == 1 else list(r[1:]) for r in rows}
