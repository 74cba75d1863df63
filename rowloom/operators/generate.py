"""Columns made from nothing: series, even and logarithmic spacing, constants, bitmaps, random values."""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadIndex, BadValue, TypeMismatch
from ..functions import types as L
from ..plans.frame import POS, Frame


def _column(df: DataFrame, c, ltype: str, name: str = "value") -> Frame:
    return Frame(df.select(F.col("id").alias(POS), L.typed(c, ltype, name)))


def series(spark: SparkSession, start, stop=None, step=1) -> Frame:
    """Values from start to before stop; with one bound, from 0. A double is start + i * step, without drift."""
    if stop is None:
        start, stop = 0, start
    if step == 0:
        raise BadValue("a step of 0")
    if start != stop and (stop > start) != (step > 0):
        raise BadValue("the step leads away from the end")
    if any(isinstance(x, float) for x in (start, stop, step)):
        n = max(0, math.ceil((stop - start) / step))
        return _column(spark.range(n), F.lit(float(start)) + F.col("id") * F.lit(float(step)), "double")
    n = -(-(stop - start) // step) if start != stop else 0
    small = all(L.DOMAIN["int"][0] <= x <= L.DOMAIN["int"][1] for x in (start, stop, step))
    return _column(spark.range(n), F.lit(start) + F.col("id") * F.lit(step), "int" if small else "wide")


def _spaced(spark: SparkSession, start, stop, n: int, open: bool):
    if n <= 0:
        raise BadValue("a positive number of values is needed")
    parts = n if open else max(1, n - 1)
    step = (stop - start) / parts
    c = F.col("id") * F.lit(float(step)) + F.lit(float(start))
    return spark.range(n), c if open or n == 1 else F.when(F.col("id") == n - 1, F.lit(float(stop))).otherwise(c)


def linspace(spark: SparkSession, start, stop, n: int, *, ltype: str = "double", open: bool = False) -> Frame:
    """n evenly spaced values from start to stop (``open``: before stop); integers are truncated."""
    df, c = _spaced(spark, start, stop, n, open)
    return _column(df, L.cast(c, "double", ltype), ltype)


def logspace(spark: SparkSession, start, stop, n: int, *, ltype: str = "double", open: bool = False, base: float = 10) -> Frame:
    """``base`` to the power of evenly spaced exponents."""
    df, c = _spaced(spark, start, stop, n, open)
    return _column(df, L.cast(F.pow(F.lit(float(base)), c), "double", ltype), ltype)


def constant(spark: SparkSession, value, n: int, ltype: str = "int") -> Frame:
    return _column(spark.range(n), F.lit(L.checked(value, ltype)), ltype)


def zeroes(spark: SparkSession, n: int, ltype: str = "int") -> Frame:
    return constant(spark, 0, n, ltype)


def ones(spark: SparkSession, n: int, ltype: str = "int") -> Frame:
    return constant(spark, 1, n, ltype)


def bitmap(spark: SparkSession, n: int = 0, at: Sequence[int] = (), value: bool = True) -> Frame:
    """n booleans, all but those at the given positions the opposite of ``value``; the bitmap grows to hold them."""
    if any(p < 0 for p in at):
        raise BadIndex("a negative position")
    n = max(n, max(at, default=-1) + 1)
    places = spark.createDataFrame([(int(p),) for p in sorted(set(at))], "id long")
    df = spark.range(n).join(places.withColumn("_rl_hit", F.lit(True)), "id", "left")
    return _column(df, F.when(F.col("_rl_hit"), F.lit(value)).otherwise(F.lit(not value)), "boolean")


def bitmap0(spark: SparkSession, n: int = 0, at: Sequence[int] = ()) -> Frame:
    return bitmap(spark, n, at, True)


def bitmap1(spark: SparkSession, n: int = 0, at: Sequence[int] = ()) -> Frame:
    return bitmap(spark, n, at, False)


class Rng:
    """A stream of uniform random values of a type: each value depends on the seed and its place in the stream alone.

    Values come from a hash of seed and place, so partitions and retries don't change them.
    """

    def __init__(self, spark: SparkSession, ltype: str, low=None, high=None, seed: tuple[int, int] = (42, 54)):
        if ltype in ("string", "any"):
            raise TypeMismatch("random values are numbers or booleans")
        self.spark, self.ltype, self.at = spark, ltype, 0
        self.bounds = self._bounds(low, high)
        self.seed(*seed)

    def _bounds(self, low, high):
        if self.ltype == "boolean":
            return (0, 2)
        least, most = (0.0, 1.0) if self.ltype == "double" else L.DOMAIN[self.ltype]
        if self.ltype == "byte" and low is None and high is None:
            return (0, 255)  # the upper bound is never drawn
        low = (least if high is None or high > least else 0) if low is None else low
        high = (most if self.ltype == "double" else most + 1) if high is None else high
        if low == high:
            raise BadValue("the bounds are equal")
        return (low, high) if low < high else (high, low)

    def seed(self, s1: int = 42, s2: int = 54) -> None:
        self.seeds, self.at = (s1, s2), 0

    def get(self, n: int = 1, low=None, high=None) -> Frame:
        lo, hi = self.bounds if low is None and high is None else self._bounds(low, high)
        place = F.col("id") + F.lit(self.at)
        self.at += n
        unit = F.shiftrightunsigned(F.xxhash64(F.lit(self.seeds[0]), F.lit(self.seeds[1]), place), 11).cast("double") / F.lit(float(1 << 53))
        if self.ltype == "double":
            c = F.lit(float(lo)) + unit * F.lit(float(hi) - float(lo))
        elif hi - lo >= 1 << 52:  # more values than a double tells apart
            draw = F.xxhash64(F.lit(self.seeds[0]), F.lit(self.seeds[1]), place)
            c = draw if hi - lo >= 1 << 64 else (F.pmod(draw.cast("decimal(38,0)"), F.lit(hi - lo).cast("decimal(38,0)")) + F.lit(lo).cast("decimal(38,0)")).cast("long")
        else:
            c = F.floor(unit * F.lit(float(hi - lo))).cast("long") + F.lit(lo)
        return _column(self.spark.range(n), c == 1 if self.ltype == "boolean" else c, self.ltype)


_process = {"seeds": (42, 54), "at": 0}


def randseed(s1: int | None = None, s2: int = 54) -> None:
    """Starts this process's stream of random values anew; without seeds, from the system's own randomness."""
    if s1 is None:
        s1, s2 = (int.from_bytes(os.urandom(8), "little", signed=True) for _ in range(2))
    _process.update(seeds=(s1, s2), at=0)


def random(spark: SparkSession, ltype: str, n: int, low=None, high=None, seed: tuple[int, int] | None = None) -> Frame:
    """n uniform random values; the upper bound is exclusive. Without ``seed``, the next of this process's stream (``randseed``)."""
    rng = Rng(spark, ltype, low, high, seed or _process["seeds"])
    if seed is None:
        rng.at = _process["at"]
        _process["at"] += n
    return rng.get(n)
