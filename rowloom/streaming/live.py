"""Searching and summarising a stream of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import types as L
from ..functions.predicates import predicate
from ..operators.aggregate import summed


def search_stream(rows: DataFrame, column: str, value: object, oper: str = "eq", *, nocase: bool = False, negate: bool = False) -> DataFrame:
    """The rows of a stream whose column matches."""
    return rows.where(predicate(F.col(column), L.of(rows, column), value, oper, nocase, negate))


def summarize_stream(rows: DataFrame, label: Column | str, column: str, time: str, window: str, late: str) -> DataFrame:
    """(start, label, n, total) per event-time window; rows later than ``late`` are left out, which bounds the state."""
    key = F.col(label) if isinstance(label, str) else label
    held = rows.withWatermark(time, late)
    total = summed(F.col(column), L.of(rows, column))
    return held.groupBy(F.window(time, window).alias("w"), key.alias("label")).agg(F.count(F.lit(1)).alias("n"), total.alias("total")).select(F.col("w.start").alias("start"), "label", "n", "total")
