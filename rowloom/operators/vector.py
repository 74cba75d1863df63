"""Vector operations over a frame's columns, added to it by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import types as L
from ..functions.math import Operand, math
from ..plans.frame import POS, Frame


def operand(frame: Frame, spec: str | int) -> Operand:
    """A column of a frame as an operand with its logical type."""
    name = frame.name(spec)
    return Operand(F.col(name), frame.type(name))


def compute(frame: Frame, name: str, op: str, *operands: object) -> Frame:
    """The frame with a new column ``op`` over operands: ``Operand``s (see ``operand``) and literals."""
    got = math(op, *operands)
    return with_operand(frame, name, got)


def with_operand(frame: Frame, name: str, got: Operand) -> Frame:
    return Frame(frame.df.withColumn(name, got.c.cast(L.SPARK[got.ltype])).withMetadata(name, {"ltype": got.ltype}), frame.order)


def cast(frame: Frame, column: str | int, ltype: str, name: str | None = None, strict: bool = False) -> Frame:
    """A column converted: lossily as a cast, or failing on values outside the type with ``strict``."""
    source = frame.name(column)
    change = L.strict if strict else L.cast
    return with_operand(frame, name or source, Operand(change(F.col(source), frame.type(source), ltype), ltype))


def elementwise(a: Frame, b: Frame, op: str) -> Frame:
    """``op`` over two one-column frames of equal length, position by position."""
    from ..errors import ShapeMismatch

    if a.size() != b.size():
        raise ShapeMismatch("columns of different lengths")
    x = a.numbered().select(POS, F.col(a.names[0]).alias("_rl_x"))
    y = b.numbered().select(POS, F.col(b.names[0]).alias("_rl_y"))
    got = math(op, Operand(F.col("_rl_x"), a.type()), Operand(F.col("_rl_y"), b.type()))
    return Frame(x.join(y, POS).select(POS, L.typed(got.c, got.ltype, "value")))


def negated(frame: Frame, column: str | int) -> Column:
    """A numeric column with its sign changed, folded into its type."""
    o = operand(frame, column)
    return math("-", 0, o).c
