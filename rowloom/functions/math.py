"""Vector arithmetic, bit and logic operations and comparisons with the promotion rules of the logical types."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadValue, TypeMismatch
from . import types as L

ARITHMETIC, BITS, LOGIC, COMPARE = ("+", "-", "*", "/", "**"), ("&", "|", "^"), ("&&", "||", "^^"), ("==", "!=", "<", "<=", ">", ">=")
ALIASES = {
    "add": "+", "subtract": "-", "multiply": "*", "divide": "/", "power": "**", "bitand": "&", "bitor": "|", "bitxor": "^",
    "and": "&&", "or": "||", "xor": "^^", "eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=",
}


@dataclass(frozen=True)
class Operand:
    """An expression and its logical type. A literal promotes only as far as its value needs, which ``value`` keeps."""

    c: Column
    ltype: str
    value: object = None

    @classmethod
    def of(cls, v: object) -> Operand:
        if isinstance(v, Operand):
            return v
        if isinstance(v, Column):
            raise TypeMismatch("a bare column has no logical type; wrap it in Operand")
        t = L.of_value(v)
        return cls(F.lit(v).cast(L.SPARK[t]), t, v)


def _floor_div(x: Column, y: Column) -> Column:
    cut = F.call_function("div", x, y)  # truncates, and raises on zero
    return cut - F.when((x % y != 0) & ((x < 0) != (y < 0)), 1).otherwise(0)


def _ieee_div(x: Column, y: Column) -> Column:
    inf = F.lit(float("inf"))
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, inf).otherwise(-inf)
    return F.when(y == 0, by_zero).otherwise(x / F.when(y == 0, 1.0).otherwise(y))


def _on_wide(op: str, x: Column, y: Column) -> Column:
    if op == "/":
        return _floor_div(x, y)
    a, b = x.cast("decimal(19,0)"), y.cast("decimal(19,0)")
    return L.wrapped64({"+": a + b, "-": a - b, "*": a * b}[op].cast("decimal(38,0)"))


def _on_narrow(op: str, ltype: str):
    def step(x: Column, y: Column) -> Column:
        got = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: _floor_div(x, y)}[op]()
        return L.wrapped(got, ltype).cast("long")

    return step


def arithmetic(op: str, operands: list[Operand]) -> Operand:
    for o in operands:
        L.numeric(o.ltype)
    if op == "**":
        parts = [L.cast(o.c, o.ltype, "double") for o in operands]
        return Operand(reduce(lambda right, left: F.pow(left, right), reversed(parts)), "double")
    t = L.widest(*(o.ltype for o in operands))
    if len(operands) == 1:
        return operands[0]
    if t == "double":
        parts = [L.cast(o.c, o.ltype, "double") for o in operands]
        steps = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": _ieee_div}
        return Operand(reduce(steps[op], parts), "double")
    if all(o.value is not None for o in operands) and not (op == "/" and 0 in [o.value for o in operands[1:]]):
        # of literals alone the result is another literal, computed in 64 bits
        steps = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.floordiv}
        return Operand.of((reduce(steps[op], [int(o.value) for o in operands]) + 2**63) % 2**64 - 2**63)
    t = "int" if t == "boolean" else t
    parts = [L.as_long(o.c, o.ltype) for o in operands]
    step = (lambda x, y: _on_wide(op, x, y)) if t == "wide" else _on_narrow(op, t)
    return Operand(reduce(step, parts).cast(L.SPARK[t]), t)


def bits(op: str, operands: list[Operand]) -> Operand:
    if any(o.ltype not in L.INTEGERS for o in operands):
        raise TypeMismatch(f"{op} works on integers and booleans")
    t = L.widest(*(o.ltype for o in operands))
    if t == "boolean":
        return logic({"&": "&&", "|": "||", "^": "^^"}[op], operands)
    join = {"&": Column.bitwiseAND, "|": Column.bitwiseOR, "^": Column.bitwiseXOR}[op]
    return Operand(L.wrapped(reduce(join, [L.as_long(o.c, o.ltype) for o in operands]), t).cast(L.SPARK[t]), t)


def logic(op: str, operands: list[Operand]) -> Operand:
    for o in operands:
        L.numeric(o.ltype)
    join = {"&&": lambda x, y: x & y, "||": lambda x, y: x | y, "^^": lambda x, y: x != y}[op]
    return Operand(reduce(join, [L.cast(o.c, o.ltype, "boolean") for o in operands]), "boolean")


def compare_pair(op: str, a: Operand, b: Operand) -> Column:
    """One comparison. If either side is text both are compared as text; NaN equals and orders with nothing."""
    if {a.ltype, b.ltype} & {"string", "any"}:
        x, y, nan = L.as_text(a.c, a.ltype), L.as_text(b.c, b.ltype), None
    elif "double" in (a.ltype, b.ltype):
        x, y = L.cast(a.c, a.ltype, "double"), L.cast(b.c, b.ltype, "double")
        nan = F.isnan(x) | F.isnan(y)
    else:
        x, y, nan = L.as_long(a.c, a.ltype), L.as_long(b.c, b.ltype), None
    got = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return got if nan is None else F.when(nan, op == "!=").otherwise(got)


def compare(op: str, operands: list[Operand]) -> Operand:
    if op == "!=" and len(operands) != 2:
        raise BadValue("!= takes two operands")
    pairs = [compare_pair(op, a, b) for a, b in zip(operands, operands[1:], strict=False)]
    return Operand(reduce(lambda x, y: x & y, pairs) if pairs else F.lit(True), "boolean")


def math(op: str, *operands: object) -> Operand:
    """``op`` over operands: ``+ - *`` and ``/`` fold from the left, ``**`` from the right, comparisons chain."""
    op = ALIASES.get(op, op)
    held = [Operand.of(o) for o in operands]
    if not held:
        raise BadValue("no operands")
    for names, f in ((ARITHMETIC, arithmetic), (BITS, bits), (LOGIC, logic), (COMPARE, compare)):
        if op in names:
            return f(op, held)
    raise BadValue(f"unknown operation {op}")


def exact(op: str, ltype: str, a: int, b: int) -> int:
    """``a op b`` of two integers where the result has to fit ``ltype``."""
    return L.checked({"+": a + b, "-": a - b, "*": a * b}[op], ltype)
