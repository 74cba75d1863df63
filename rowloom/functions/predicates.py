"""Search predicates as boolean expressions, and the glob patterns they take."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadValue, TypeMismatch
from . import types as L
from .math import Operand, compare_pair

_OPS = {"eq": "==", "gt": ">", "lt": "<"}


def glob_regex(pattern: str, nocase: bool = False) -> str:
    """A whole-string regular expression for a glob: ``*``, ``?``, ``[a-z]`` and ``\\x``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = re.sub(r"([\\\[\]^&~])", r"\\\1", pattern[i + 1 : end])
            out.append(f"[{inner}]" if inner else "(?!)")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.sub(r"(\W)", r"\\\1", pattern[i]) if pattern[i].isascii() else pattern[i])
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c) if c.isascii() else c)
        i += 1
    return ("(?is)" if nocase else "(?s)") + r"\A" + "".join(out) + r"\z"


def predicate(c: Column, ltype: str, value: object, oper: str = "eq", nocase: bool = False, negate: bool = False) -> Column:
    """``c oper value``: eq, gt, lt, pat (glob) or re (regular expression); negation selects exactly the other rows."""
    text = ltype in ("string", "any")
    if oper in ("pat", "re") and not text:
        raise TypeMismatch(f"{oper} works on text")
    if nocase and not text:
        raise TypeMismatch("nocase works on text")
    if oper == "pat":
        got = c.rlike(glob_regex(str(value), nocase))
    elif oper == "re":
        got = c.rlike(("(?i)" if nocase else "") + str(value))
    elif oper in _OPS:
        if ltype == "boolean" and oper != "eq":
            raise TypeMismatch("booleans are only searched for equality")
        value = L.checked(value, ltype)
        if nocase:
            c, value = F.lower(c), value.lower()
        got = _plain(c, value, oper) if ltype != "double" else compare_pair(_OPS[oper], Operand(c, "double"), Operand(F.lit(float(value)), "double"))
        if ltype == "double" and not negate and value == value:
            got = _plain(c, value, oper) & ~F.isnan(c) if oper == "gt" else _plain(c, value, oper)  # a form that a Parquet scan takes
    else:
        raise BadValue(f"unknown operator {oper}")
    return ~got if negate else got


def _plain(c: Column, value: object, oper: str) -> Column:
    return {"eq": c == F.lit(value), "gt": c > F.lit(value), "lt": c < F.lit(value)}[oper]
