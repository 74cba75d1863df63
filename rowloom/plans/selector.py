"""Selection expressions as text, compiled to columns: ``Salary > 50000 && Location != 'New York'``.

Grammar, loosest first::

    or:      xor ('||' xor)*            and:  bits ('&&' bits)*        xor: and ('^^' and)*
    bits:    compare (('&' | '|' | '^') compare)*
    compare: range ( ('==' '!=' '<' '<=' '>' '>=' '=^' '!^' '~' '~^' '!~' '!~^' '=*' '!*' '=^*' '!^*') range )?
    range:   sum (':' sum?)?            sum:  product (('+' | '-') product)*
    product: power (('*' | '/') power)* power: unary ('**' power)?
    unary:   ('-' | '+' | '~' | '!') unary | number | string | name | '@@' ('.' name)? | '(' or ')'

Text is never evaluated as code. Regular expressions and globs take a literal on the right.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadName, BadValue
from ..functions import types as L
from ..functions.math import Operand, compare_pair, math
from ..functions.predicates import predicate
from .frame import POS, Frame

_TOKEN = re.compile(r"\s*(?:(\d+\.\d*(?:[eE][-+]?\d+)?|\d+(?:[eE][-+]?\d+)?|0x[0-9a-fA-F]+|\.\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(@@|[A-Za-z_]\w*|\$\w+)|(!~\^|=\^\*|!\^\*|\*\*|\|\||&&|\^\^|==|!=|<=|>=|=\^|!\^|=\*|!\*|!~|~\^|[-+*/&|^<>~!().:,]))")
_PATTERNS = {"~": ("re", False, False), "~^": ("re", True, False), "!~": ("re", False, True), "!~^": ("re", True, True), "=*": ("pat", False, False), "!*": ("pat", False, True), "=^*": ("pat", True, False), "!^*": ("pat", True, True)}


def _tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise BadValue(f"can't read the expression at {text[at:at + 12]!r}")
        number, single, double, name, op = m.groups()
        if number is not None:
            whole = re.fullmatch(r"\d+|0x[0-9a-fA-F]+", number)
            out.append(("value", int(number, 0) if whole and not re.fullmatch(r"0\d+", number) else int(number) if whole else float(number)))
        elif single is not None or double is not None:
            out.append(("value", re.sub(r"\\(.)", r"\1", single if single is not None else double)))
        elif name is not None:
            out.append(("name", name))
        else:
            out.append(("op", op))
        at = m.end()
    return out


class Selector:
    """One expression over a frame's columns. ``variables`` are the values of ``$name``."""

    def __init__(self, frame: Frame, text: str, variables: dict[str, object] | None = None):
        self.frame, self.variables = frame, variables or {}
        self.tokens, self.at = _tokens(text), 0
        self.uses_positions = False
        self.result = self._or()
        if self.at < len(self.tokens):
            raise BadValue(f"unexpected {self.tokens[self.at][1]!r}")

    def _next(self, *ops: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _left(self, below, *ops: str) -> Operand:
        got = below()
        while op := self._next(*ops):
            got = math(op, got, below())
        return got

    def _or(self) -> Operand:
        return self._left(self._xor, "||")

    def _xor(self) -> Operand:
        return self._left(self._and, "^^")

    def _and(self) -> Operand:
        return self._left(self._bits, "&&")

    def _bits(self) -> Operand:
        return self._left(self._compare, "&", "|", "^")

    def _literal(self) -> object:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "value":
            name = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
            if isinstance(name, str) and name.startswith("$"):
                self.at += 1
                return self._variable(name)
            raise BadValue("a pattern has to be a literal")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def _compare(self) -> Operand:
        left = self._range()
        op = self._next("==", "!=", "<", "<=", ">", ">=", "=^", "!^", *_PATTERNS)
        if op is None:
            return left
        if op in _PATTERNS:
            oper, nocase, negate = _PATTERNS[op]
            return Operand(predicate(L.as_text(left.c, left.ltype), "string", self._literal(), oper, nocase, negate), "boolean")
        right = self._range()
        if op in ("=^", "!^"):
            same = F.lower(L.as_text(left.c, left.ltype)) == F.lower(L.as_text(right.c, right.ltype))
            return Operand(same if op == "=^" else ~same, "boolean")
        return Operand(compare_pair(op, left, right), "boolean")

    def _range(self) -> Operand:
        low = self._sum()
        if not self._next(":"):
            return low
        self.uses_positions = True
        more = self.at < len(self.tokens) and self.tokens[self.at] not in (("op", ")"), ("op", "&&"), ("op", "||"))
        inside = F.col(POS) >= L.as_long(low.c, low.ltype)
        if more:
            high = self._sum()
            inside = inside & (F.col(POS) <= L.as_long(high.c, high.ltype))
        return Operand(inside, "boolean")

    def _sum(self) -> Operand:
        return self._left(self._product, "+", "-")

    def _product(self) -> Operand:
        return self._left(self._power, "*", "/")

    def _power(self) -> Operand:
        base = self._unary()
        return math("**", base, self._power()) if self._next("**") else base

    def _unary(self) -> Operand:
        if op := self._next("-", "+", "~", "!"):
            if op == "-" and self.at < len(self.tokens) and self.tokens[self.at][0] == "value" and not isinstance(self.tokens[self.at][1], str):
                self.at += 1
                return Operand.of(-self.tokens[self.at - 1][1])
            o = self._unary()
            if op == "-":
                return math("-", 0, o)
            if op == "+":
                return o
            if op == "!":
                return Operand(~L.cast(o.c, o.ltype, "boolean"), "boolean")
            t = "int" if o.ltype == "boolean" else o.ltype
            if t not in L.INTEGERS:
                raise BadValue("~ works on integers")
            return Operand(L.wrapped(F.bitwise_not(L.as_long(o.c, o.ltype)), t), t)
        if self._next("("):
            got = self._or()
            if not self._next(")"):
                raise BadValue("a ) is missing")
            return got
        if self.at >= len(self.tokens):
            raise BadValue("the expression ends too soon")
        kind, v = self.tokens[self.at]
        self.at += 1
        if kind == "value":
            return Operand.of(v)
        if kind != "name":
            raise BadValue(f"unexpected {v!r}")
        if v.startswith("$"):
            return Operand.of(self._variable(v))
        if v in ("true", "false") and v not in self.frame.names:
            return Operand.of(v == "true")
        if v == "@@":
            v = self.frame.names[0]
            if self._next("."):
                kind, v = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                self.at += 1
                if kind != "name":
                    raise BadName("a column name has to follow @@.")
                v = str(self._variable(v)) if v.startswith("$") else v
        name = self.frame.name(v)
        return Operand(F.col(name), self.frame.type(name))

    def _variable(self, name: str) -> object:
        if name[1:] not in self.variables:
            raise BadName(f"no variable {name}")
        return self.variables[name[1:]]


def expression(frame: Frame, text: str, variables: dict[str, object] | None = None) -> Operand:
    """The expression as an operand over the frame's columns; ranges need the frame to have positions."""
    return Selector(frame, text, variables).result


def condition(frame: Frame, text: str, variables: dict[str, object] | None = None) -> Column:
    o = expression(frame, text, variables)
    return L.cast(o.c, o.ltype, "boolean")


def select_expr(frame: Frame, text: str, variables: dict[str, object] | None = None) -> Frame:
    """The rows that a selection expression keeps, in their order."""
    parsed = Selector(frame, text, variables)
    o = parsed.result
    rows = frame.with_positions() if parsed.uses_positions and frame.order != (POS,) else frame
    kept = rows.df.where(L.cast(o.c, o.ltype, "boolean"))
    if rows.order == (POS,):
        from .frame import number

        return Frame(number(kept.withColumnRenamed(POS, "_rl_old"), ["_rl_old"]).drop("_rl_old"))
    return Frame(kept, rows.order)


_UI = re.compile(r"\s*(==|!=|>=|<=|>|<|!~\^|~\^|!~|~|!\*|\*)?\s*(.*?)\s*\Z", re.S)


def table_filter(frame: Frame, filters: dict[str | int, str]) -> Column:
    """A condition from a filter text for each column, all of which have to hold.

    A text is an operator (``== != > >= < <= * !* ~ !~ ~^ !~^``; ``==`` if none) and a value: globs
    and regular expressions match the column as text; an empty text filters nothing.
    """
    out = F.lit(True)
    for spec, text in filters.items():
        if not text.strip():
            continue
        name = frame.name(spec)
        t, c = frame.type(name), F.col(frame.name(spec))
        op, value = _UI.match(text).groups()
        op = op or "=="
        if op in ("*", "!*"):
            out = out & predicate(L.as_text(c, t), "string", value, "pat", False, op == "!*")
        elif "~" in op:
            out = out & predicate(L.as_text(c, t), "string", value, "re", op.endswith("^"), op.startswith("!"))
        else:
            oper, negate = {"==": ("eq", False), "!=": ("eq", True), ">": ("gt", False), "<=": ("gt", True), "<": ("lt", False), ">=": ("lt", True)}[op]
            out = out & predicate(c, t, value, oper, False, negate)
    return out
