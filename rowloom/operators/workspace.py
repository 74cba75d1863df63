"""Statements over named frames: indexing, key lookup, sizes, constructors, indexed assignment and ``@`` functions.

    value:  frame | frame.column | frame.(a, b) | frame.$v | column.key | value[index] | %value | {..} | literal
            | @type {..} | @type low:high:step | @type[n] low:high:* | @type(value) | @table(name type, ..) {{..}, ..}
            | @delete @fill @inject @insert @lookup @reverse @sum @list @dict (..) | @sort .. | @search ..
    index:  position | low:high | {positions} | a selection expression (see ``Selector``)
    assign: name = value | frame.column[index] = value | frame.(a, b)[index] = {row}

Frames stay plans; sizes, single rows, key lookups, ``@sum``, ``@list`` and ``@dict`` are values on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import BadIndex, BadName, BadValue
from ..functions import types as L
from ..plans.frame import POS, Frame
from ..plans.selector import Selector, condition, expression, select_expr
from . import aggregate, generate, mutate, search, sort, vector

_NAME = re.compile(r"[A-Za-z_]\w*")
_NUMBER = re.compile(r"-?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?")
_OPENS, _CLOSES = "([{", ")]}"
_RELATIONS = {"==": ("eq", False, False), "!=": ("eq", False, True), "<": ("lt", False, False), ">": ("gt", False, False), ">=": ("lt", False, True), "<=": ("gt", False, True), "=^": ("eq", True, False), "!^": ("eq", True, True), "~": ("re", False, False), "!~": ("re", False, True), "~^": ("re", True, False), "!~^": ("re", True, True)}


def _split(text: str, mark: str) -> list[str]:
    """The parts of a text at a mark outside quotes and brackets."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c in _OPENS:
            depth += 1
        elif c in _CLOSES:
            depth -= 1
        elif not depth and text.startswith(mark, i):
            out.append(text[start:i])
            i += len(mark)
            start = i
            continue
        i += 1
    return [*out, text[start:]]


class Workspace:
    """Named frames and values, and statements over them."""

    def __init__(self, spark: SparkSession, **held: object):
        self.spark, self.held = spark, dict(held)

    def run(self, text: str) -> object:
        """One statement. An assignment gives what it assigned."""
        sides = re.split(r"(?<![=!<>~^*])=(?![=^*])", text, maxsplit=1) if self._assigns(text) else [text]
        if len(sides) == 1:
            return self.value(text)
        return self._assign(sides[0].strip(), sides[1].strip())

    @staticmethod
    def _assigns(text: str) -> bool:
        return re.match(r"\s*[A-Za-z_]\w*(\s*\.\s*(\w+|\$\w+|\([^)]*\)))?\s*(\[.*?\])?\s*=(?![=^*])", text, re.S) is not None

    # ---- values

    def value(self, text: str) -> object:
        self.text, self.at = text, 0
        got = self._value()
        if self._rest().strip():
            raise BadValue(f"unexpected {self._rest().strip()!r}")
        return got

    def _rest(self) -> str:
        return self.text[self.at :]

    def _skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def _take(self, mark: str) -> bool:
        self._skip()
        if not self.text.startswith(mark, self.at):
            return False
        self.at += len(mark)
        return True

    def _match(self, pattern: re.Pattern) -> str | None:
        self._skip()
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m and m.group()

    def _inside(self, opening: str) -> str | None:
        """The text in the bracket that opens here."""
        if not self._take(opening):
            return None
        depth, quote = 1, ""
        for i, c in enumerate(self._rest()):
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            else:
                depth += (c in _OPENS) - (c in _CLOSES)
                if not depth:
                    got = self._rest()[:i]
                    self.at += i + 1
                    return got
        raise BadValue(f"a {_CLOSES[_OPENS.index(opening)]} is missing")

    def _sub(self, text: str) -> object:
        return Workspace(self.spark, **self.held).value(text)

    def _value(self) -> object:
        if self._take("%"):
            got = self._value()
            return got.size() if isinstance(got, Frame) else len(got)
        self._skip()
        if self.text.startswith("{", self.at):
            return [self._sub(x) for x in _split(self._inside("{"), ",") if x.strip()]
        if self.text[self.at : self.at + 1] in ("'", '"'):
            m = re.compile(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"").match(self.text, self.at)
            if not m:
                raise BadValue("a text doesn't end")
            self.at = m.end()
            return re.sub(r"\\(.)", r"\1", m[1] if m[1] is not None else m[2])
        if number := self._match(_NUMBER):
            return int(number) if re.fullmatch(r"-?\d+", number) else float(number)
        if self._take("@"):
            return self._postfix(self._at_form())
        name = self._match(_NAME)
        if name in ("true", "false"):
            return name == "true"
        if name not in self.held:
            raise BadName(f"nothing is named {name}")
        return self._postfix(self.held[name], name)

    def _postfix(self, got: object, name: str | None = None) -> object:
        while True:
            if self._take("."):
                got = self._member(got)
            elif (index := self._inside("[")) is not None:
                got = self._indexed(got, index, name)
            else:
                return got

    def _key(self) -> object:
        if self._take("$"):
            return self.held[self._match(_NAME)]
        self._skip()
        if self.text[self.at : self.at + 1] in ("'", '"'):
            return self._value()
        return self._match(re.compile(r"\w+"))

    def _member(self, got: object) -> object:
        if isinstance(got, dict):
            key = self._key()
            for k in (key, int(key) if isinstance(key, str) and key.isdigit() else key):
                if k in got:
                    return got[k]
            raise BadIndex(f"no key {key}")
        self._skip()
        if isinstance(got, Frame) and (inside := self._inside("(")) is not None:
            return got.slice([x.strip() for x in inside.split(",")])
        key = self._key()
        if got.width > 1 or key in got.names:
            return got.slice([key])
        return self._lookup(got, key)

    @staticmethod
    def _lookup(column: Frame, key: object) -> int:
        at = search.lookup(column, [str(key)]).first()["found"]
        if at < 0:
            raise BadIndex(f"no key {key}")
        return at

    def _index(self, frame: Frame, index: str, name: str | None):
        """A position, ("low", "high"), a list of positions, a frame of positions, or the text of a selection."""
        index = index.strip()
        if index.startswith("{") or index.startswith("@"):
            return self._sub(index)
        ends = [x.strip() for x in _split(index, ":")]
        if len(ends) == 2 and all(re.fullmatch(r"-?\d+|end([-+]\d+)?|", x) for x in ends):
            return tuple(x if x.startswith("end") else int(x) for x in (ends[0] or "0", ends[1] or "end"))
        if re.fullmatch(r"-?\d+|end([-+]\d+)?", index):
            return index if index.startswith("end") else int(index)
        if index.startswith("$") and not isinstance(self.held.get(index[1:]), (str, float)):
            return self.held[index[1:]]
        chain = re.fullmatch(r"(\w+)\.(\w+)\.('[^']*'|\"[^\"]*\"|\$?\w+)", index)  # frame.column.key
        if chain and isinstance(self.held.get(chain[1]), Frame):
            return self._sub(index)
        return re.sub(rf"\b{name}\s*\.\s*", "@@.", index) if name else index

    def _variables(self) -> dict[str, object]:
        return {k: v for k, v in self.held.items() if not isinstance(v, (Frame, list, dict))}

    def _indexed(self, got: object, index: str, name: str | None) -> object:
        if not isinstance(got, Frame):
            at = self._sub(index)
            return [got[i] for i in at] if isinstance(at, list) else got[at]
        at = self._index(got, index, name)
        if isinstance(at, tuple):
            return sort.span(got, *at)
        if isinstance(at, str) and not at.startswith("end"):
            # a selection of another column of the same named frame: the frame is selected, then the column taken
            whole = self.held.get(name) if name else None
            base = whole if isinstance(whole, Frame) and set(got.names) <= set(whole.names) else got
            return select_expr(base, at, self._variables()).slice(got.names)
        if isinstance(at, (int, str)):
            row = mutate.index(got, at)
            return row[0] if got.width == 1 else list(row)
        return mutate.get(got, at)

    # ---- assignment

    def _assign(self, target: str, text: str) -> object:
        m = re.fullmatch(r"([A-Za-z_]\w*)(?:\s*\.\s*(?:(\w+)|\$(\w+)|\(([^)]*)\)))?\s*(?:\[(.*)\])?", target, re.S)
        if not m:
            raise BadValue(f"can't assign to {target!r}")
        name, column, variable, several, index = m.groups()
        if index is None and not (column or variable or several):
            self.held[name] = self.value(text)
            return self.held[name]
        frame = self.held[name]
        if not isinstance(frame, Frame):
            frame[self._sub(index)] = self._sub(text)
            return frame
        names = [column or self.held[variable]] if column or variable else [x.strip() for x in several.split(",")] if several else frame.names
        self.held[name] = self._written(frame, names, index, text, name)
        return self.held[name]

    def _written(self, frame: Frame, names: list[str], index: str | None, text: str, name: str) -> Frame:
        if index is None:
            new = self._sub(text)
            return frame.with_column(names[0], new if new.type() == frame.type(names[0]) else vector.cast(new, new.names[0], frame.type(names[0])))
        at = self._index(frame, index, name)
        try:
            values = self._sub(text)
        except (BadName, BadValue):
            values = None
        rows = values if isinstance(values, (list, tuple)) else [values]
        if values is not None and not isinstance(values, Frame):
            if isinstance(at, tuple):
                return mutate.fill(frame, rows, low=at[0], high=at[1], columns=names)
            if isinstance(at, str) and not at.startswith("end"):
                return self._where(frame, at, lambda numbered, hit: mutate.fill(numbered, rows, hit, columns=names))
            if isinstance(at, list) and values and isinstance(values, list) and len(values) == len(at) and (len(names) == 1 or isinstance(values[0], list)):
                return mutate.place(frame, [tuple(v) if isinstance(v, list) else (v,) for v in values], at, columns=names)
            return mutate.fill(frame, rows, at if isinstance(at, (list, Frame)) else None, low=None if isinstance(at, (list, Frame)) else at, columns=names)
        if isinstance(values, Frame):
            return mutate.place(frame, values, at, columns=names) if not isinstance(at, tuple) else mutate.put(frame, values, at[0], columns=names)
        # each selected row's new value from its own old ones; the index may stand again after operands
        body = re.sub(rf"\b{name}\s*\.\s*", "@@.", text.replace(f"[{index}]", ""))

        def computed(numbered: Frame, hit) -> Frame:
            o = expression(numbered, body, self._variables())
            t = numbered.type(names[0])
            out = numbered.df.withColumn(names[0], F.when(hit, L.cast(o.c, o.ltype, t)).otherwise(F.col(names[0]))).withMetadata(names[0], {"ltype": t})
            return Frame(out, numbered.order)

        return self._where(frame, at, computed)

    def _where(self, frame: Frame, at: str, change) -> Frame:
        if Selector(frame, at, self._variables()).uses_positions:
            frame = frame.with_positions()
        return change(frame, condition(frame, at, self._variables()))

    # ---- @ forms

    def _at_form(self) -> object:
        word = self._match(_NAME)
        if word == "table":
            columns = [tuple(x.split()) for x in self._inside("(").split(",")]
            rows = [tuple(r) for r in self._value()] if self._rest().lstrip().startswith("{") else []
            return Frame.create(self.spark, columns, rows)
        if word in L.SPARK:
            return self._constructed(word)
        if word in ("sort", "search"):
            return getattr(self, f"_{word}")()
        given = _split(self._inside("(") or "", ",")
        first = self._sub(given[0])
        more = [x.strip() for x in given[1:]]
        if word == "delete":
            at = self._index(first, more[0], given[0].strip())
            if isinstance(at, str) and not at.startswith("end"):
                return self._where(first, at, lambda f, hit: search.select(f, ~hit))
            return mutate.delete(first, low=at[0], high=at[1]) if isinstance(at, tuple) else mutate.delete(first, at if isinstance(at, (list, Frame)) else None, low=None if isinstance(at, (list, Frame)) else at, high=None if isinstance(at, (list, Frame)) else at)
        if word == "fill":
            return Workspace(self.spark, **self.held)._written(first, first.names, more[1], more[0], given[0].strip())
        if word == "inject":
            rows = self._sub(more[0])
            rows = [tuple(r) if isinstance(r, list) else (r,) for r in rows] if isinstance(rows, list) else rows
            return mutate.inject(first, rows, self._place(more[1]))
        if word == "insert":
            row = self._sub(more[0])
            return mutate.insert(first, tuple(row) if isinstance(row, list) else row, self._place(more[1]), int(more[2]) if len(more) > 2 else 1)
        if word == "lookup":
            return search.lookup(first, [str(self._sub(more[0]))]).first()["found"]
        if word == "reverse":
            return sort.reverse(first)
        if word == "sum":
            return aggregate.sum(first).first()["sum"]
        if word == "list":
            return sort.as_list(first)
        if word == "dict":
            return sort.as_dict(first)
        raise BadName(f"no function @{word}")

    @staticmethod
    def _place(text: str) -> int | str:
        return text if text.startswith("end") else int(text)

    def _constructed(self, ltype: str) -> Frame:
        if (count := self._inside("[")) is not None:
            low, high = (self._sub(x) if x.strip() else None for x in [*_split(self._match(re.compile(r"[^,\]})]*")), ":"), "", ""][:2])
            return generate.random(self.spark, ltype, int(self._sub(count)), low, high)
        if (inside := self._inside("(")) is not None:
            column = self._sub(inside)
            cast = vector.cast(column, column.names[0], ltype) if isinstance(column, Frame) else None
            return cast if cast is not None else Frame.column(self.spark, ltype, column if isinstance(column, list) else [column])
        self._skip()
        if self.text.startswith("{", self.at):
            return Frame.column(self.spark, ltype, self._value())
        ends = self._match(re.compile(r"[-\d.]+:[-\d.]+(:[-\d.]+)?"))
        if ends is None:
            return Frame.column(self.spark, ltype)
        start, stop, step = (*(float(x) if "." in x else int(x) for x in ends.split(":")), 1)[:3]
        return vector.cast(generate.series(self.spark, start, stop, step), 0, ltype)

    def _options(self) -> set[str]:
        out = set()
        while word := self._match(_NAME):
            out.add(word)
        return out

    def _sort(self) -> Frame:
        """``@sort column options`` or ``@sort positions -> column options``: increasing, decreasing, nocase, indices."""
        first = self._value()
        among = self._take("->")
        column = self._value() if among else first
        o = self._options()
        if unknown := o - {"increasing", "decreasing", "nocase", "indices"}:
            raise BadValue(f"@sort has no option {unknown.pop()}")
        how = {"decreasing": "decreasing" in o, "nocase": "nocase" in o}
        if among:
            df = sort.sort_indirect(column, first, [0], **how)
        elif "indices" in o:
            df = sort.sort_positions(column, 0, **how)
        else:
            return sort.sort(column, 0, **how)
        return Frame(df.select(POS, L.typed(F.col("value"), "wide", "value")))

    def _search(self) -> object:
        """``@search column relation value options`` or ``@search positions -> column ..``: all, inline."""
        first = self._value()
        among = self._take("->")
        column = self._value() if among else first
        relation = self._match(re.compile(r"!~\^|==|!=|<=|>=|=\^|!\^|~\^|!~|[<>~]"))
        if relation is None:
            raise BadValue("@search needs a relation")
        oper, nocase, negate = _RELATIONS[relation]
        wanted, o = self._value(), self._options()
        if unknown := o - {"all", "inline"}:
            raise BadValue(f"@search has no option {unknown.pop()}")
        got = search.search(column, wanted, 0, oper, all="all" in o, inline="inline" in o, nocase=nocase, negate=negate, among=first if among else None)
        if "all" not in o:
            row = got.first()
            return row[0] if row else None
        name = column.names[0] if "inline" in o else POS
        key = "ord" if among else POS
        if not among and POS not in got.columns:
            kept = Frame(got, column.order).with_positions().df
            return Frame(kept.select(POS, L.typed(F.col(name), column.type(), "value")))
        from ..plans.frame import number

        rows = number(got.select(F.col(key).alias("_rl_key"), L.typed(F.col(name), column.type() if "inline" in o else "wide", "value")), ["_rl_key"])
        return Frame(rows.select(POS, "value"))
