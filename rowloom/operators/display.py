"""Short text forms of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import types as L
from ..plans.frame import Frame
from .sort import head, tail


def _cell(v: object) -> str:
    return "" if v is None else str(int(v)) if isinstance(v, bool) else str(v)


def prettify(frame: Frame, *, first: int = 5, last: int = 5, full: bool = False, style: str = "ascii") -> str:
    """The first and last rows as an aligned table; ``full`` gives all rows. Styles: ascii, plain, and graphics, which draws a box."""
    n = frame.size()
    if full or n <= first + last:
        rows, gap = frame.rows(), False
    else:
        rows = head(frame, first).rows() + tail(frame, last).rows()
        gap = True
    cells = [frame.names, *([_cell(v) for v in r] for r in rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(frame.width)]
    if style == "graphics":
        rule = lambda left, cross, right: left + cross.join("─" * (w + 2) for w in widths) + right
        boxed = ["│" + "│".join(f" {c.ljust(w)} " for c, w in zip(r, widths, strict=True)) + "│" for r in cells]
        if gap:
            boxed.insert(1 + first, "│" + "│".join(f" {'...'[:w].ljust(w)} " for w in widths) + "│")
        return "\n".join([rule("┌", "┬", "┐"), boxed[0], rule("├", "┼", "┤"), *boxed[1:], rule("└", "┴", "┘")])
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    if gap:
        lines.insert(1 + first, "...")
    if style == "ascii":
        lines.insert(1, "-+-".join("-" * w for w in widths))
    return "\n".join(lines)


def print_frame(frame: Frame, **options) -> None:
    print(prettify(frame, **options))


def text_width(frame: Frame, column: str | int = 0, form: str | None = None) -> DataFrame:
    """(width): the greatest length of the column's values as text, 0 for none."""
    name = frame.name(column)
    text = F.format_string(form, F.col(name)) if form else L.as_text(F.col(name), frame.type(name))
    return frame.df.agg(F.coalesce(F.max(F.char_length(text)), F.lit(0)).alias("width"))
