"""CSV files with sniffed headers and types."""

from __future__ import annotations

import csv as dialects
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadName, BadValue
from ..functions import types as L
from ..plans.frame import POS, Frame, number

#: Lines that are read on the driver to tell dialect and header.
SNIFFED = 200


def _kind(v: str) -> str:
    if re.fullmatch(r"[-+]?\d+", v.strip()):
        return "wide"
    try:
        float(v)
        return "double"
    except ValueError:
        return "string"


def _has_header(rows: list[list[str]]) -> bool:
    """A first row that no value of which is a number, over columns some of which are."""
    if len(rows) < 2 or any(_kind(v) != "string" for v in rows[0] if v):
        return False
    return any(_kind(v) != "string" for r in rows[1:] for v in r) or len(set(rows[0])) == len(rows[0]) and all(len(r) == len(rows[0]) for r in rows) and not any(rows[0] == r for r in rows[1:]) and all(re.fullmatch(r"[A-Za-z_][\w ]*", v) for v in rows[0])


def column_names(titles: list[str] | None, width: int) -> list[str]:
    """Names from titles: what is neither letter, digit nor _ becomes _, and a blank title Col_N, from 1."""
    out = []
    for i in range(width):
        t = titles[i].strip() if titles and i < len(titles) else ""
        out.append(re.sub(r"\W", "_", t) if t else f"Col_{i + 1}")
    if len(set(out)) < len(out):
        raise BadName("the header names a column twice")
    return out


def csv_import(spark: SparkSession, path: str, *, sniff: bool = False, encoding: str = "UTF-8", header: bool | None = None, separator: str = ",", quote: str = '"', escape: str = '"', comment: str | None = None, skip_blank: bool = True) -> Frame:
    """A frame of a CSV file's rows in file order, its columns typed wide, double or string by all their values.

    The header is detected from the first lines unless ``header`` says; ``sniff`` detects the
    separator and quote too. Rows keep the order of the files' names and of their lines.
    """
    lines = [r[0] for r in spark.read.option("encoding", encoding).text(path).limit(SNIFFED).collect()]
    if sniff and lines:
        try:
            found = dialects.Sniffer().sniff("\n".join(lines), delimiters=",\t;|: ")
            separator, quote = found.delimiter, found.quotechar or quote
        except dialects.Error as e:
            raise BadValue(f"can't tell the dialect: {e}") from None
    sample = [r for r in dialects.reader(lines, delimiter=separator, quotechar=quote) if r and not (comment and r[0].startswith(comment))]
    width = max(map(len, sample), default=0)
    header = _has_header(sample) if header is None else header
    names = column_names(sample[0] if header and sample else None, width)
    reader = spark.read.option("sep", separator).option("quote", quote).option("escape", escape).option("encoding", encoding).option("header", header).option("multiLine", True)
    if comment:
        reader = reader.option("comment", comment)
    raw = reader.schema(T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])).csv(path)
    raw = raw.withColumn("_rl_file", F.input_file_name()).withColumn("_rl_at", F.monotonically_increasing_id())
    texts = [F.coalesce(F.col(f"c{i}"), F.lit("")) for i in range(width)]
    if not width:
        return Frame.create(spark, [])
    whole = [F.coalesce(F.bool_and(t.rlike(r"^\s*[-+]?\d+\s*$") & F.expr(f"try_cast(trim(coalesce(c{i}, '')) as bigint)").isNotNull()), F.lit(False)) for i, t in enumerate(texts)]
    real = [F.coalesce(F.bool_and(F.expr(f"try_cast(trim(coalesce(c{i}, '')) as double)").isNotNull()), F.lit(False)) for i in range(width)]
    found = raw.agg(*(c.alias(f"w{i}") for i, c in enumerate(whole)), *(c.alias(f"r{i}") for i, c in enumerate(real))).first()
    kinds = ["wide" if found[f"w{i}"] else "double" if found[f"r{i}"] else "string" for i in range(width)]
    cols = [L.typed(F.trim(t) if k != "string" else t, k, n) for t, k, n in zip(texts, kinds, names, strict=True)]
    rows = number(raw.select("_rl_file", "_rl_at", *cols), ["_rl_file", "_rl_at"])
    return Frame(rows.select(POS, *names))


def csv_export(frame: Frame, path: str, *, header: list[str] | None = None, mode: str = "errorifexists", encoding: str = "UTF-8", separator: str = ",", quote: str = '"', single_file: bool = True, translation: str = "lf") -> None:
    """The rows in order as CSV, lines ending as ``translation`` says (lf, crlf or cr); an existing path is an error unless ``mode`` is overwrite or append.

    ``header`` gives the titles of a header line (none by default). With ``single_file`` False the
    rows are range-partitioned and the files, by name, hold them in order.
    """
    if header is not None and len(header) != frame.width:
        raise BadName(f"{len(header)} titles for {frame.width} columns")
    ends = {"lf": "\n", "crlf": "\r\n", "cr": "\r"}
    if translation not in ends:
        raise BadValue(f"lines can't end in {translation}")
    keys = [F.col(o) for o in frame.order]
    rows = frame.df.orderBy(*keys)
    shown = rows.select(*(L.as_text(F.col(n), frame.type(n)).alias(h) for n, h in zip(frame.names, header or frame.names, strict=True)))
    out = shown.coalesce(1) if single_file else shown
    out.write.mode(mode).option("header", header is not None).option("sep", separator).option("quote", quote).option("escape", quote).option("encoding", encoding).option("emptyValue", "").option("lineSep", ends[translation]).csv(path)
