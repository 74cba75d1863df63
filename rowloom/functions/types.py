"""Logical types: what a column's values may be, beside the Spark type that holds them.

``byte`` is 0..255 in SMALLINT and ``uint`` is 0..2**32-1 in BIGINT, since Spark's types are signed;
the logical type of a field is kept in its metadata under ``ltype``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadValue, TypeMismatch

SPARK = {
    "boolean": T.BooleanType(), "byte": T.ShortType(), "int": T.IntegerType(), "uint": T.LongType(),
    "wide": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "any": T.StringType(),
}
DOMAIN = {"boolean": (0, 1), "byte": (0, 255), "int": (-(2**31), 2**31 - 1), "uint": (0, 2**32 - 1), "wide": (-(2**63), 2**63 - 1)}
INTEGERS = ("boolean", "byte", "int", "uint", "wide")
_RANK = ("boolean", "byte", "int", "uint", "wide", "double", "string", "any")


def of_field(field: T.StructField) -> str:
    """The logical type of a field: its metadata, else what its Spark type suggests."""
    if "ltype" in field.metadata:
        return field.metadata["ltype"]
    kinds = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "wide", T.DoubleType: "double", T.FloatType: "double", T.DecimalType: "double", T.StringType: "string"}
    return kinds.get(type(field.dataType), "any")


def of(df: DataFrame, name: str) -> str:
    return of_field(df.schema[name])


def typed(c: Column, ltype: str, name: str) -> Column:
    """``c`` as ``ltype`` under a name, with the type in its metadata."""
    return c.cast(SPARK[ltype]).alias(name, metadata={"ltype": ltype})


def of_value(v: object) -> str:
    """The least logical type that holds a Python value."""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        for t in ("byte", "int", "uint", "wide"):
            if DOMAIN[t][0] <= v <= DOMAIN[t][1]:
                return t
        raise BadValue(f"{v} needs more than 64 bits")
    return "double" if isinstance(v, float) else "string"


def widest(*ltypes: str) -> str:
    return max(ltypes, key=_RANK.index)


def checked(v: object, ltype: str) -> object:
    """A Python value as ``ltype`` takes it; an error where it is outside the domain."""
    if ltype in ("string", "any"):
        return v if isinstance(v, str) else as_text_value(v)
    if ltype == "boolean":
        if isinstance(v, str):
            v = {"1": 1, "0": 0, "true": 1, "false": 0, "yes": 1, "no": 0, "on": 1, "off": 0}.get(v.lower(), v)
        if isinstance(v, (bool, int, float)):
            return bool(v)
        raise BadValue(f"{v!r} is no boolean")
    try:
        if ltype == "double":
            return float(v)
        n = int(v, 0) if isinstance(v, str) else int(v)
        if isinstance(v, float) and n != v:
            raise ValueError
    except (TypeError, ValueError):
        raise BadValue(f"{v!r} is no {ltype}") from None
    if not DOMAIN[ltype][0] <= n <= DOMAIN[ltype][1]:
        raise BadValue(f"{v} is outside {ltype}")
    return n


def as_text_value(v: object) -> str:
    return str(int(v)) if isinstance(v, bool) else str(v)


def as_text(c: Column, ltype: str) -> Column:
    """Values as strings: booleans as 0 and 1."""
    return c.cast("int").cast("string") if ltype == "boolean" else c.cast("string")


def as_long(c: Column, ltype: str) -> Column:
    if ltype == "boolean":
        return c.cast("int").cast("long")
    if ltype == "double":  # the fraction goes; what no long holds has no defined value and gives 0
        return F.when((c > -9.2e18) & (c < 9.2e18), c).otherwise(0.0).cast("long")
    return c.cast("long")


def wrapped(c: Column, ltype: str) -> Column:
    """A BIGINT folded into an integer type by dropping its high bits."""
    if ltype == "byte":
        return c.bitwiseAND(F.lit(255)).cast("short")
    if ltype == "uint":
        return c.bitwiseAND(F.lit(4294967295))
    if ltype == "int":
        low = c.bitwiseAND(F.lit(4294967295))
        return F.when(low > 2147483647, low - 4294967296).otherwise(low).cast("int")
    return c != 0 if ltype == "boolean" else c


def wrapped64(c: Column) -> Column:
    """A whole DECIMAL folded into BIGINT."""
    m = F.pmod(c, F.lit(str(2**64)).cast("decimal(38,0)"))
    return F.when(m >= F.lit(str(2**63)).cast("decimal(38,0)"), m - F.lit(str(2**64)).cast("decimal(38,0)")).otherwise(m).cast("long")


def cast(c: Column, source: str, target: str) -> Column:
    """A lossy conversion: high bits are dropped, fractions truncated; text must parse."""
    if source == target:
        return c
    if target in ("string", "any"):
        return as_text(c, source)
    if source in ("string", "any"):
        if target == "boolean":
            return F.when(F.lower(c).isin("1", "true", "yes", "on"), True).when(F.lower(c).isin("0", "false", "no", "off"), False).otherwise(F.raise_error(F.lit("not a boolean")).cast("boolean"))
        return strict(c, source, target)
    if target == "double":
        return as_long(c, source).cast("double") if source == "boolean" else c.cast("double")
    if target == "boolean":
        return c != 0
    return wrapped(as_long(c, source), target)


def strict(c: Column, source: str, target: str) -> Column:
    """A conversion that fails at run time where a value is outside the target's domain or has a fraction."""
    if source == target or target in ("string", "any"):
        return cast(c, source, target)
    number = c.cast("int") if source == "boolean" else c
    if target == "double":
        return number.cast("double")
    if target == "boolean":
        return cast(c, source, target)
    if source in ("string", "any", "double"):
        number = number.cast("double") if source == "double" else number.cast("decimal(38,6)")
        ok = (number == F.floor(number)) & number.between(*DOMAIN[target])
    else:
        ok = number.between(*DOMAIN[target])
    return F.when(number.isNull() | ok, number).otherwise(F.raise_error(F.concat(F.lit(f"not a {target}: "), c.cast("string"))).cast("double")).cast(SPARK[target])


def numeric(ltype: str) -> None:
    if ltype in ("string", "any"):
        raise TypeMismatch(f"{ltype} has no arithmetic")
